"""BPE encoding and decoding by batched numpy merge rounds.

The vocabulary and merges of a tokenizer file (word ends marked by a suffix, white space dropped) become sorted pair keys.
The distinct new words of a slice are split into symbols in one flat array; each round finds every pair's rank by binary
search over the sorted keys, takes the lowest rank of each piece and merges it, until no piece has a known pair. Words
already met come from a bounded cache of arrays, by 64-bit hashes. Words beyond ASCII and U+00C0 to U+00FF are normalised and split by the
library's own normalizer and splitter, so its Unicode tables hold. Decoding joins the tokens' strings by one space, as the file has no decoder.

Defined cases: a null or empty text has no ids and decodes to the empty text; repeated rows each give a row; the file's
special tokens are matched in the raw text; columns besides doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
import json
from functools import cached_property

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import buffers, slices, spans, table, word_hashes

#: Words, and pieces of words, that a worker's cache holds before it lets the half least used go.
CACHE_WORDS, CACHE_PIECES = 1 << 19, 1 << 18
_NONE = np.int64(1) << 40


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def gather(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indexes starts[i] ... starts[i] + lengths[i] - 1, one range after another."""
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(int(lengths.sum()))


def hash_of(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


class Vocabulary:
    """Tables of a tokenizer file: byte symbols, sorted pair keys with rank and result, token strings."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            text = f.read()
        spec, self.name = json.loads(text), hash_of(text)
        model, split = spec["model"], spec["pre_tokenizer"]["pretokenizers"][0]
        kinds = [x["type"] for x in spec["normalizer"]["normalizers"]]
        if model["type"] != "BPE" or not model["end_of_word_suffix"] or kinds != ["NFC", "Replace", "Lowercase"] or split["behavior"] != "Removed":
            raise ValueError(f"{path}: not a BPE file with word ends, NFC, white space folding and lower case")
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        self.pattern = split["pattern"]["Regex"]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.size = max([*vocab.values(), *self.special.values()]) + 1
        # bytes that print stand for themselves, the others for code points from 256 on
        printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        others = [b for b in range(256) if b not in printable]
        letter = {b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(others)}
        self.inner = np.array([vocab[letter[b]] for b in range(256)], np.int64)
        self.final = np.array([vocab[letter[b] + end] for b in range(256)], np.int64)
        left, right, made = (np.array(x, np.int64) for x in zip(*((vocab[a], vocab[b], vocab[a + b]) for a, b in model["merges"]), strict=True))
        rank = np.arange(len(left))
        order = np.argsort(left << 20 | right, kind="stable")
        self.keys, self.rank, self.made = (left << 20 | right)[order], rank[order], made[order]
        # if a result may take part in an earlier pair, its occurrences must be merged one at a time
        first_use = np.full(self.size, _NONE)
        np.minimum.at(first_use, left, rank)
        np.minimum.at(first_use, right, rank)
        self.safe = first_use[self.made] > self.rank
        strings = [b""] * self.size
        for text, i in [*vocab.items(), *self.special.items()]:
            strings[i] = text.encode() + b" "
        self.string_ends = np.concatenate([[0], np.cumsum([len(x) for x in strings])])
        self.strings = np.frombuffer(b"".join(strings), np.uint8)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("pieces_of", "special_of", "library")}

    @cached_property
    def pieces_of(self):
        return regex.compile(self.pattern + "|\n").findall

    @cached_property
    def special_of(self):
        return regex.compile("(" + "|".join(regex.escape(x) for x in self.special) + ")") if self.special else None

    def merge(self, symbols: np.ndarray, piece: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge rounds over the symbols of many pieces; piece is ascending. Gives the ids and each one's piece."""
        done_ids, done_piece = [], []
        at = self._find(symbols, piece)
        while len(symbols):
            rank = np.where(at >= 0, self.rank[at], _NONE)
            starts = np.flatnonzero(np.concatenate([[True], piece[1:] != piece[:-1]]))
            best = np.repeat(np.minimum.reduceat(rank, starts), np.diff(np.append(starts, len(piece))))
            live = best < _NONE
            if not live.all():
                done_ids.append(symbols[~live])
                done_piece.append(piece[~live])
                symbols, piece, at, rank, best = symbols[live], piece[live], at[live], rank[live], best[live]
                if not len(symbols):
                    break
            chosen = np.flatnonzero(rank == best)
            # of pairs that overlap, the leftmost and then every second; unsafe results: only the leftmost of a piece
            run = np.cumsum(np.concatenate([[1], np.diff(chosen) != 1]))
            run_start = np.searchsorted(run, run)
            fresh_piece = np.concatenate([[True], np.diff(piece[chosen]) != 0])
            chosen = chosen[((np.arange(len(chosen)) - run_start) % 2 == 0) & (self.safe[at[chosen]] | fresh_piece)]
            symbols[chosen] = self.made[at[chosen]]
            keep = np.ones(len(symbols), bool)
            keep[chosen + 1] = False
            moved = np.cumsum(keep) - 1
            symbols, piece, at = symbols[keep], piece[keep], at[keep]
            here = moved[chosen]
            marked = np.zeros(len(symbols), bool)
            marked[here] = True
            marked[here[here > 0] - 1] = True
            dirty = np.flatnonzero(marked)
            at[dirty] = self._find_at(symbols, piece, dirty)
        if not done_ids:
            return symbols, piece
        ids, own = np.concatenate(done_ids), np.concatenate(done_piece)
        order = np.argsort(own, kind="stable")
        return ids[order], own[order]

    def _find(self, symbols, piece) -> np.ndarray:
        return self._find_at(symbols, piece, np.arange(len(symbols)))

    def _find_at(self, symbols, piece, where) -> np.ndarray:
        """The place of the pair that starts at each position among the sorted keys, -1 if it is none."""
        after = np.minimum(where + 1, len(symbols) - 1)
        key = symbols[where] << 20 | symbols[after]
        place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[place] == key) & (piece[where] == piece[after]) & (after > where), place, -1)

    @cached_property
    def library(self):
        """The library's own normalizer and splitter, for words with letters whose rules are in its Unicode tables."""
        from tokenizers import Regex, normalizers, pre_tokenizers

        fold = normalizers.Sequence([normalizers.NFC(), normalizers.Replace(Regex(r"\s+"), " "), normalizers.Lowercase()])
        return fold.normalize_str, pre_tokenizers.Split(Regex(self.pattern), "removed", invert=True).pre_tokenize_str

    def split(self, words: list[bytes]) -> tuple[list[bytes], np.ndarray]:
        """The pieces of all words, lowered, and how many each has; a special token is marked by the byte 0xFF, which UTF-8 never has."""
        return split_words(words, self.pieces_of, self.odd_pieces)

    def odd_pieces(self, word: bytes) -> list[bytes]:
        out: list[bytes] = []
        text, (fold, split) = word.decode("utf-8", "replace"), self.library
        for part in self.special_of.split(text) if self.special_of else [text]:
            if part in self.special:
                out.append(b"\xff" + part.encode())
            elif part:
                out += [x.encode() for x, _ in split(fold(part))]
        return out

    def encode_pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces, one after another, and how many each has."""
        if not pieces:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        fixed = {k: self.special[x[1:].decode()] for k, x in enumerate(pieces) if x[:1] == b"\xff"}
        plain = [b"\0" if k in fixed else x for k, x in enumerate(pieces)] if fixed else pieces
        sizes = np.array([len(x) for x in plain])
        data = np.frombuffer(b"".join(plain), np.uint8)
        symbols = self.inner[data]
        last = np.cumsum(sizes) - 1
        symbols[last] = self.final[data[last]]
        if fixed:
            symbols[last[list(fixed)]] = list(fixed.values())
        ids, piece = self.merge(symbols, np.repeat(np.arange(len(pieces)), sizes))
        return ids, np.bincount(piece, minlength=len(pieces))

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> list[bytes]:
        """The text of each row's ids: their strings joined by one space."""
        lengths = self.string_ends[ids + 1] - self.string_ends[ids]
        data = self.strings[gather(self.string_ends[ids], lengths)].tobytes()
        upto = np.concatenate([[0], np.cumsum(lengths)])[ends]
        return [data[a : b - 1] if b > a else b"" for a, b in zip(upto[:-1].tolist(), upto[1:].tolist(), strict=True)]


def plain_words(words: list[bytes]) -> np.ndarray:
    """Which words hold only printing ASCII and U+00C0 to U+00FF, and no mark of a special token: these normalise to themselves but for their case, and split alike under any Unicode tables."""
    data = np.frombuffer(b"\n".join([*words, b""]), np.uint8)
    lead = data == 0xC3
    after = np.concatenate([[False], lead[:-1]])
    odd = (data < 0x21) | (data == 0x7F) | ((data >= 0x80) & ~lead & ~after)
    odd[:-1] |= (data[:-1] == 60) & (data[1:] == 124)  # <|
    upto = np.concatenate([[0], np.cumsum(odd)])
    ends = np.cumsum(np.array([len(w) + 1 for w in words], np.int64))
    return np.diff(upto[np.concatenate([[0], ends])]) == 1  # its line feed alone


def split_words(words: list[bytes], find, odd) -> tuple[list[bytes], np.ndarray]:
    """Pieces of words, one after another, and how many each has: runs of plain words by one search (find also matches line feeds), others by odd(word)."""
    plain = plain_words(words)
    found = find(b"\n".join([w for w, p in zip(words, plain.tolist(), strict=True) if p]).decode().lower())
    pieces = [x.encode() for x in found if x != "\n"]
    ends = np.flatnonzero(np.array([x == "\n" for x in found], bool))
    counts = np.zeros(len(words), np.int64)
    some = np.flatnonzero(plain)
    if len(some):
        counts[some] = np.diff(np.concatenate([[-1], ends, [len(found)]])) - 1
    if len(some) < len(words):
        out, at = [], 0
        for k, p in enumerate(plain.tolist()):
            if p:
                out += pieces[at : at + counts[k]]
                at += counts[k]
            else:
                own = odd(words[k])
                counts[k] = len(own)
                out += own
        pieces = out
    return pieces, counts


class Store:
    """Ids of byte strings by the 64-bit hash of their bytes, in arrays alone: some 40 bytes an entry beside its ids. When full it keeps the half most used."""

    def __init__(self, most: int):
        self.most, self.n, self.used = most, 0, 0
        self.keys, self.ids = np.zeros(1 << 10, np.uint64), np.zeros(1 << 12, np.int32)
        self.starts, self.counts, self.uses = (np.zeros(1 << 10, t) for t in (np.int64, np.int32, np.int32))
        self._place(1 << 12)

    def _place(self, size: int) -> None:
        """An open-addressed table of `size` places with all keys in it."""
        self.table = np.full(size, -1, np.int32)
        self._enter(np.arange(self.n, dtype=np.int32))

    def _enter(self, slots: np.ndarray) -> None:
        mask = len(self.table) - 1
        place = (self.keys[slots] & np.uint64(mask)).astype(np.int64)
        while len(slots):
            free = self.table[place] < 0
            self.table[place[free]] = slots[free]  # of several, one stays
            lost = self.table[place] != slots
            slots, place = slots[lost], (place[lost] + 1) & mask

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The slot of each hash, -1 if it has none."""
        mask = len(self.table) - 1
        place = (hashes & np.uint64(mask)).astype(np.int32)
        out = self.table[place].astype(np.int64)
        live = np.flatnonzero((out >= 0) & (self.keys[out] != hashes))
        while len(live):
            place[live] = (place[live] + 1) & mask
            out[live] = self.table[place[live]]
            live = live[(out[live] >= 0) & (self.keys[out[live]] != hashes[live])]
        return out

    def add(self, hashes: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> None:
        """New, distinct hashes with their ids; they get the next slots."""
        old, n = self.n, self.n + len(hashes)
        room = lambda a, m: a if m <= len(a) else np.concatenate([a, np.zeros(max(m, len(a) * 3 // 2) - len(a), a.dtype)])
        self.ids = room(self.ids, self.used + len(ids))
        self.ids[self.used : self.used + len(ids)] = ids
        self.keys, self.starts, self.counts, self.uses = (room(x, n) for x in (self.keys, self.starts, self.counts, self.uses))
        self.keys[old:n], self.counts[old:n], self.uses[old:n] = hashes, counts, 0
        self.starts[old:n] = self.used + np.cumsum(counts) - counts
        self.used, self.n = self.used + len(ids), n
        if 2 * n > len(self.table):
            self._place(1 << (4 * n - 1).bit_length())
        else:
            self._enter(np.arange(old, n, dtype=np.int32))

    def take(self, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of slots, one after another, and how many each has."""
        counts = self.counts[slots].astype(np.int64)
        self.uses[: self.n] += np.bincount(slots, minlength=self.n).astype(np.int32)
        return self.ids[gather(self.starts[slots], counts)], counts

    def shrink(self) -> None:
        if self.n <= self.most:
            return
        uses = self.uses[: self.n]
        kept = np.sort(np.argsort(-uses, kind="stable")[: self.most // 2])
        ids, counts, keys, uses = self.ids[gather(self.starts[kept], self.counts[kept].astype(np.int64))], self.counts[kept], self.keys[kept], uses[kept] // 2
        self.__init__(self.most)
        self.add(keys, ids, counts)
        self.uses[: self.n] = uses


class CachedEncoder:
    """Encodes texts by their words (no token spans ASCII white space) and words by their pieces; each is looked up first, by its hash."""

    def __init__(self, split, encode_pieces, most: int = CACHE_WORDS, most_pieces: int = CACHE_PIECES):
        self.split, self.encode_pieces, self.words, self.pieces = split, encode_pieces, Store(most), Store(most_pieces)

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a column, one after another, and the number of ids before each (one more entry than texts)."""
        data, ends = buffers(column)
        starts, stops, before = spans(data, ends)
        hashes = word_hashes(data, starts, stops)
        self.words.shrink()
        slots = self.words.find(hashes)
        missing = np.flatnonzero(slots < 0)
        if len(missing):
            fresh, first, back = np.unique(hashes[missing], return_index=True, return_inverse=True)
            at = missing[first]
            raw = data.tobytes()
            slots[missing] = self.words.n + back
            self.words.add(fresh, *self._learn([raw[a:b] for a, b in zip(starts[at].tolist(), stops[at].tolist(), strict=True)]))
        ids, counts = self.words.take(slots)
        return ids, np.concatenate([[0], np.cumsum(counts)])[before]

    def _learn(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        pieces, counts = self.split(words)
        distinct: dict[bytes, int] = {}
        own = np.array([distinct.setdefault(x, len(distinct)) for x in pieces], np.int64)
        strings = list(distinct)
        sizes = np.array([len(x) for x in strings], np.int64)
        stops = np.cumsum(sizes)
        hashes = word_hashes(np.frombuffer(b"".join(strings), np.uint8), stops - sizes, stops)
        self.pieces.shrink()
        slots = self.pieces.find(hashes)
        missing = np.flatnonzero(slots < 0)
        if len(missing):
            slots[missing] = self.pieces.n + np.arange(len(missing))
            self.pieces.add(hashes[missing], *self.encode_pieces([strings[k] for k in missing.tolist()]))
        ids, each = self.pieces.take(slots[own])
        upto = np.concatenate([[0], np.cumsum(each)])
        ends = np.concatenate([[0], np.cumsum(counts)])
        return ids, upto[ends[1:]] - upto[ends[:-1]]


#: Encoders that a worker process keeps from task to task, by a name and the tokenizer they belong to.
_KEPT: dict[tuple, CachedEncoder] = {}


def kept_encoder(key: tuple, make) -> CachedEncoder:
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = make()
    return _KEPT[key]


def texts_of(column: pa.Array) -> list[bytes]:
    data, ends = buffers(column)
    raw, ends = data.tobytes(), ends.tolist()
    return [raw[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


def encode_decode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids array<int> and decoded string of every row of docs (doc_id, text)."""
    vocabulary = docs.sparkSession.sparkContext.broadcast(Vocabulary(path or default_path()))

    def run(batches):
        own = vocabulary.value
        encoder = kept_encoder(("numpy", own.name), lambda: CachedEncoder(own.split, own.encode_pieces))
        for batch in slices(batches):
            ids, ends = encoder.encode(batch.column("text"))
            lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists, pa.array(own.decode(ids, ends), pa.binary()).cast(pa.string())], names=["doc_id", "ids", "decoded"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def digests(encoded: DataFrame) -> DataFrame:
    """The ids' and the decoded text's fingerprints."""
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"), F.sha2(F.col("decoded"), 256).alias("decoded_sha256"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(encode_decode(table(spark, sf_dir, "documents")))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of every document of the mix, with the digest of what they decode to."""
    encoded = encode_decode(docs)
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))
