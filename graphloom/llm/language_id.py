"""Language identification by words first and character n-grams where words are unknown.

Training counts every word of every training text by language, and from the distinct words and their counts every character n-gram of 5 to
1 characters (of the word between two spaces). Of each order the model holds an entry (feature, language) if it makes up at least
languages / ENTRIES of that language's count; as the shares of a language add up to 1, an order never has more than ENTRIES entries, whatever
the size of the corpus, so the model can be sent to every task. Scoring gives each word of the whole text its log frequency in each
language if the model knows the word in any of them (half the least count held stands for a language that lacks it); a word the model does
not know backs off to its longest n-grams that are known, whose mean stands for the word. A text's sums plus the languages' log shares
go through a softmax.

Words are runs of letters, lower-cased. Features are 64-bit hashes, so of 10^6 entries two are mixed up with a chance of 3 in 10^8.

Defined cases: a null text and a text without a letter are `und` with score 0, as is any text if nothing was learned; null languages teach
nothing; a tie goes to the smaller name; a text of unknown characters only gets the commonest language;
repeated rows each count and each give a row; a null doc_id counts as empty text for the fold; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import cut, mix, release, remainder, slices, table

#: Longest n-gram, and the most entries of the words and of each order of n-grams.
LONGEST, ENTRIES, GRAM_ENTRIES = 5, 1 << 19, 1 << 17
#: Distinct words or n-grams that a task counts before it hands them on.
HELD = 1 << 17
#: Languages up to which their counts are broadcast.
FEW = 4096
UNKNOWN = "und"

_WORD = re.compile(r"[^\W\d_]+")


def letter_words(text: str) -> list[str]:
    """The words of a text; what has word characters but no letter (a superscript) is none."""
    words = _WORD.findall(text.lower())
    return words if all(map(str.isalpha, words)) else [w for w in words if any(map(str.isalpha, w))]


def grams(word: str, order: int) -> list[str]:
    """The n-grams of a word with a space on either side; of one character those of the word alone."""
    if order == 1:
        return list(word)
    padded = f" {word} "
    return [padded[k : k + order] for k in range(len(padded) - order + 1)]


def word_keys(words: list[str]) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(w.encode()) for w in words], np.uint64).view(np.int64)


def gram_keys(words: list[str], order: int) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the n-grams of all words, by their code points, and the word that each belongs to."""
    codes = np.frombuffer("".join(f" {w} " for w in words).encode("utf-32-le"), np.uint32).astype(np.uint64)
    size = np.fromiter(map(len, words), np.int64, len(words)) + 2
    begin, n = np.cumsum(size) - size, np.maximum(size - order + 1, 0)
    if order == 1:
        begin, n = begin + 1, size - 2
    owner = np.repeat(np.arange(len(words)), n)
    first = np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(n.sum())
    out = np.full(len(first), order, np.uint64)
    for k in range(order):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + codes[first + k])
    return out.view(np.int64), owner


# --- counts ---------------------------------------------------------------------------------------


def word_counts(rows: DataFrame) -> DataFrame:
    """(lang, word, n) of all words of rows (lang, text); tasks add up what they hold before it is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = defaultdict(Counter)
        size = 0
        for batch in slices(batches):
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                own = held[lang]
                size -= len(own)
                own.update(letter_words(text))
                size += len(own)
                if size >= HELD:
                    yield from (_counted(x, c) for x, c in held.items())
                    held, size = defaultdict(Counter), 0
        yield from (_counted(x, c) for x, c in held.items() if c)

    each = rows.mapInArrow(run, "lang string, word string, n long")
    return each.groupBy("lang", "word").agg(F.sum("n").alias("n"))


def _counted(lang: str, counts: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([lang] * len(counts), pa.string()), pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["lang", "word", "n"])


def feature_counts(words: DataFrame) -> DataFrame:
    """(order, lang, key, n) of the n-grams of words (lang, word, n), and of the words themselves as order 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows + batch.column("word").nbytes // 16
            if size >= HELD:
                yield from _features(pa.Table.from_batches(held))
                held, size = [], 0
        if held:
            yield from _features(pa.Table.from_batches(held))

    return words.mapInArrow(run, "order int, lang string, key long, n long").groupBy("order", "lang", "key").agg(F.sum("n").alias("n"))


def _features(rows: pa.Table) -> Iterator[pa.RecordBatch]:
    """The features of distinct words, added up by order and language."""
    lang, counts = rows.column("lang").to_pandas(), rows.column("n").to_numpy()
    words = np.array(rows.column("word").to_pylist(), object)
    for x, at in lang.groupby(lang).indices.items():
        own, n = list(words[at]), counts[at]
        for order in range(LONGEST + 1):
            keys, owner = gram_keys(own, order) if order else (word_keys(own), np.arange(len(own)))
            distinct, place = np.unique(keys, return_inverse=True)
            total = np.bincount(place, n[owner], len(distinct)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(distinct), order, np.int32)), pa.array([x] * len(distinct), pa.string()), pa.array(distinct), pa.array(total)], ["order", "lang", "key", "n"])


# --- model ----------------------------------------------------------------------------------------


@dataclass
class Order:
    """Features of one order: sorted keys, where each one's entries begin, the entries' languages and logs, and every language's log of a missing one."""

    keys: np.ndarray
    begin: np.ndarray
    lang: np.ndarray
    log: np.ndarray
    floor: np.ndarray


@dataclass
class Model:
    langs: list[str] = field(default_factory=list)
    prior: np.ndarray = field(default_factory=lambda: np.zeros(0))
    orders: list[Order] = field(default_factory=list)

    def add(self, out: np.ndarray, rows: np.ndarray, order: int, keys: np.ndarray) -> np.ndarray:
        """Add the logs of the features that are known to their rows of out; says which are."""
        o, n = self.orders[order], len(self.langs)
        if not len(o.keys) or not len(keys):
            return np.zeros(len(keys), bool)
        at = np.minimum(np.searchsorted(o.keys, keys), len(o.keys) - 1)
        known = o.keys[at] == keys
        at, rows = at[known], rows[known]
        out += np.bincount(rows, minlength=len(out))[:, None] * o.floor
        size = o.begin[at + 1] - o.begin[at]
        entry = np.repeat(o.begin[at] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        lang = o.lang[entry]
        out += np.bincount(np.repeat(rows, size) * n + lang, o.log[entry] - o.floor[lang], out.size).reshape(out.shape)
        return known

    def vectors(self, words: list[str]) -> np.ndarray:
        """A row of logs a word: its own if it is known, else the mean of its longest known n-grams, else zeros."""
        out = np.zeros((len(words), len(self.langs)))
        left = np.flatnonzero(~self.add(out, np.arange(len(words)), 0, word_keys(words)))
        for order in range(LONGEST, 0, -1):
            if not len(left):
                break
            keys, owner = gram_keys([words[i] for i in left], order)
            own = np.zeros((len(left), len(self.langs)))
            known = self.add(own, owner, order, keys)
            n = np.bincount(owner[known], minlength=len(left))
            done = n > 0
            out[left[done]] = own[done] / n[done, None]
            left = left[~done]
        return out


def train(rows: DataFrame) -> Model:
    """The model of rows (lang, text). Only entries that reach their share of a language come to the driver, at most ENTRIES + LONGEST * GRAM_ENTRIES."""
    words = cut(word_counts(rows.where("lang is not null and text is not null")), "words")
    features = cut(feature_counts(words), "features")
    totals = features.groupBy("order", "lang").agg(F.sum("n").alias("total"))
    langs = totals.where("order = 0").count()
    totals = totals.withColumn("least", F.greatest(F.lit(1.0), F.col("total") * langs / F.when(F.col("order") == 0, ENTRIES).otherwise(GRAM_ENTRIES)))
    kept = cut(features.join(F.broadcast(totals) if langs <= FEW else totals, ["order", "lang"]).where("n >= least").select("order", "lang", "key", "n"), "entries")
    entries, shares = kept.toPandas(), totals.join(kept.select("lang").distinct(), "lang").toPandas()
    release(words, features, kept)
    return model_of(entries, shares)


def model_of(entries: pd.DataFrame, shares: pd.DataFrame) -> Model:
    """The model of entries (order, lang, key, n) and of the total and least count of each order and language that has any entry."""
    langs = sorted(shares["lang"].unique())
    if not langs:
        return Model()
    number = {x: k for k, x in enumerate(langs)}
    total, least = np.ones((LONGEST + 1, len(langs))), np.ones((LONGEST + 1, len(langs)))
    place = shares["order"].to_numpy(), shares["lang"].map(number).to_numpy()
    total[place], least[place] = shares["total"], shares["least"]
    orders = []
    for order in range(LONGEST + 1):
        e = entries[entries["order"] == order].sort_values(["key", "lang"])
        keys, begin = np.unique(e["key"].to_numpy(np.int64), return_index=True)
        own = e["lang"].map(number).to_numpy(np.int32)
        orders.append(Order(keys, np.append(begin, len(e)), own, np.log(e["n"].to_numpy(float) / total[order][own]), np.log(least[order] / 2 / total[order])))
    return Model(langs, np.log(total[0] / total[0].sum()), orders)


# --- scores ---------------------------------------------------------------------------------------


class Scorer:
    """Predictions of texts; the vectors of words are kept in a table, which begins anew when it holds `room` words."""

    def __init__(self, model: Model):
        self.model = model
        self.room = max(4096, (1 << 20) // max(1, len(model.langs)))
        self.forget()

    def forget(self) -> None:
        self.place: dict[str, int] = {}
        self.rows = np.zeros((1024, len(self.model.langs)))

    def learn(self, words: Iterable[str]) -> None:
        """Make the table hold all of these words."""
        words = list(words)
        fresh = [w for w in words if w not in self.place]
        if len(self.place) + len(fresh) > self.room:
            self.forget()
            fresh = words
        if fresh:
            have, need = len(self.place), len(self.place) + len(fresh)
            if need > len(self.rows):
                self.rows = np.concatenate([self.rows[:have], np.zeros((2 * need - have, len(self.model.langs)))])
            self.rows[have:need] = self.model.vectors(fresh)
            self.place.update(zip(fresh, range(have, need), strict=True))

    def total(self, counts: Counter) -> np.ndarray:
        """The sum of the vectors of a text's words."""
        words, out = list(counts), np.zeros(len(self.model.langs))
        for at in range(0, len(words), self.room):
            part = words[at : at + self.room]
            self.learn(part)
            own = np.fromiter(map(self.place.__getitem__, part), np.int64, len(part))
            out += np.fromiter(map(counts.__getitem__, part), float, len(part)) @ self.rows[own]
        return out

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """(language, score) of each text."""
        counts = [Counter(letter_words(x)) if x else Counter() for x in texts]
        if self.model.langs:
            self.learn(dict.fromkeys(w for c in counts for w in c))  # all at once
        return [self._best(c) for c in counts]

    def _best(self, counts: Counter) -> tuple[str, float]:
        if not counts or not self.model.langs:
            return UNKNOWN, 0.0
        total = self.total(counts) + self.model.prior
        best = int(total.argmax())
        return self.model.langs[best], float(1 / np.exp(total - total[best]).sum())


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """docs (doc_id, text, ...) as doc_id, lang_pred and score, in one Arrow pass."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in slices(batches):
            said = scorer.predict(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([x for x, _ in said], pa.string()), pa.array([s for _, s in said], pa.float64())], ["doc_id", "lang_pred", "score"])

    own = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return own.mapInArrow(run, f"doc_id {own.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = remainder("doc_id", 4) == 2
    model = train(docs.where(~held_out).select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")))
    return identify(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
