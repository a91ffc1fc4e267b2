r"""Periodic runs of words: every stretch that repeats a block of words at least twice, found exactly.

Words are `[^\x20\x09-\x0D]+`, numbered from 0 in each text. A run is a stretch of at least `least` words and two periods, of smallest
period q, that no neighbouring word extends. Of two copies q words apart, at least least/2 words in a row are equal wherever such a run
goes, so each of its words lies in a k-gram, k = ceil(least/2), that its text holds twice. Words outside repeated k-grams are masked;
Main and Lorentz's search (halves, and for each period the extensions of the middle to both sides) goes over the surviving segments only.
A slice of texts is searched level by level in numpy; extensions are compared by ranks of blocks of 1, 2, 4, ... words, which are exact.
One pass over the texts, without any shuffle. A surviving word costs 4 bytes for each doubling of the longest segment, in slices of some 2 MB
of text (a longer text is a slice of its own).

Defined cases: a null or empty text has no words, no runs and an empty collapsed text; repeated rows each give a row; a null doc_id counts as
empty text where its crc32 is asked for; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import CRC_SQL, crc_sql, remainder, slices, table, windows

#: Least length of a run in words.
LEAST = 12


def word_numbers(texts: list[bytes]) -> tuple[list[list[bytes]], np.ndarray, np.ndarray]:
    """The words of each text, a number for each word that is equal only for equal words of one text, and the words before each text."""
    words = [x.split() for x in texts]  # of bytes: at exactly the six ASCII spaces
    before = np.concatenate([[0], np.cumsum([len(x) for x in words])]).astype(np.int64)
    numbers = np.empty(before[-1], np.int64)
    for own, at in zip(words, before, strict=False):
        numbers[at : at + len(own)] = np.fromiter(map({}.setdefault, own, count(int(at))), np.int64, len(own))
    return words, numbers, before


def surviving(numbers: np.ndarray, before: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and stops of the stretches of words that lie in k-grams their text holds twice. Hashes that collide only let more words survive."""
    first, grams = windows(numbers.astype(np.uint64), before, k)
    order = np.sort(grams)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    hit = first[twice[np.minimum(np.searchsorted(twice, grams), len(twice) - 1)] == grams]
    step = np.zeros(len(numbers) + 1, np.int32)
    step[hit] += 1
    step[hit + k] -= 1
    inside = np.cumsum(step[:-1]) > 0
    new = np.zeros(len(numbers) + 1, bool)  # where a text begins, so that segments end there
    new[before] = True
    starts = np.flatnonzero(inside & (new[:-1] | ~np.concatenate([[False], inside[:-1]])))
    stops = np.flatnonzero(inside & (new[1:] | ~np.concatenate([inside[1:], [False]]))) + 1
    return starts, stops


def _block_ranks(words: np.ndarray, longest: int) -> list[np.ndarray]:
    """For k = 0, 1, ...: numbers of the blocks of 2^k words from each place on, equal only for equal blocks."""
    ranks = [np.unique(words, return_inverse=True)[1].astype(np.int32)]
    while 2 << (len(ranks) - 1) <= longest:
        last, half = ranks[-1], 1 << (len(ranks) - 1)
        pairs = last[:-half].astype(np.int64) * (int(last.max()) + 1) + last[half:]
        ranks.append(np.unique(pairs, return_inverse=True)[1].astype(np.int32))
    return ranks


def _extend(ranks: list[np.ndarray], a: np.ndarray, b: np.ndarray, most: np.ndarray, back: bool) -> np.ndarray:
    """How many words are equal from a and b on, or before a and b; at most `most`."""
    out = np.zeros(len(a), np.int64)
    for k in range(len(ranks) - 1, -1, -1):
        rank, size = ranks[k], 1 << k
        live = np.flatnonzero(out + size <= most)
        shift = -out[live] - size if back else out[live]
        out[live[rank[a[live] + shift] == rank[b[live] + shift]]] += size
    return out


def main_lorentz(words: np.ndarray, starts: np.ndarray, stops: np.ndarray, least: int = LEAST) -> np.ndarray:
    """Rows (start, stop, period) of all runs inside the segments [starts, stops) of words, sorted."""
    keep = stops - starts >= least
    starts, stops = starts[keep], stops[keep]
    if not len(starts):
        return np.zeros((0, 3), np.int64)
    size = stops - starts
    ends = np.cumsum(size)
    lo, hi = ends - size, ends  # the segments, moved together
    own = words[np.repeat(starts - lo, size) + np.arange(ends[-1])]
    ranks = _block_ranks(own, int(size.max()))
    flat, segment, seg_lo, seg_hi = ranks[0], np.arange(len(lo)), lo, hi
    found = []
    while len(lo):
        mid = (lo + hi) // 2
        # a run over the middle reaches a period beyond it (then the word before the middle comes again) or a period before it (then the word after)
        node = np.repeat(np.arange(len(lo)), hi - lo)
        place = np.repeat(lo - np.concatenate([[0], np.cumsum(hi - lo)[:-1]]), hi - lo) + np.arange(len(node))
        right = place >= mid[node]
        equal = flat[place] == flat[mid[node] - right]
        place, node, right = place[equal], node[equal], right[equal]
        period = np.where(right, place + 1 - mid[node], mid[node] - place)
        a = np.where(right, mid[node], place)
        b = a + period
        ahead = _extend(ranks, a, b, hi[node] - b, back=False)
        behind = _extend(ranks, a, b, a - lo[node], back=True)
        good = ahead + behind >= np.maximum(period, least - period)
        s, e, q, node = (a - behind)[good], (b + ahead)[good], period[good], node[good]
        # what goes on beyond this part was found whole where the part was cut off
        first, last = seg_lo[segment[node]], seg_hi[segment[node]]
        more = (s > first) & (flat[np.maximum(s - 1, 0)] == flat[np.maximum(s - 1, 0) + q])
        more |= (e < last) & (flat[np.minimum(e, len(flat) - 1)] == flat[np.minimum(e, len(flat) - 1) - q])
        s, e, q, node = s[~more], e[~more], q[~more], node[~more]
        moved = (starts - seg_lo)[segment[node]]
        found.append(np.stack([s + moved, e + moved, q], 1))
        lo, hi, segment = np.concatenate([lo, mid]), np.concatenate([mid, hi]), np.concatenate([segment, segment])
        wide = hi - lo >= least
        lo, hi, segment = lo[wide], hi[wide], segment[wide]
    runs = np.concatenate(found)
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    # of one stretch the smallest period counts: all others are its multiples
    fresh = np.ones(len(runs), bool)
    fresh[1:] = (runs[1:, :2] != runs[:-1, :2]).any(1)
    runs = runs[fresh]
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def runs_of(texts: list[bytes], least: int = LEAST) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Rows (start, length, period) of the runs of all texts, where each text's rows begin (one more than texts), and the texts without what repeats."""
    words, numbers, before = word_numbers(texts)
    runs = main_lorentz(numbers, *surviving(numbers, before, -(-least // 2)), least)
    step = np.zeros(len(numbers) + 1, np.int64)
    np.add.at(step, runs[:, 0] + runs[:, 2], 1)
    np.add.at(step, runs[:, 1], -1)
    keep = np.cumsum(step[:-1]) == 0
    upto = np.searchsorted(runs[:, 0], before)
    collapsed = []
    for k, own in enumerate(words):
        if upto[k] < upto[k + 1]:
            own = [own[i] for i in np.flatnonzero(keep[before[k] : before[k + 1]])]
        collapsed.append(b" ".join(own))
    start = runs[:, 0] - np.repeat(before[:-1], np.diff(upto))
    return np.stack([start, runs[:, 1] - runs[:, 0], runs[:, 2]], 1), upto, collapsed


RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"


def periodic_runs(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """doc_id, runs (start, length, period; by start, then period) and collapsed (the words outside every run's repetitions, joined by a space) of docs (doc_id, text)."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = [x or b"" for x in batch.column("text").cast(pa.large_binary()).to_pylist()]
            runs, upto, collapsed = runs_of(texts, least)
            rows = pa.StructArray.from_arrays([pa.array(runs[:, k], pa.int64()) for k in range(3)], ["start", "length", "period"])
            lists = pa.ListArray.from_arrays(pa.array(upto, pa.int32()), rows)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists, pa.array(collapsed, pa.binary()).cast(pa.string())], ["doc_id", "runs", "collapsed"])

    own = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return own.mapInArrow(search, f"doc_id {own.schema['doc_id'].dataType.simpleString()}, runs {RUNS}, collapsed string")


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda x: x != "")


def planted(docs: DataFrame) -> DataFrame:
    """doc_id and text, where the id's crc32 h is a multiple of ten with the words from a on repeating p of them: a and p follow from floor(h / 10)."""
    h = remainder("doc_id", 1 << 32)
    g = F.floor(h / 10)
    rows = docs.select("doc_id", "text", F.when(h % 10 == 0, words(F.col("text"))).alias("w"), g.alias("g"))
    rows = rows.withColumn("n", F.nullif(F.size("w"), F.lit(0)).cast("long")).withColumn("a", F.col("g") % F.col("n"))
    left = F.col("n") - F.col("a")
    rows = rows.withColumn("left", left).withColumn("p", 1 + F.floor(F.col("left") / (3 + F.col("g") % 8)))
    part = lambda x, at, size: F.slice(x, at.cast("int"), size.cast("int"))
    block = part("w", F.col("a") + 1, F.col("p"))
    again = part(F.flatten(F.array_repeat(block, F.ceil(F.col("left") / F.col("p")).cast("int"))), F.lit(1), F.col("left"))
    made = F.array_join(F.concat(part("w", F.lit(1), F.col("a")), again), " ")
    return rows.select("doc_id", F.when(F.col("n").isNotNull(), made).otherwise(F.col("text")).alias("text"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = periodic_runs(planted(table(spark, sf_dir, "documents")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r.length.alias("length"), (-r.start).alias("start"), (-r.period).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r.start, F.lit(","), r.length, F.lit(","), r.period, F.lit("\n"))), "")
    return rows.select("doc_id", "runs", "collapsed", best.alias("best"), lines.alias("lines")).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"), (-F.col("best.period")).alias("period"),
        F.floor(1000 * F.col("best.length") / -F.col("best.period")).alias("exponent_milli"), F.sha2("lines", 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


#: Every pair of equal words of a text, q apart, in unbroken stretches: what is left of them are the runs, without any search.
SQL = rf"""
WITH {CRC_SQL},
d AS (SELECT row_number() OVER () AS r, doc_id, {crc_sql('doc_id')} AS h, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents, crc_table),
g AS (SELECT *, len(w) AS n, h // 10 AS g, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) END AS a FROM d),
p AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM g),
v AS (SELECT r, doc_id, n, CASE WHEN a IS NULL THEN w ELSE list_transform(range(n), lambda i: w[CAST(CASE WHEN i < a THEN i ELSE a + (i - a) % p END AS BIGINT) + 1]) END AS w FROM p),
x AS (SELECT r, unnest(w) AS word, unnest(range(len(w))) AS i FROM v),
pairs AS (SELECT a.r, a.i, b.i - a.i AS q FROM x a JOIN x b ON a.r = b.r AND a.word = b.word AND b.i > a.i),
islands AS (SELECT r, q, min(i) AS s, max(i) + q + 1 AS e FROM (SELECT *, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS k FROM pairs) GROUP BY r, q, k HAVING max(i) + q + 1 - min(i) >= greatest(12, 2 * q)),
runs AS (SELECT r, s, e - s AS l, min(q) AS q FROM islands GROUP BY r, s, e),
found AS (SELECT r, count(*) AS n_runs, arg_min([s, l, q], [-l, s, q]) AS best, string_agg(s || ',' || l || ',' || q || chr(10), '' ORDER BY s, q) AS lines FROM runs GROUP BY r),
gone AS (SELECT DISTINCT r, unnest(range(s + q, s + l)) AS i FROM runs),
kept AS (SELECT r, string_agg(word, ' ' ORDER BY i) AS body FROM (SELECT * FROM x ANTI JOIN gone USING (r, i)) GROUP BY r)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, best[1] AS start, best[2] AS length, best[3] AS period, 1000 * best[2] // best[3] AS exponent_milli,
       sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(body, '')) AS collapsed_sha256
FROM v LEFT JOIN found USING (r) LEFT JOIN kept USING (r)
"""
