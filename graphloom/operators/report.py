"""Benchmark statistics, trends, accuracy against labels, and overlap between tools."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.storage import cut


def bench_stats(runs: DataFrame) -> DataFrame:  # F19
    """Of each tool: runs, least, largest, mean, upper median, population deviation and success rate. Sums are of whole microseconds; all of it is combined before the shuffle, the median as counts of values."""
    median = F.expr("percentile_disc(0.5) within group (order by micros desc)").cast("long")  # from above, so that of an even number it is the upper one
    return runs.groupBy("tool").agg(F.count("*").alias("runs"), F.min("micros").alias("least"), F.max("micros").alias("most"), F.round(F.avg("micros"), 4).alias("mean"), median.alias("median"), F.round(F.stddev_pop("micros"), 4).alias("deviation"), F.round(F.count_if("success") * 100.0 / F.count("*"), 4).alias("success_rate"))


def fastest(stats: DataFrame) -> DataFrame:  # F22
    """Each tool's mean against the best one's, in per cent."""
    best = stats.agg(F.min_by("tool", F.struct("mean", "tool")).alias("best"), F.min("mean").alias("best_mean"))
    rows = stats.withColumn("one", F.lit(1)).join(best.withColumn("one", F.lit(1)), "one")  # one row beside each tool's
    return rows.select("tool", "best", F.round((F.col("mean") - F.col("best_mean")) * 100.0 / F.col("best_mean"), 4).alias("slower_percent"))


def trend(runs: DataFrame, newest: int = 10) -> DataFrame:  # H7
    """The newest runs of each tool with the change against the run before, in per cent."""
    back = Window.partitionBy("tool").orderBy(F.desc("ts"), F.desc("run_no"))
    rows = runs.withColumn("rank", F.row_number().over(back)).withColumn("previous", F.lead("micros").over(back))
    change = F.when(F.col("previous") > 0, F.round((F.col("micros") - F.col("previous")) * 100.0 / F.col("previous"), 4))
    return rows.where(F.col("rank") <= newest).select("tool", "rank", "run_no", "micros", "previous", change.alias("change_percent"))


def overlap(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:  # I4
    """Counts of common keys, of those only in a or b, and the agreement: common over the larger set, in per cent."""
    both = a.select(*keys).distinct().withColumn("a", F.lit(1)).join(b.select(*keys).distinct().withColumn("b", F.lit(1)), keys, "full")
    out = both.agg(F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("common"), F.count_if(F.col("b").isNull()).alias("only_a"), F.count_if(F.col("a").isNull()).alias("only_b"))
    larger = F.col("common") + F.greatest("only_a", "only_b")
    return out.withColumn("agreement", F.when(larger > 0, F.round(F.col("common") * 100.0 / larger, 4)).otherwise(0.0))


def normalized(path):  # J21
    return F.lower(F.replace(path, F.lit("\\"), F.lit("/")))


#: Bytes of the pieces by which contained paths find what contains them, 8 at most.
GRAM = 6
#: Buckets in which pieces are counted, and bits that say which pieces of a kind are asked for: both bounded, whatever the input.
BUCKETS, BITS = 1 << 20, 1 << 22


def grams(text: Column, size: int) -> Column:
    """The distinct pieces of `size` characters."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(text) - size + 1)), lambda k: F.substring(text, k, F.lit(size))))


_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _grams(batch: pa.RecordBatch, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the pieces of `size` bytes of each path, under the row's seed: hash, row and place in the path; and the bytes of each path."""
    column = batch.column("path").cast(pa.large_binary())
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[-1]]
    window = np.ndarray(shape=(len(data),), dtype="<u8", buffer=np.concatenate([data, np.zeros(8, np.uint8)]), strides=(1,))
    sizes = np.diff(ends)
    many = np.maximum(sizes - size + 1, 0)
    row = np.repeat(np.arange(len(sizes)), many)
    place = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    text = window[(ends[:-1] - ends[0])[row] + place] & np.uint64((1 << 8 * size) - 1)
    return _mix(text ^ _mix(batch.column("seed").to_numpy().view(np.uint64) + np.uint64(size))[row]), row, place, sizes


def _rank(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Rarer pieces first; never 0."""
    return np.minimum(counts[(hashes % np.uint64(BUCKETS)).astype(np.int64)], (1 << 24) - 1).astype(np.uint64) << np.uint64(40) | hashes >> np.uint64(24) | np.uint64(1)


def _own_piece(batch: pa.RecordBatch, size: int, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The key by which each path is found, and its kind: its length below `size`, else `size` and the logarithm of its number of pieces."""
    key, kind = np.zeros(batch.num_rows, np.uint64), np.zeros(batch.num_rows, np.int64)
    for k in range(1, size + 1):
        hashes, row, _, sizes = _grams(batch, k)
        if k < size:
            own = sizes[row] == k
            key[row[own]], kind[row[own]] = hashes[own], k
        elif len(row):
            order = np.lexsort([_rank(hashes, counts), row])
            rows, first = np.unique(row[order], return_index=True)
            key[rows], kind[rows] = hashes[order][first], size + np.floor(np.log2(sizes[rows] - size + 1)).astype(np.int64)
    return _mix(key + kind.astype(np.uint64)), kind


def _asked_pieces(batch: pa.RecordBatch, size: int, counts: np.ndarray, asked: dict[int, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Keys, with their rows, under which a path that some path of the kinds in `asked` lies in is found by it.

    Whatever holds a path of at least w pieces holds w of them in a row with the path's rarest among them, and that is the rarest of those w: only pieces that are the rarest of some w in a row count.
    """
    out = []
    for k in sorted({min(x, size) for x in asked}):
        hashes, row, place, sizes = _grams(batch, k)
        rank = _rank(hashes, counts)
        for kind in (x for x in asked if min(x, size) == k):
            least, w = rank.copy(), 1 << max(kind - size, 0)
            for t in range(max(kind - size, 0)):
                least[: -(1 << t)] = np.minimum(least[: -(1 << t)], least[1 << t :])
            most = np.where(place + w <= sizes[row] - k + 1, least, np.uint64(0))
            for t in range(max(kind - size, 0)):
                most[1 << t :] = np.maximum(most[1 << t :], most[: -(1 << t)].copy())
            own = most == rank
            key = _mix(hashes[own] + np.uint64(kind))
            slot = (key % np.uint64(BITS)).astype(np.int64)
            hit = (asked[kind][slot >> 6] >> (slot & 63).astype(np.uint64) & np.uint64(1)).astype(bool)
            out.append((key[hit], row[own][hit]))
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def containing(a: DataFrame, b: DataFrame, size: int = GRAM) -> DataFrame:  # E15
    """(name, a, b): pairs of rows (name, path) of equal name of which one path holds the other.

    What is contained is found by its rarest piece of `size` bytes, which whatever contains it has too: an equi-join on hashes of (name, piece)
    and numbers of paths, then the test itself over names and texts. How rare pieces are is counted in buckets, which only says which piece is taken.
    A path shorter than that is its own piece. What contains gives the pieces that can be the rarest of a path, of the lengths that there are.
    """
    a, b = (x.where("path <> ''").select("name", "path").distinct().withColumn(c, F.lit(True)) for x, c in ((a, "in_a"), (b, "in_b")))
    paths = cut(a.hint("merge").join(b, ["name", "path"], "full").withColumns({"seed": F.xxhash64("name"), "id": F.xxhash64("name", "path")}), "paths")

    def count(batches):
        seen = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            if batch.num_rows:
                seen += np.bincount((_grams(batch, size)[0] % np.uint64(BUCKETS)).astype(np.int64), minlength=BUCKETS)
        some = np.flatnonzero(seen)
        for k in range(0, len(some), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(some[k : k + (1 << 16)]), pa.array(seen[some[k : k + (1 << 16)]])], names=["bucket", "n"])

    counts = np.zeros(BUCKETS, np.int64)
    seen = paths.select("seed", "path").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()  # at most BUCKETS rows
    counts[seen["bucket"].to_numpy()] = seen["n"].to_numpy()
    counts = paths.sparkSession.sparkContext.broadcast(counts)

    def own(batches):
        for batch in batches:
            if batch.num_rows:
                key, kind = _own_piece(batch, size, counts.value)
                yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in ("name", "path", "in_a", "in_b")), pa.array(key.view(np.int64)), pa.array(kind)], names=["name", "path", "in_a", "in_b", "key", "kind"])

    rare = cut(paths.select("name", "path", "in_a", "in_b", "seed").mapInArrow(own, "name string, path string, in_a boolean, in_b boolean, key long, kind long"), "rare")
    slot = F.expr(f"pmod(key, {BITS}L)")  # a power of two, so that the sign makes no difference
    words = rare.select("kind", F.shiftright(slot, 6).alias("word"), F.expr("1L").alias("one"), (slot % 64).cast("int").alias("bit")).select("kind", "word", F.expr("shiftleft(one, bit)").alias("bits"))
    words = words.groupBy("kind", "word").agg(F.bit_or("bits").alias("bits")).toArrow()  # at most BITS / 64 rows a kind, and a kind for each doubling of the length
    asked = {int(k): np.zeros(BITS >> 6, np.uint64) for k in np.unique(words["kind"].to_numpy())}
    for k in asked:
        mine = words["kind"].to_numpy() == k
        asked[k][words["word"].to_numpy()[mine]] = words["bits"].to_numpy()[mine].view(np.uint64)
    asked = paths.sparkSession.sparkContext.broadcast(asked)

    def pieces(batches):
        for batch in batches:
            if batch.num_rows:
                key, row = _asked_pieces(batch, size, counts.value, asked.value)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), batch.column("id").take(pa.array(row))], names=["key", "id"])

    def within(inner: str, outer: str, names: tuple[str, str]) -> DataFrame:
        around = paths.where(outer).select("seed", "id", "path").mapInArrow(pieces, "key long, id long")
        hit = rare.where(inner).select("key", "name", F.col("path").alias("inner")).hint("merge").join(around, "key").select("name", "inner", "id")
        texts = paths.where(outer).select("id", F.col("name").alias("own"), F.col("path").alias("outer"))
        pairs = hit.hint("merge").join(texts, "id").where((F.col("name") == F.col("own")) & F.col("outer").contains(F.col("inner")))
        return pairs.select("name", F.col("inner").alias(names[0]), F.col("outer").alias(names[1])).select("name", "a", "b")

    return cut(within("in_a", "in_b", ("a", "b")).union(within("in_b", "in_a", ("b", "a"))).distinct(), "containing")


def accuracy(findings: DataFrame, truth: DataFrame, compat: bool = False) -> DataFrame:  # F20, E15
    """Precision, recall and F1 of findings (path, name) against truth (position, path, name, is_unused).

    Normalised, one path must hold the other, and names be equal or both be missing. A finding meets the first unused item that it matches
    and is right, else the first used one and is wrong; one that matches nothing is left out, and with compat it is right. Unused items that
    no finding meets are missed.
    """
    own = lambda df, *more: df.select(normalized(F.col("path")).alias("path"), F.coalesce(F.lower("name"), F.lit("")).alias("name"), *more)
    f, t = own(findings).groupBy("path", "name").agg(F.count("*").alias("n")), own(truth, "position", "is_unused")
    first = t.groupBy("path", "name").agg(F.min(F.when(F.col("is_unused"), F.col("position"))).alias("unused"), F.bool_or(~F.col("is_unused")).alias("used"))
    pairs = containing(f, t).hint("merge").join(first.withColumnRenamed("path", "b"), ["name", "b"]).groupBy(F.col("a").alias("path"), "name").agg(F.min("unused").alias("unused"), F.bool_or("used").alias("used"))
    each = f.join(pairs.hint("merge"), ["path", "name"], "left")
    right = F.col("unused").isNotNull() | (F.lit(compat) & F.col("used").isNull())
    wrong = F.col("unused").isNull() & F.coalesce("used", F.lit(False))
    sum_of = lambda test: F.coalesce(F.sum(F.when(test, F.col("n"))), F.lit(0))
    out = each.agg(sum_of(right).alias("tp"), sum_of(wrong).alias("fp"), F.countDistinct("unused").alias("met")).crossJoin(truth.agg(F.count_if("is_unused").alias("all")))  # one row each
    out = out.withColumn("fn", F.col("all") - F.col("met"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    out = out.withColumn("precision", ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", ratio(F.col("tp"), F.col("tp") + F.col("fn")))
    f1 = ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
    return out.select("tp", "fp", "fn", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"), F.round(f1, 6).alias("f1"))
