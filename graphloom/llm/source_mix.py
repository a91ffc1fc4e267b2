"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

Targets: sources by code point, null last, weigh 3, 1, 2, repeating, and share 150 % of all words; a target stops at twice its
source's words and the excess is shared by weight among the rest until none is above. Each source's target becomes a whole number
of blocks by highest quotients (sources of less than SMALL blocks are apportioned in words among themselves, so that none is lost); within a
source its shards (documents dealt by a seeded hash) get whole quotas the same way. A shard lays its documents' words end to end in a seeded
order and cuts them into blocks. Whole rounds of the quota give every word; of the rest, whole blocks are taken in the order of a seeded
permutation of their numbers, and the last, part one from the next block. So every document's share follows from one running sum.

A source has about SHARD_ROWS documents a shard, at most MOST_SHARDS shards, so a hot source spreads over many groups. The
table of sources (a row each) comes to the driver; documents never do.

Defined cases: null or empty texts have size 0 and nothing taken; null ids are ordered first; repeated rows are documents of
their own, interchangeable if id and text agree; an empty table gives no rows; other columns are ignored by the query and given back by
the stage, whatever their names.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from graphloom.llm.common import buffers, cut, quoted, slices, spans, table

WEIGHTS, SHARE, MOST_REPEATS = (3, 1, 2), 1.5, 2
#: Words of a block; documents of a shard, about; shards of a source at most.
BLOCK_WORDS, SHARD_ROWS, MOST_SHARDS = 64, 256, 65_536
#: A source of fewer blocks than this is apportioned in words.
SMALL = 8
#: Sources of which the plan is broadcast at most.
BROADCAST_SOURCES = 50_000
#: Primes above any number of blocks: multipliers of the permutations of block numbers.
STEPS = (2_147_483_647, 2_147_483_629, 2_147_483_587, 2_147_483_579, 2_147_483_563, 2_147_483_549, 2_147_483_543, 2_147_483_497)


def targets(sizes: list[tuple[str | None, int]]) -> dict[str | None, float]:
    """Words to take of each source."""
    order = sorted(sizes, key=lambda x: (x[0] is None, x[0] or ""))  # Python compares code points
    weight = {s: WEIGHTS[k % len(WEIGHTS)] for k, (s, _) in enumerate(order)}
    most = {s: float(MOST_REPEATS * n) for s, n in order}
    out = dict.fromkeys(most, 0.0)
    free, left = list(most), SHARE * sum(n for _, n in order)
    while free:
        share = left / sum(weight[s] for s in free)
        full = [s for s in free if share * weight[s] > most[s]]
        if not full:
            return out | {s: share * weight[s] for s in free}
        for s in full:
            out[s] = most[s]
            left -= most[s]
        free = [s for s in free if s not in set(full)]
    return out


def highest_quotients(weights: np.ndarray, seats: int, most: np.ndarray | None = None) -> np.ndarray:
    """Sainte-Lague: seats go one by one to the highest of weight / (2 * held + 1), ties to the first; none gets above `most`."""
    weights = np.asarray(weights, float)
    most = np.full(len(weights), seats) if most is None else np.asarray(most)
    if not len(weights) or weights.sum() <= 0:
        return np.zeros(len(weights), np.int64)
    seats = min(int(seats), int(most[weights > 0].sum()))
    # all quotients of at least a divisor have their seats; bisect for a divisor that gives no more seats than there are
    taken = lambda d: np.minimum(np.floor((weights / d + 1) / 2), most).astype(np.int64)
    low, high = 0.0, float(weights.max()) * 1.001
    for _ in range(80):
        middle = (low + high) / 2
        low, high = (low, middle) if middle > 0 and taken(middle).sum() <= seats else (middle, high)
    held = taken(high)
    heap = [(-w / (2 * h + 1), i) for i, (w, h, m) in enumerate(zip(weights, held, most, strict=True)) if w > 0 and h < m]
    heapq.heapify(heap)
    for _ in range(seats - int(held.sum())):
        if not heap:
            break
        _, i = heapq.heappop(heap)
        held[i] += 1
        if held[i] < most[i]:
            heapq.heappush(heap, (-weights[i] / (2 * held[i] + 1), i))
    return held


def sized(docs: DataFrame, whole: bool = False) -> DataFrame:
    """doc_id, source, mark (a hash of the text), size: the words of every whole text; whole: the text and the other columns too, as the struct rest__."""
    keys = [F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text")]
    own = docs.select(*keys, F.xxhash64("text").alias("mark"), *([F.struct(*(F.col(quoted(c)) for c in docs.columns if c != "text")).alias("rest__")] if whole else []))
    kept = ["doc_id", "source", "mark", *(["text", "rest__"] if whole else [])]

    def run(batches):
        for batch in slices(batches):
            size = np.diff(spans(*buffers(batch.column("text")))[2])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(size)], names=[*kept, "size"])

    return own.mapInArrow(run, StructType([*(own.schema[c] for c in kept), StructField("size", LongType())]))


def mix(sizes: DataFrame, source_sizes: DataFrame, seed: int = 5, block: int = BLOCK_WORDS) -> DataFrame:
    """Adds to the rows of sized() source_size, target, taken, and where taken comes from: whole times (rounds) and word ranges (parts).

    source_sizes: source, shard-free totals (source_size, rows) of the same rows.
    """
    spark = sizes.sparkSession
    sources = source_sizes.collect()  # a row a source
    target = targets([(r["source"], r["source_size"]) for r in sources])
    order = sorted(sources, key=lambda r: (r["source"] is None, r["source"] or ""))
    wanted = np.array([target[r["source"]] for r in order])
    small = wanted < SMALL * block
    units = np.where(small, 1, block)
    seats = np.zeros(len(order), np.int64)
    for group, unit in ((small, 1), (~small, block)):
        if group.any():
            seats[group] = highest_quotients(wanted[group], round(wanted[group].sum() / unit))
    plan = [(k, r["source"], r["source_size"], float(wanted[k]), int(seats[k]), int(units[k]), int(min(max(-(-r["rows"] // SHARD_ROWS), 1), MOST_SHARDS))) for k, r in enumerate(order)]
    plan = spark.createDataFrame(plan, "source_no int, planned string, source_size long, target double, seats long, unit int, shards int")
    # ids may be null or hot, so the text deals too
    deal = lambda k: F.xxhash64(F.lit(seed + k), F.col("doc_id"), F.col("size"), F.col("mark"))
    # the plan has a row a source; beyond BROADCAST_SOURCES of them it is no longer small
    dealt = sizes.join(F.broadcast(plan) if len(order) <= BROADCAST_SOURCES else plan, F.col("source").eqNullSafe(F.col("planned"))).drop("planned")
    dealt = dealt.withColumn("shard", F.pmod(deal(0), F.col("shards")).cast("int")).withColumn("draw", deal(1))
    totals = dealt.groupBy("source_no", "shard").agg(F.sum("size").alias("words"), F.first("seats").alias("seats"), F.first("unit").alias("unit"))

    def quotas(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("shard")
        words, unit = pdf["words"].to_numpy(np.int64), int(pdf["unit"].iloc[0])
        held = highest_quotients(words, int(pdf["seats"].iloc[0]), -(-MOST_REPEATS * words // unit))
        return pdf[["source_no", "shard", "words"]].assign(quota=np.minimum(held * unit, MOST_REPEATS * words))

    # a source's shards, at most MOST_SHARDS of them, meet in one group
    quota = totals.groupBy("source_no").applyInPandas(quotas, "source_no int, shard int, words long, quota long")
    own = Window.partitionBy("source_no", "shard").orderBy("draw", "doc_id", "size", "mark").rowsBetween(Window.unboundedPreceding, -1)
    both = dealt.withColumn("at", F.coalesce(F.sum("size").over(own), F.lit(0))).join(quota, ["source_no", "shard"])
    both = both.withColumn("rounds", F.expr("if(words > 0, quota div greatest(words, 1), 0)"))
    draw = lambda k: F.xxhash64(F.lit(seed + k), F.col("source_no"), F.col("shard"))
    both = both.withColumns({
        "rest": F.col("quota") - F.col("rounds") * F.col("words"), "full": F.expr(f"words div {block}"),
        "step": F.element_at(F.array(*(F.lit(x).cast("long") for x in STEPS)), F.pmod(draw(2), F.lit(len(STEPS))).cast("int") + 1),
    }).withColumn("shift", F.pmod(draw(3), F.greatest("full", F.lit(1))))
    # the words that block k gives from its beginning on; the piece after the last full block comes last
    place = "pmod(k * step + shift, greatest(full, 1L))"
    given = f"case when k >= full then if(rest div {block} >= full, rest - full * {block}, 0L) when {place} < rest div {block} then {block}L when {place} = rest div {block} then rest % {block} else 0L end"
    pieces = f"transform(sequence(at div {block}, (at + size - 1) div {block}), k -> named_struct('a', greatest(k * {block} - at, 0L), 'b', least(k * {block} + {given} - at, size)))"
    both = both.withColumn("parts", F.when((F.col("size") > 0) & (F.col("rest") > 0), F.expr(f"filter({pieces}, x -> x.b > x.a)")).otherwise(F.expr("cast(array() as array<struct<a:bigint,b:bigint>>)")))
    taken = F.col("rounds") * F.col("size") + F.aggregate("parts", F.lit(0).cast("long"), lambda n, x: n + x["b"] - x["a"])
    return both.withColumn("taken", taken.cast("long"))


def by_source(sizes: DataFrame) -> DataFrame:
    return sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = cut(sized(table(spark, sf_dir, "documents")), "sizes")
    return mix(sizes, by_source(sizes)).select("doc_id", "size", "source_size", "target", "taken", "source")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix itself: each document as often as it is taken whole, then the words of its parts, joined by line feeds, as a row of its own.

    Such a row's n_chars is its own. A document of which nothing is taken is not in the mix; null, empty and repeated rows as in the query.
    """
    shares = mix(sized(docs, whole=True), by_source(sized(docs)))
    own = shares.where("taken > 0").select("text", "rest__", "rounds", "parts")

    def run(batches):
        for batch in slices(batches):
            data, ends = buffers(batch.column("text"))
            starts, stops, before = spans(data, ends)
            raw, row, texts, part = data.tobytes(), [], [], []
            for i, (rounds, parts) in enumerate(zip(batch.column("rounds").to_pylist(), batch.column("parts").to_pylist(), strict=True)):
                out, joined = [(raw[ends[i] : ends[i + 1]], False)] * rounds, []
                for p in parts:
                    if joined and joined[-1][1] == p["a"]:
                        joined[-1][1] = p["b"]
                    else:
                        joined.append([p["a"], p["b"]])
                if joined:
                    out.append((b"\n".join(raw[starts[before[i] + a] : stops[before[i] + b - 1]] for a, b in joined), True))
                row += [i] * len(out)
                texts += [t for t, _ in out]
                part += [p for _, p in out]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.binary()).cast(pa.string()), batch.column("rest__").take(pa.array(row, pa.int32())), pa.array(part, pa.bool_())], names=["text", "rest__", "part__"])

    mixed = own.mapInArrow(run, StructType([own.schema["text"], own.schema["rest__"], StructField("part__", BooleanType())]))
    field = lambda c: F.col(f"rest__.{quoted(c)}")
    value = lambda c: F.col("text") if c == "text" else F.when(F.col("part__"), F.length("text")).otherwise(field(c)).cast(docs.schema[c].dataType) if c == "n_chars" else field(c)
    return mixed.select(*(value(c).alias(c) for c in docs.columns))
