"""Exact top-k by inner product, with a KD-tree for each shard.

Vectors are quantised to integers, hashed into shards of bounded size, and each shard becomes a KD-tree: median splits on the
widest dimension down to small leaves, with the tight box of every node. Queries are packed in blocks. A first round lets every
shard answer each query from its best leaf; the largest of the k-th scores found there bounds the answer from below. The second
round walks each tree best first, by the largest inner product that a node's box allows, and stops once no box beats the bound that
travels with the query. What is left, at most k rows a query and shard, is ranked. Arithmetic is exact: products go through doubles or
64-bit integers where no partial sum can pass them, through Python's integers elsewhere.

Defined cases: a vector that is null, empty, or holds a null or non-finite component takes no part, nor does a row with a null vec_id; every other
vector does. A component beyond 2**62 after scaling, or a score among the k best that no long holds, raises an error instead of a wrong
answer. Vectors of different length are not compared; the same vec_id in several rows: each row
is a candidate for other ids, none for its own, and a query id answers once, for its first vector in array order; ties go to the smaller vec_id.
"""

from __future__ import annotations

import heapq
import io

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import cut, table

#: Rows of a shard, about; rows of a leaf; queries of a block.
SHARD_ROWS, LEAF_ROWS, BLOCK = 8192, 64, 512
SCALE, MOST = 1024, float(1 << 62)
#: Below every score, and safe to negate; scores beyond a long stand at plus or minus END until they are ranked.
NOTHING, END = -((1 << 63) - 1), (1 << 63) - 2


def quantised(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, v array<long>) of the rows that take part: floor(1024 * component), in doubles."""
    x = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("x"))
    fine = (F.size("x") > 0) & F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    whole = lambda c: F.when(F.abs(c * SCALE) < MOST, F.floor(c * SCALE).cast("long")).otherwise(F.raise_error(F.lit("a component does not fit a long after scaling")).cast("long"))
    return x.where("vec_id is not null and x is not null").where(fine).select("vec_id", F.transform("x", whole).alias("v"))


def pack(**arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def unpack(data: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(data)) as f:
        return {k: f[k] for k in f.files}


def build_tree(ids: np.ndarray, v: np.ndarray, leaf: int = LEAF_ROWS) -> dict[str, np.ndarray]:
    """Rows in leaf order, and for each node its box, its rows, and its children (-1: a leaf)."""
    order, low, high, span, child = np.arange(len(ids)), [], [], [], []
    todo = [(0, len(ids), -1, 0)]
    while todo:
        a, b, parent, side = todo.pop()
        own = v[order[a:b]]
        lo, hi = own.min(0), own.max(0)
        me = len(low)
        low.append(lo), high.append(hi), span.append((a, b)), child.append([-1, -1])
        if parent >= 0:
            child[parent][side] = me
        if b - a > leaf and (hi > lo).any():
            dim, mid = int(np.argmax(hi - lo)), (b - a) // 2
            order[a:b] = order[a:b][np.argpartition(own[:, dim], mid)]
            todo += [(a, a + mid, me, 0), (a + mid, b, me, 1)]
    return {"ids": ids[order], "v": v[order], "low": np.array(low), "high": np.array(high), "span": np.array(span), "child": np.array(child)}


def exact_product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products of rows: through doubles while every partial sum fits them, then through longs, and row by row through Python's integers for what could pass them (cut off at END)."""
    sums = np.abs(a.astype(np.float64)).sum(-1)
    peaks = np.abs(b.astype(np.float64)).max(-1, initial=0)
    top = float(sums.max(initial=0)) * float(peaks.max(initial=0))
    if top < 2**53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    if top < 2**62:
        return a @ b.T
    out = np.zeros((len(a), len(b)), np.int64)
    for i in range(len(a)):
        fits = sums[i] * peaks < 2**62
        out[i, fits] = b[fits] @ a[i]
        for j in np.flatnonzero(~fits):
            out[i, j] = max(-END, min(END, sum(x * y for x, y in zip(a[i].tolist(), b[j].tolist(), strict=True))))
    return out


def bounds(tree: dict[str, np.ndarray], q: np.ndarray) -> np.ndarray:
    """The largest inner product that each node's box allows with each query: negative components meet the low corner."""
    parts = exact_product(np.maximum(q, 0), tree["high"]), exact_product(np.minimum(q, 0), tree["low"])
    if max(np.abs(x).max(initial=0) for x in parts) < 2**62:
        return parts[0] + parts[1]
    whole = parts[0].astype(np.float64) + parts[1].astype(np.float64)
    # beyond a long every bound counts as the highest, so that nothing is left out
    return np.where(np.abs(whole) < 2**62, parts[0] + parts[1], np.where(whole < 0, -(1 << 62), END))


def _keep(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((ids, -scores))[:k]
    return ids[order], scores[order]


def probe(tree: dict[str, np.ndarray], qids: np.ndarray, q: np.ndarray, k: int) -> np.ndarray:
    """For each query the k-th best score in its best leaf, or NOTHING where the leaf has fewer rows: a bound from below."""
    leaves = np.flatnonzero(tree["child"][:, 0] < 0)
    best = leaves[np.argmax(bounds(tree, q)[:, leaves], 1)]
    out = np.full(len(q), NOTHING)
    for node in np.unique(best):
        own = np.flatnonzero(best == node)
        a, b = tree["span"][node]
        score = exact_product(q[own], tree["v"][a:b])
        score[qids[own][:, None] == tree["ids"][a:b][None]] = NOTHING
        if b - a >= k:
            out[own] = -np.partition(-score, k - 1, axis=1)[:, k - 1]
    return out


def search(tree: dict[str, np.ndarray], qids: np.ndarray, q: np.ndarray, floor: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-first walk of the tree for each query: (query ids, vec ids, scores) of the shard's rows that may be among the k best."""
    bound, out = bounds(tree, q), ([], [], [])
    for i in range(len(q)):
        kth = int(floor[i])
        ids, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        heap = [(-int(bound[i, 0]), 0)]
        while heap:
            top, node = heapq.heappop(heap)
            if -top < kth:
                break
            left, right = tree["child"][node]
            if left >= 0:
                for c in (int(left), int(right)):
                    if bound[i, c] >= kth:
                        heapq.heappush(heap, (-int(bound[i, c]), c))
                continue
            a, b = tree["span"][node]
            score = exact_product(q[i : i + 1], tree["v"][a:b])[0]
            fit = (score >= kth) & (tree["ids"][a:b] != qids[i])
            if fit.any():
                ids, scores = _keep(np.concatenate([ids, tree["ids"][a:b][fit]]), np.concatenate([scores, score[fit]]), k)
                if len(ids) == k:
                    kth = max(kth, int(scores[-1]))
        if len(scores) and max(abs(int(scores[0])), abs(int(scores[-1]))) >= END:
            raise OverflowError(f"a score of query {qids[i]} does not fit a long")
        out[0].append(np.full(len(ids), qids[i]))
        out[1].append(ids)
        out[2].append(scores)
    return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in out)


def topk(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id, score: the k largest inner products of each query with the other vectors; both frames from quantised()."""
    rows = vectors.withColumn("dim", F.size("v"))
    sizes = {r["dim"]: r["n"] for r in rows.groupBy("dim").agg(F.count("*").alias("n")).collect()}  # one row a vector length

    def planted(pdf: pd.DataFrame) -> pd.DataFrame:
        order = np.argsort(pdf["vec_id"].to_numpy(), kind="stable")
        v = np.array(pdf["v"].tolist(), np.int64)[order]
        return pd.DataFrame({"dim": [int(pdf["dim"].iloc[0])], "shard": [int(pdf["shard"].iloc[0])], "tree": [pack(**build_tree(pdf["vec_id"].to_numpy()[order], v))]})

    count = F.lit(1)
    for dim, n in sorted(sizes.items()):
        count = F.when(F.col("dim") == dim, F.lit(max(1, -(-n // SHARD_ROWS)))).otherwise(count)
    # the id alone may be hot, so the vector deals too
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("vec_id", "v"), count).cast("int"))
    trees = cut(dealt.groupBy("dim", "shard").applyInPandas(planted, "dim int, shard int, tree binary"), "trees")

    own = queries.groupBy("vec_id").agg(F.min("v").alias("v")).withColumn("dim", F.size("v"))
    asked = own.groupBy("dim").agg(F.count("*").alias("n")).collect()
    blocks = {r["dim"]: max(1, -(-r["n"] // BLOCK)) for r in asked}
    count = F.lit(1)
    for dim, n in sorted(blocks.items()):
        count = F.when(F.col("dim") == dim, F.lit(n)).otherwise(count)

    def packed(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("vec_id")
        data = pack(ids=pdf["vec_id"].to_numpy(np.int64), q=np.array(pdf["v"].tolist(), np.int64), floor=pdf["floor"].to_numpy(np.int64))
        return pd.DataFrame({"dim": [int(pdf["dim"].iloc[0])], "block": [int(pdf["block"].iloc[0])], "queries": [data]})

    def paired(asking: DataFrame) -> DataFrame:
        """Every tree beside every block of queries of its dimension: the blocks are dealt to each shard by an equi-join."""
        made = asking.groupBy("dim", "block").applyInPandas(packed, "dim int, block int, queries binary")
        shards = F.lit(0)
        for dim, n in sorted(sizes.items()):
            shards = F.when(F.col("dim") == dim, F.lit(max(1, -(-n // SHARD_ROWS)) - 1)).otherwise(shards)
        return trees.join(made.withColumn("shard", F.explode(F.sequence(F.lit(0), shards))), ["dim", "shard"]).select("tree", "queries")

    def first_round(batches):
        for batch in batches:
            for tree, asking in zip(batch.column("tree"), batch.column("queries"), strict=True):
                t, a = unpack(tree.as_py()), unpack(asking.as_py())
                yield pa.RecordBatch.from_arrays([pa.array(a["ids"]), pa.array(probe(t, a["ids"], a["q"], k))], names=["vec_id", "floor"])

    def second_round(batches):
        for batch in batches:
            for tree, asking in zip(batch.column("tree"), batch.column("queries"), strict=True):
                t, a = unpack(tree.as_py()), unpack(asking.as_py())
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in search(t, a["ids"], a["q"], a["floor"], k)], names=["query_id", "vec_id", "score"])

    asking = own.withColumn("block", F.pmod(F.xxhash64("vec_id"), count).cast("int"))
    least = F.lit(NOTHING).cast("long")
    floors = paired(asking.withColumn("floor", least)).mapInArrow(first_round, "vec_id long, floor long").groupBy("vec_id").agg(F.max("floor").alias("floor"))
    found = paired(asking.join(floors, "vec_id")).mapInArrow(second_round, "query_id long, vec_id long, score long")
    # at most k rows a query and shard arrive; the k best are kept by one sort of each query's array
    best = found.groupBy("query_id").agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("down"), "vec_id"))), 1, k).alias("best"))
    ranked = best.select("query_id", F.posexplode("best").alias("at", "hit"))
    return ranked.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("hit.vec_id").alias("vec_id"), (-F.col("hit.down")).alias("score"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = quantised(table(spark, sf_dir, "embeddings"))
    return topk(vectors, vectors.where("vec_id % 100 = 0"))


SQL = """
WITH x AS (SELECT vec_id, list_transform(embedding, lambda c: CAST(floor(1024 * CAST(c AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
             AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
s AS (SELECT q.vec_id AS query_id, x.vec_id, CAST(list_sum(list_transform(list_zip(q.v, x.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
      FROM x q JOIN x ON q.vec_id % 100 = 0 AND q.vec_id <> x.vec_id AND len(q.v) = len(x.v)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS k FROM s)
SELECT query_id, CAST(k AS INTEGER) AS rank, vec_id, score FROM r WHERE k <= 10
"""
