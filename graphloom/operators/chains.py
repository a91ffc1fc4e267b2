"""Import chains without enumerating them: how near and how far every module is from the entries, over how many chains, and chains unfolded on demand.

Simple paths are exponentially many on any graph of branches, so none is kept. Distances are of single imports; what counts chains and
their longest one needs a graph without cycles, so there every strongly connected component is one step. Nodes with a single way in are
contracted first (fixpoints.contract) and get their values from the node they hang under, so that long lines cost no rounds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.operators.fixpoints import components, contract, reachable, simple
from graphloom.storage import cut, release


def distances(entries: DataFrame, edges: DataFrame) -> DataFrame:
    """(module_id, depth): the least number of edges (src, dst) from an entry (module_id) to each module that one reaches."""
    entries = cut(entries.select("module_id").distinct(), "entries")
    c = contract(entries, simple(edges).withColumn("length", F.lit(1).cast("long")))
    ways = cut(c.edges.groupBy("src", "dst").agg(F.min("length").alias("length")), "ways")
    near = front = cut(entries.withColumn("depth", F.lit(0).cast("long")), "near")
    while True:
        heard = front.join(ways, front["module_id"] == ways["src"]).groupBy(F.col("dst").alias("module_id")).agg(F.min(F.col("depth") + F.col("length")).alias("heard"))
        done = cut(near.join(heard, "module_id", "full").select("module_id", F.least("depth", "heard").alias("depth"), F.coalesce(F.col("heard") < F.col("depth"), F.col("depth").isNull()).alias("moved")), "near")
        near, front = done.select("module_id", "depth"), done.where("moved").select("module_id", "depth")
        if not front.limit(1).count():
            break
    hung = c.hanging.join(near.withColumnRenamed("module_id", "root"), "root").select(F.col("node").alias("module_id"), (F.col("depth") + F.col("length")).alias("depth"))
    return cut(near.union(hung), "distances")


def counted_chains(entries: DataFrame, edges: DataFrame, reached: bool = False) -> DataFrame:
    """(module_id, longest, chains) over edges without a cycle: the longest chain from an entry, and how many there are (exact up to 2^53).

    A node is settled when all its ways in are; only nodes that entries reach take part, so every one is settled in the end. reached: entries
    are known to reach all nodes of edges.
    """
    entries = cut(entries.select("module_id").distinct(), "entries")
    live = simple(edges)
    if not reached:
        live = live.join(reachable(entries, edges).withColumnRenamed("module_id", "src"), "src", "left_semi")
    c = contract(entries, live.withColumn("length", F.lit(1).cast("long")))
    ways = cut(c.edges.groupBy("src", "dst").agg(F.max("length").alias("length"), F.count("*").cast("double").alias("n")), "ways")
    missing = ways.groupBy(F.col("dst").alias("module_id")).agg(F.count("*").alias("missing"))
    own = entries.withColumns({"longest": F.lit(0).cast("long"), "chains": F.lit(1.0)})
    state = cut(missing.join(own, "module_id", "full").select("module_id", F.coalesce("missing", F.lit(0)).alias("missing"), F.coalesce("longest", F.lit(0)).cast("long").alias("longest"), F.coalesce("chains", F.lit(0.0)).alias("chains")), "open")
    settled = []
    while state.limit(1).count():
        front, rest = state.where("missing = 0").drop("missing"), state.where("missing > 0")
        settled.append(cut(front, "settled"))
        pushed = settled[-1].join(ways, F.col("module_id") == F.col("src")).groupBy("dst").agg(F.count("*").alias("came"), F.max(F.col("longest") + F.col("length")).alias("far"), F.sum(F.col("chains") * F.col("n")).alias("more"))
        new = rest.join(pushed, F.col("module_id") == F.col("dst"), "left").select("module_id", (F.col("missing") - F.coalesce("came", F.lit(0))).alias("missing"), F.greatest("longest", F.coalesce("far", "longest")).alias("longest"), (F.col("chains") + F.coalesce("more", F.lit(0.0))).alias("chains"))
        after = cut(new, "open")
        release(state)
        state = after
        if len(settled) == 16:  # a plan reads few frames, however many rounds there are
            settled = [cut(_all(settled), "settled")]
    if not settled:
        return own
    roots = _all(settled)
    hung = c.hanging.join(roots.withColumnRenamed("module_id", "root"), "root").select(F.col("node").alias("module_id"), (F.col("longest") + F.col("length")).alias("longest"), "chains")
    return cut(roots.union(hung), "chains")


def _all(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for df in frames[1:]:
        out = out.union(df)
    return out


def chain_summary(entries: DataFrame, edges: DataFrame, best: int = 3) -> DataFrame:  # G15, D36
    """Of every module that an entry reaches: depth (imports of its shortest chain), longest and chains (over components as single steps), and via, its `best` predecessors on shortest chains, least first.

    Distances come first: only edges between nodes that are reached go on to components and counts, as a component is reached whole or not at all.
    """
    whole = cut(simple(edges), "edges")
    near = distances(entries, whole)
    edges = cut(whole.join(near.select(F.col("module_id").alias("src")), "src", "left_semi"), "edges")
    release(whole)
    scc = components(edges)
    group = lambda df, c: df.join(scc.select(F.col("module_id").alias(c), F.col("scc_id").alias(f"{c}_scc")), c, "left").withColumn(c, F.coalesce(f"{c}_scc", c)).drop(f"{c}_scc")
    far = counted_chains(group(entries.select("module_id"), "module_id"), group(group(edges, "src"), "dst"), reached=True)
    grouped = near.join(scc, "module_id", "left").withColumn("group", F.coalesce("scc_id", "module_id")).drop("scc_id")
    rows = grouped.join(far.withColumnRenamed("module_id", "group"), "group").drop("group")
    back = edges.join(near.select(F.col("module_id").alias("src"), F.col("depth").alias("before")), "src").join(near.withColumnRenamed("module_id", "dst"), "dst").where("before + 1 = depth")
    few = back.withColumn("rank", F.row_number().over(Window.partitionBy("dst").orderBy("src"))).where(F.col("rank") <= best)
    via = few.groupBy(F.col("dst").alias("module_id")).agg(F.sort_array(F.collect_list("src")).alias("via"))
    return cut(rows.join(via, "module_id", "left"), "chain_summary")


def unfold(summary: DataFrame, targets: DataFrame) -> DataFrame:
    """(module_id, chain) of targets (module_id): a shortest chain of each from an entry, by the least predecessors; a round an import of the deepest target."""
    step = summary.select(F.col("module_id").alias("head"), F.col("via")[0].alias("before"))
    open_ = cut(targets.select("module_id").distinct().join(summary.select("module_id"), "module_id", "left_semi").select("module_id", F.array("module_id").alias("chain"), F.col("module_id").alias("head")), "chains")
    done = []
    while True:
        moved = cut(open_.join(step, "head").select("module_id", "chain", "before"), "chains")
        done.append(moved.where("before is null").select("module_id", "chain"))
        open_ = moved.where("before is not null").select("module_id", F.concat(F.array("before"), "chain").alias("chain"), F.col("before").alias("head"))
        if not open_.limit(1).count():
            return cut(_all(done), "unfolded")
