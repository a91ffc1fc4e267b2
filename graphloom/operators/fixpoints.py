"""Fixpoints over edge frames as rounds of joins: reachability and strongly connected components in few rounds, whatever the shape of the graph.

Nothing comes to the driver but counts. Every round is written to the shared folder, so that a lost executor costs one round, and a plan never
reads more than the frames of its own round. A search that goes one edge a round needs as many rounds as the longest path; here nodes with a
single way in are first contracted by pointer jumping, and labels jump over labels, so that chains and rings take logarithmically many.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from itertools import count

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from graphloom.storage import cut, cut_counting, release

#: Fronts of a search that are read side by side before they are written together.
MOST_FRONTS = 24
#: Contracting goes on while it takes away at least this share, trimming (a round costs less than one of the labels, which it saves many of) this one.
WORTH, TRIM_WORTH = 8, 64
#: Labels go round over all nodes while at least this share of them moves, else only what moved is followed, for at most so many rounds before all are gone over again.
FEW, FEW_ROUNDS = 16, 12


def simple(edges: DataFrame) -> DataFrame:
    """Distinct edges (src, dst) without loops and nulls."""
    return edges.where("src <> dst").select("src", "dst").distinct()


@dataclass
class Contraction:
    """edges between the nodes that stay (length: edges that one stands for), and where the others hang: (node, root, length).

    single: (node, up, length) of the nodes with one way in; share: of all nodes with ways in, settled: of those the ones that hang.
    """

    edges: DataFrame
    hanging: DataFrame
    single: DataFrame
    share: float
    settled: float


def contract(entries: DataFrame | None, edges: DataFrame) -> Contraction:
    """Hang every node that has one edge in, and is no entry, under the node that its single ways in come from.

    edges: (src, dst, length); entries: (module_id). A node that hangs is reached if and only if its root is, `length` edges later. Nodes
    whose single ways in go round in a ring hang under nothing: they are dropped, as nothing reaches them from outside.
    """
    seen = Observation()
    ways = edges.groupBy("dst").agg(F.count("*").alias("ways"), F.min("src").alias("up"), F.min("length").alias("length")).observe(seen, F.count("*").alias("n"))
    single = ways.where("ways = 1").select(F.col("dst").alias("node"), "up", "length")
    single = single if entries is None else single.join(entries.select(F.col("module_id").alias("node")), "node", "left_anti")
    single, hung = cut_counting(single, "single", F.lit(True))
    nodes = seen.get["n"]
    # what hangs under a node that stays is done; the rest is open, and what it hangs under is among them
    first = single.join(single.select(F.col("node").alias("up"), F.lit(True).alias("open")), "up", "left").select("node", "up", "length", F.coalesce("open", F.lit(False)).alias("open"))
    step, left = cut_counting(first, "jumped", F.col("open"))
    done, open_, before = [step.where("not open")], step.where("open"), -1
    while left and left != before:  # a jump doubles what an open pointer spans; one that settles nothing leaves only rings
        jump = reduce(DataFrame.union, [open_, *done]).select(F.col("node").alias("up"), F.col("up").alias("up2"), F.col("length").alias("more"), F.col("open").alias("open2"))
        step, before = open_.join(jump, "up").select("node", F.col("up2").alias("up"), (F.col("length") + F.col("more")).alias("length"), F.col("open2").alias("open")), left
        step, left = cut_counting(step, "jumped", F.col("open"))
        done, open_ = [*done, step.where("not open")], step.where("open")
    hanging = reduce(DataFrame.union, done).select("node", F.col("up").alias("root"), "length")
    rings = open_.select("node")
    outer = edges.join(single.select(F.col("node").alias("dst")), "dst", "left_anti").join(rings.select(F.col("node").alias("src")), "src", "left_anti")
    moved = outer.join(hanging.select(F.col("node").alias("src"), "root", F.col("length").alias("more")), "src", "left")
    kept = moved.select(F.coalesce("root", "src").alias("src"), "dst", (F.col("length") + F.coalesce("more", F.lit(0))).alias("length"))
    return Contraction(kept, hanging, single, hung / max(1, nodes), (hung - left) / max(1, nodes))


def reachable(entries: DataFrame, edges: DataFrame, jumps: bool = True, plain: bool = False) -> DataFrame:  # G2
    """(module_id) of the closure of entries (module_id) over edges (src, dst), entries included; jumps=False searches edge by edge.

    plain: the edges are distinct, without loops and nulls, and written, so that they need not be again.
    """
    entries = cut(entries.select("module_id").distinct(), "entries")
    edges, levels = edges if plain else cut(simple(edges), "edges"), []
    while jumps:
        c = contract(entries, edges.withColumn("length", F.lit(1).cast("long")))
        if c.share < 1 / WORTH:
            break
        levels.append(c.hanging)
        edges = cut(simple(c.edges), "contracted")
    seen = _search(entries, edges)
    for hanging in reversed(levels):
        seen = cut(seen.union(hanging.join(seen.withColumnRenamed("module_id", "root"), "root", "left_semi").select(F.col("node").alias("module_id"))), "seen")
    return seen


def _search(entries: DataFrame, edges: DataFrame) -> DataFrame:
    front, fronts = entries, [entries]
    while True:
        seen = reduce(DataFrame.union, fronts)
        fresh = front.join(edges, front["module_id"] == edges["src"]).select(F.col("dst").alias("module_id")).distinct().join(seen, "module_id", "left_anti")
        front, size = cut_counting(fresh, "front", F.lit(True))
        if not size:
            return seen
        fronts = [*fronts, front] if len(fronts) < MOST_FRONTS else [cut(seen, "seen"), front]


# --- strongly connected components -----------------------------------------------------------------


def _numbered(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges (a, b) between random 64-bit numbers, and (node, number). Another seed is taken in the case that two nodes share a number."""
    nodes = cut(edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct(), "nodes")
    for seed in count(1):
        number = lambda c, s=seed: F.xxhash64(F.lit(s), F.col(c))
        numbers = nodes.withColumn("number", number("node"))
        if numbers.agg(F.count("*") == F.countDistinct("number")).first()[0]:
            return cut(edges.select(number("src").alias("a"), number("dst").alias("b")), "live"), numbers


def _least_before(edges: DataFrame) -> DataFrame:
    """(node, label): the least number among the nodes of edges (a, b) that have a path to the node, itself included.

    Each round a node hears from every way in, from its pointer, some node with a path to it that doubles its distance each round (a
    shortcut over chains and rings), and from the node its label names (a shortcut where edges go both ways). Once few labels move, rounds
    only follow those, over edges and pointers, and leave the other nodes unwritten.
    """
    ways = edges.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("up"))
    state = cut(edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct().join(ways, "node", "left").select("node", F.col("node").alias("label"), F.coalesce("up", "node").alias("up"), F.lit(True).alias("moved")), "labels")
    nodes = None
    while True:
        heard = edges.join(state.where("moved").select(F.col("node").alias("a"), "label"), "a").groupBy(F.col("b").alias("node")).agg(F.min("label").alias("heard"))
        over = state.select(F.col("node").alias("up"), F.col("label").alias("over"), F.col("up").alias("up2"))
        far = state.select(F.col("node").alias("label"), F.col("label").alias("far"))
        new = F.least("label", "far", "over", F.coalesce("heard", "label"))
        step = state.join(heard, "node", "left").join(over, "up").join(far, "label").select("node", new.alias("label"), F.col("up2").alias("up"), (new != F.col("label")).alias("moved"))
        done, moved = cut_counting(step, "labels", F.col("moved"))
        release(state)
        state = done
        nodes = state.count() if nodes is None else nodes
        if moved and moved < nodes / FEW:
            state, moved = _follow(edges, state)
        if not moved:
            return state


def _follow(edges: DataFrame, state: DataFrame) -> tuple[DataFrame, int]:
    """FEW_ROUNDS rounds of labels from the nodes of state that moved, along edges and pointers; the state after them, and how many moved in the last."""
    ways = edges.union(state.where("up <> node").select("up", "node")).toDF("a", "b")
    front, size, fronts = state.where("moved").select("node", "label"), 1, []
    while size and len(fronts) < FEW_ROUNDS:
        heard = front.select(F.col("node").alias("a"), F.col("label").alias("heard")).join(ways, "a").groupBy(F.col("b").alias("node")).agg(F.min("heard").alias("heard"))
        less = heard.join(state.select("node", "label"), "node").where("heard < label").select("node", "heard")
        if fronts:
            less = less.join(_least_of(fronts), "node", "left").where("newer is null or heard < newer")
        front, size = cut_counting(less.select("node", F.col("heard").alias("label")), "moved", F.lit(True))
        fronts.append(front)
    last = fronts[-1].select("node", F.lit(True).alias("again"))
    after = state.select("node", "label", "up").join(_least_of(fronts), "node", "left").join(last, "node", "left")
    done = cut(after.select("node", F.least("label", F.coalesce("newer", "label")).alias("label"), "up", F.coalesce("again", F.lit(False)).alias("moved")), "labels")
    release(state, *fronts)
    return done, size


def _least_of(fronts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.union, fronts).groupBy("node").agg(F.min("label").alias("newer"))


def components(edges: DataFrame, trim: bool = True) -> DataFrame:  # G1
    """(module_id, scc_id) of strongly connected components of two or more; scc_id is the least member. A self-loop is no cycle.

    What goes through a node with a single way in goes through where that comes from, so such nodes are first contracted into their roots
    while that pays, and edges out of roots that nothing leads to are left out. Of what hangs under a root, the nodes with an edge back
    into the root's component belong to it, and all between them and the root.
    """
    edges = cut(simple(edges), "edges")  # read several times
    c = contract(None, edges.withColumn("length", F.lit(1).cast("long")))
    if c.settled < 1 / WORTH:
        return _coloured(edges, trim)
    hanging = c.hanging.select("node", "root")
    outer = edges.join(hanging.select(F.col("node").alias("dst")), "dst", "left_anti").join(hanging.withColumnRenamed("node", "src"), "src", "left")
    outer = cut(outer.select(F.when(F.col("root").isNotNull(), F.col("src")).alias("node"), F.coalesce("root", "src").alias("src"), "dst").join(outer.select(F.col("dst").alias("src")).distinct(), "src", "left_semi"), "contracted")
    return _unfolded(components(outer.select("src", "dst"), trim), outer, hanging, c.single)


def _unfolded(found: DataFrame, outer: DataFrame, hanging: DataFrame, single: DataFrame) -> DataFrame:
    """The components found among the nodes that stay, with what hangs under those; outer: (node, src, dst), edges to nodes that stay, src for the node that hangs under it."""
    of = lambda c: found.select(F.col("module_id").alias(c), F.col("scc_id").alias(f"{c}_scc"))
    backs = outer.where("node is not null").join(of("src"), "src", "left").join(of("dst"), "dst", "left").withColumn("scc", F.coalesce("src_scc", "src"))
    inside, new = cut_counting(backs.where(F.col("scc") == F.coalesce("dst_scc", "dst")).select("node", F.col("src").alias("root"), "scc").distinct(), "inside", F.lit(True))
    if not new:
        return found
    up, news = single.join(hanging.join(inside.select("root").distinct(), "root", "left_semi"), "node").select("node", "up"), [inside]
    up = cut(up, "ups")
    while new:  # the pointers double what they span; what adds nothing at one of them adds nothing later
        inside = reduce(DataFrame.union, news)
        above = inside.join(up, "node").select(F.col("up").alias("node"), "root", "scc").distinct().join(inside.select("node"), "node", "left_anti")
        above, new = cut_counting(above, "inside", F.lit(True))
        news.append(above)
        up = cut(up.join(up.select(F.col("node").alias("up"), F.col("up").alias("up2")), "up").select("node", F.col("up2").alias("up")), "ups") if new else up
    members = found.select("module_id", F.col("scc_id").alias("scc")).union(reduce(DataFrame.union, news).select("node", "scc")).distinct()
    least = members.groupBy("scc").agg(F.min("module_id").alias("scc_id"))
    return cut(members.join(least, "scc").select("module_id", "scc_id"), "components")


def _coloured(edges: DataFrame, trim: bool) -> DataFrame:
    """components() of edges that are distinct, without loops and nulls, and written.

    Nodes become random numbers. The least number that reaches a node is its colour; within a colour, the nodes that also reach the
    colour's node are its component. The rest goes round again, over edges within one colour and one backward label: since the numbers
    are random, the parts shrink as in quicksort, so a chain of components takes logarithmically many rounds too. Before each round nodes
    without a way in or out are trimmed while that pays.
    """
    live, numbers = _numbered(edges)
    found: list[DataFrame] = []
    size = live.count()
    while size:
        while trim and size:
            pruned, left = cut_counting(live.join(live.select(F.col("b").alias("a")).distinct(), "a", "left_semi").join(live.select(F.col("a").alias("b")).distinct(), "b", "left_semi").select("a", "b"), "live", F.lit(True))
            release(live)
            before, live, size = size, pruned, left
            if before - size < before / TRIM_WORTH:
                break
        if not size:
            break
        color = _least_before(live)
        side = lambda labels, c: labels.select(F.col("node").alias(c), F.col("label").alias(f"{c}_label"))
        inner = cut(live.join(side(color, "a"), "a").join(side(color, "b"), "b").where("a_label = b_label").select("a", "b"), "inner")
        back = _least_before(inner.select(F.col("b").alias("a"), F.col("a").alias("b")))
        both = back.join(color.select("node", F.col("label").alias("color")), "node")
        found.append(cut(both.where("label = color").select("node", F.col("color").alias("scc")), "found"))
        rest = side(back.join(found[-1].select("node"), "node", "left_anti"), "a"), side(back.join(found[-1].select("node"), "node", "left_anti"), "b")
        left, size = cut_counting(inner.join(rest[0], "a").join(rest[1], "b").where("a_label = b_label").select("a", "b"), "live", F.lit(True))
        release(live, inner, color, back)
        live = left
    kind = edges.schema["src"].dataType.simpleString()
    if not found:
        return edges.sparkSession.createDataFrame([], f"module_id {kind}, scc_id {kind}")
    members = reduce(DataFrame.union, found).withColumnRenamed("node", "number").join(numbers, "number").select(F.col("node").alias("module_id"), "scc")
    least = members.groupBy("scc").agg(F.min("module_id").alias("scc_id"), F.count("*").alias("n")).where("n > 1")
    return cut(members.join(least, "scc").select("module_id", "scc_id"), "components")
