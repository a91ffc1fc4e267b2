"""A Merkle manifest of a dataset: a binary hash tree for each language, their roots under one root, and a proof for every row.

A leaf is the sha256 of a row's fields, each framed by its length. The leaves of a tree are put in order by one range sort of digests (never
of texts) and numbered by the counts of the sorted partitions. Aligned blocks of 512 leaves are the unit of work: a block is walked leaf by
leaf as in fractal Merkle traversal. At each of its three bands of three levels the existing subtree gives the siblings of the present leaf
while the desired subtree, the next one to the right, is built from its leaves a step at a time; what is held is two subtrees a band, however
many proofs come out. The roots of the blocks are the leaves of the next layer, which is made of the same operator, until each tree has one
root; those are the leaves of the last tree. Then every proof gets its upper part by joins on (tree, block), and each task folds its rows.
A layer divides the nodes by 512, so 10^11 rows take five; no task holds more than its blocks, and equal rows are spread by their place.

Defined cases: a null field is `-`, also in the order (null languages first, null ids first); repeated rows have equal leaves and take places
next to each other, so each has a proof of its own; an empty table has no rows and no root; a row alone in its tree has an empty proof there;
a null doc_id counts as empty text for the crc32 that chooses the tampered rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType, StructField, StructType
from pyspark.sql.window import Window

from graphloom.llm.common import CRC_SQL, crc_sql, cut, remainder, table

#: Levels of a block and of one band of subtrees in it.
BLOCK, BAND = 9, 3
NONE, LEFT, RIGHT = b"\0", b"\1", b"\2"


def digest(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def joined(a: str | None, b: str | None) -> str | None:
    """The node over a and b; the last node of a level may be alone, and beyond the last leaf there is nothing."""
    return None if a is None else digest(a) if b is None else digest(a, b)


class Subtree:
    """The nodes of levels [bottom, top) under one node of level top, as they come out of hashing its leaves from the left."""

    def __init__(self, leaves: list[str], number: int, bottom: int, top: int):
        self.leaves, self.at, self.stop = leaves, number << top, (number + 1) << top
        self.bottom, self.top = bottom, top
        self.nodes: dict[tuple[int, int], str] = {}
        self.tail: list[tuple[int, int, str | None]] = []  # level, index, digest: the unfinished right edge
        self.root: str | None = None

    def step(self) -> None:
        """Take one more leaf and finish the nodes that it completes."""
        if self.at >= self.stop:
            return
        node = (0, self.at, self.leaves[self.at] if self.at < len(self.leaves) else None)
        self.at += 1
        while True:
            level, index, own = node
            if own is not None and self.bottom <= level < self.top:
                self.nodes[level, index] = own
            if level == self.top:
                self.root = own
                return
            if not index & 1:
                self.tail.append(node)
                return
            node = (level + 1, index >> 1, joined(self.tail.pop()[2], own))

    def finished(self) -> Subtree:
        while self.at < self.stop:
            self.step()
        return self


def traverse(leaves: list[str], height: int, band: int = BAND) -> Iterator[tuple[str, bytes]]:
    """The root of the tree of this height over the leaves and the authentication path of each leaf, in order.

    A path has an entry a level: nothing, or the digest of the sibling on the left or right, marked as such.
    """
    edges = [(k, min(k + band, height)) for k in range(0, height, band)]
    existing = [Subtree(leaves, 0, a, b).finished() for a, b in edges]
    desired = [Subtree(leaves, 1, a, b) for a, b in edges[:-1]]
    root = existing[-1].root if edges else leaves[0]
    for j in range(len(leaves)):
        path = []
        for own in existing:
            for level in range(own.bottom, own.top):
                index = (j >> level) ^ 1
                found = own.nodes.get((level, index))
                path.append(NONE if found is None else (LEFT if index & 1 == 0 else RIGHT) + bytes.fromhex(found))
        yield root, b"".join(path)
        for k, (_, top) in enumerate(edges[:-1]):
            desired[k].step()
            if (j + 1) & ((1 << top) - 1) == 0:  # the walk leaves the existing subtree
                existing[k] = desired[k].finished()
                desired[k] = Subtree(leaves, ((j + 1) >> top) + 1, *edges[k])


def siblings(path: bytes) -> Iterator[tuple[bytes, str]]:
    """(mark, digest) of a path, a level at a time."""
    at = 0
    while at < len(path):
        mark = path[at : at + 1]
        size = 0 if mark == NONE else 32
        yield mark, path[at + 1 : at + 1 + size].hex()
        at += 1 + size


def fold(own: str, path: bytes) -> str:
    """The root that a leaf and its path lead to."""
    for mark, other in siblings(path):
        own = digest(own) if mark == NONE else digest(other, own) if mark == LEFT else digest(own, other)
    return own


# --- distributed layers ---------------------------------------------------------------------------


def placed(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows with place (from 0, by `order` within `tree`) and total (rows of the tree). Equal rows take places next to each other."""
    rows = cut(rows, "leaves").withColumn("tie", F.monotonically_increasing_id())
    keys = ["tree", *order, "tie"]
    by = [F.col(k).asc_nulls_first() for k in keys]
    held = cut(rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("row", F.monotonically_increasing_id()).withColumn("part", F.shiftright("row", 33)).drop("tie"), "sorted")
    counts = held.groupBy("tree", "part").agg(F.min("row").alias("first"), F.count("*").alias("n"))
    own = Window.partitionBy("tree")
    counts = counts.withColumns({"before": F.sum("n").over(own.orderBy("part")) - F.col("n"), "total": F.sum("n").over(own)})
    return held.join(counts.drop("n"), ["tree", "part"]).withColumn("place", F.col("before") + F.col("row") - F.col("first")).drop("part", "row", "first", "before")


def walk(nodes: DataFrame) -> DataFrame:
    """nodes (tree, place, total, digest, ...) with path, the siblings inside each node's block, and top, the block's root."""
    schema = StructType([*nodes.schema.fields, StructField("path", BinaryType()), StructField("top", StringType())])

    def one(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("place").combine_chunks()
        total = rows.column("total")[0].as_py()
        height = BLOCK if total > 1 << BLOCK else (total - 1).bit_length()
        roots, paths = zip(*traverse(rows.column("digest").to_pylist(), height), strict=True)
        return rows.drop_columns("block").append_column("path", pa.array(paths, pa.binary())).append_column("top", pa.array(roots, pa.string()))

    return nodes.withColumn("block", F.shiftright("place", BLOCK)).groupBy("tree", "block").applyInArrow(one, schema)


def layers(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """The walked layers from the leaves up, and (tree, digest) of the trees' roots."""
    done, roots = [], []
    while True:
        done.append(cut(walk(nodes), "layer"))
        tops = done[-1].where(F.col("place") % (1 << BLOCK) == 0).select("tree", F.shiftright("place", BLOCK).alias("place"), "total", F.col("top").alias("digest"))
        roots.append(tops.where(F.col("total") <= 1 << BLOCK).select("tree", "digest"))
        nodes = tops.where(F.col("total") > 1 << BLOCK).withColumn("total", F.ceil(F.col("total") / (1 << BLOCK)))
        if not nodes.limit(1).count():
            return done, reduce(DataFrame.union, roots)


def lifted(walked: list[DataFrame], tops: DataFrame) -> DataFrame:
    """The leaves with their whole path and the columns of tops (tree, path, ...): a tree's root hands down to its blocks, they to theirs, always joined on (tree, block)."""
    given = [c for c in tops.columns if c not in ("tree", "path")]
    ends = tops.select("tree", F.lit(0).cast("long").alias("block"), F.lit(True).alias("last"), F.col("path").alias("above"), *given)
    up = ends
    for k in range(len(walked) - 1, -1, -1):
        rows = walked[k].drop("top").withColumns({"block": F.shiftright("place", BLOCK), "last": F.col("total") <= 1 << BLOCK})
        rows = rows.join(up, ["tree", "block", "last"]).withColumn("path", F.concat("path", "above")).drop("above", "block", "last")
        if k:
            up = ends.union(cut(rows, "upper").select("tree", F.col("place").alias("block"), F.lit(False).alias("last"), F.col("path").alias("above"), *given))
    return rows


def manifest(leaves: DataFrame, order: list[str]) -> DataFrame:
    """leaves (tree, digest, ...) with place, total, path (to the root over all trees), subroot and root. Trees are ordered bytewise by name."""
    walked, subroots = layers(placed(leaves, order))
    trees = placed(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest"), ["name"])
    over, root = layers(trees)
    tops = lifted(over, root.select("tree", F.lit(b"").alias("path"), F.col("digest").alias("root")))
    return lifted(walked, tops.select(F.col("name").alias("tree"), "path", F.col("digest").alias("subroot"), "root"))


# --- rows of documents ----------------------------------------------------------------------------

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def leaf(fields: list[Column]) -> Column:
    """Hex sha256 of the fields: `-` for null, else the byte count, a colon and the value."""
    framed = [F.coalesce(F.concat(F.octet_length(x.cast("string")).cast("string"), F.lit(":"), x.cast("string")), F.lit("-")) for x in fields]
    return F.sha2(F.concat(*framed), 256)


def leaves(docs: DataFrame) -> DataFrame:
    """tree, doc_id, digest, and tampered: the digest with n_chars one larger where 7 divides the id's crc32, else null."""
    own, changed = [F.col(x) for x in FIELDS], [F.col(x) + 1 if x == "n_chars" else F.col(x) for x in FIELDS]
    bad = (remainder("doc_id", 7) == 0) & F.col("n_chars").isNotNull()
    tree = F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit(""))
    return docs.select(tree.alias("tree"), "doc_id", leaf(own).alias("digest"), F.when(bad, leaf(changed)).alias("tampered"))


def checked(rows: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256 (of the sibling digests), folded_root (from tampered, else the leaf) and verified."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own, changed, path, root = (b.column(x).to_pylist() for x in ("digest", "tampered", "path", "root"))
            proofs = [digest(*(x for _, x in siblings(p))) for p in path]
            folded = [fold(c or o, p) for o, c, p in zip(own, changed, path, strict=True)]
            same = [f == r for f, r in zip(folded, root, strict=True)]
            columns = [b.column("doc_id"), b.column("digest"), b.column("subroot"), b.column("root"), pa.array(proofs, pa.string()), pa.array(folded, pa.string()), pa.array(same, pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.select("doc_id", "digest", "tampered", "path", "subroot", "root").mapInArrow(run, f"doc_id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checked(manifest(leaves(table(spark, sf_dir, "documents")), ["doc_id", "digest"]))


def _framed(n_chars: str) -> str:
    return " || ".join(f"coalesce(strlen(CAST({x} AS VARCHAR)) || ':' || CAST({x} AS VARCHAR), '-')" for x in ("doc_id", "source", "lang", n_chars, "text"))


#: Level by level over all nodes of all trees (a tree that has one node left waits), then a last tree; the fold goes up the same levels.
SQL = f"""
WITH RECURSIVE {CRC_SQL},
d AS (SELECT *, {crc_sql('doc_id')} % 7 = 0 AS bad, sha256({_framed('n_chars')}) AS leaf, sha256({_framed('(n_chars + 1)')}) AS changed FROM documents, crc_table),
l AS (SELECT doc_id, coalesce('=' || lang, '') AS tree, leaf, CASE WHEN bad AND n_chars IS NOT NULL THEN changed ELSE leaf END AS shown, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM d),
nodes(level, tree, i, n, h) AS (SELECT 0, tree, i, count(*) OVER (PARTITION BY tree), leaf FROM l UNION ALL
    SELECT any_value(level) + 1, tree, i // 2, (any_value(n) + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM nodes WHERE n > 1 GROUP BY tree, i // 2),
subs AS (SELECT tree, h, row_number() OVER (ORDER BY encode(tree)) - 1 AS i, count(*) OVER () AS n FROM nodes WHERE n = 1),
tops(level, i, n, h) AS (SELECT 0, i, n, h FROM subs UNION ALL SELECT any_value(level) + 1, i // 2, (any_value(n) + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM tops WHERE n > 1 GROUP BY i // 2),
own(k, level, tree, i, pos, up, proof, folded) AS (SELECT row_number() OVER (), 0, tree, i, i, FALSE, '', shown FROM l UNION ALL
    SELECT o.k, CASE WHEN turn THEN 0 ELSE level + 1 END, tree, o.i, CASE WHEN turn THEN si ELSE pos // 2 END, up OR turn, proof || coalesce(sibling, ''),
           CASE WHEN turn THEN folded WHEN sibling IS NULL THEN sha256(folded) WHEN pos % 2 = 1 THEN sha256(sibling || folded) ELSE sha256(folded || sibling) END
    FROM (SELECT o.*, coalesce(a.n, b.n) AS n, coalesce(c.h, e.h) AS sibling, s.i AS si, NOT o.up AND a.n = 1 AS turn FROM own o JOIN subs s ON s.tree = o.tree
          LEFT JOIN nodes a ON NOT o.up AND a.level = o.level AND a.tree = o.tree AND a.i = o.pos LEFT JOIN nodes c ON NOT o.up AND c.level = o.level AND c.tree = o.tree AND c.i = xor(o.pos, 1) AND a.n > 1
          LEFT JOIN tops b ON o.up AND b.level = o.level AND b.i = o.pos LEFT JOIN tops e ON o.up AND e.level = o.level AND e.i = xor(o.pos, 1) AND b.n > 1) o WHERE turn OR n > 1),
ends AS (SELECT tree, i, arg_max(proof, (up, level)) AS proof, arg_max(folded, (up, level)) AS folded FROM own GROUP BY k, tree, i)
SELECT doc_id, leaf, s.h AS subroot, r.h AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = r.h AS verified
FROM l JOIN ends USING (tree, i) JOIN subs s USING (tree) JOIN tops r ON r.n = 1
"""
