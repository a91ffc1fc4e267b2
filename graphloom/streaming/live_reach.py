"""Reachability kept up to date over a stream of changed edges, by deleting too much and deriving again.

Edges and reached modules are logs in a shared folder: a base and, for every batch, what changed. A removed edge takes away all that may have
hung on it; what another reached module still imports comes back; added edges reach on from there. Only those modules go through the rounds,
so their number follows the change; each round looks them up in the edges. Rounds end where they have followed more than one in MANY of the
reached modules: too many in doubt make a full run over what was reached, too many found go on over the edges outside alone, written once. So a
batch costs no more than some passes over the edges and a full run. Batch n reads the state before it and overwrites its own, so that a batch that runs again after a failure gives the same.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators.fixpoints import reachable
from graphloom.storage import cut, cut_counting

#: Batches between two bases.
EVERY = 16
#: Up to this share of the reached modules a change is followed through all edges, beyond it the edges that it can follow are written first.
MANY = 64
#: Modules that a round broadcasts at most, 8 bytes each; beyond, fixpoints.reachable searches.
FRONT = 1 << 19


class Log:
    """Rows of keys under a folder: base-n holds all of them after n batches, delta-n what batch n made present or not (alive)."""

    def __init__(self, spark: SparkSession, folder: str, schema: str):
        self.spark, self.folder, self.schema = spark, folder, schema
        self.keys = spark.createDataFrame([], schema).columns

    def _load(self, name: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.folder}/{name}")

    def read(self, n: int) -> DataFrame:
        """The rows after n batches."""
        start = n - n % EVERY
        base = self._load(f"base-{start}", self.schema)
        if n == start:
            return base
        deltas = [self._load(f"delta-{k}", f"{self.schema}, alive boolean").withColumn("n", F.lit(k)) for k in range(start + 1, n + 1)]
        last = reduce(DataFrame.union, deltas).groupBy(*self.keys).agg(F.max_by("alive", "n").alias("alive"))
        return base.join(last, self.keys, "left_anti").union(last.where("alive").select(*self.keys))

    def write(self, n: int, delta: DataFrame) -> None:
        if n % EVERY:
            delta.write.mode("overwrite").parquet(f"{self.folder}/delta-{n}")
            return
        before = self.read(n - 1)
        before.join(delta, self.keys, "left_anti").union(delta.where("alive").select(*self.keys)).write.mode("overwrite").parquet(f"{self.folder}/base-{n}")

    def begin(self, rows: DataFrame) -> None:
        rows.select(*self.keys).distinct().write.parquet(f"{self.folder}/base-0")


class LiveReach:
    """The modules that entries reach, after each batch of changes (src, dst, op 'add' or 'remove', seq): of one edge the last counts."""

    def __init__(self, spark: SparkSession, folder: str, kind: str = "long"):
        self.spark, self.folder = spark, folder
        self.edges, self.reached, self.entries = (Log(spark, f"{folder}/{name}", schema) for name, schema in (("edges", f"src {kind}, dst {kind}"), ("reached", f"module_id {kind}"), ("entries", f"module_id {kind}")))

    def begin(self, entries: DataFrame, edges: DataFrame) -> None:
        """State 0: a full run."""
        self.edges.begin(edges.where("src <> dst"))  # no nulls either
        self.entries.begin(entries)
        self.reached.begin(reachable(self.entries.read(0), self.edges.read(0), plain=True))

    def after(self, n: int) -> DataFrame:
        """(module_id) reached after n batches."""
        return self.reached.read(n)

    def apply(self, changes: DataFrame, batch: int) -> None:
        """Batch number `batch` (from 0), the body of foreachBatch."""
        n = batch + 1
        old, seen, entries = self.edges.read(n - 1), cut(self.reached.read(n - 1), "seen"), self.entries.read(0)
        last = changes.where("src <> dst").groupBy("src", "dst").agg(F.max_by("op", "seq").alias("op"))
        held = last.join(old.withColumn("held", F.lit(True)), ["src", "dst"], "left").where("(op = 'add') <> coalesce(held, false)")
        delta, added = cut_counting(held.select("src", "dst", (F.col("op") == "add").alias("alive")), "changed_edges", F.col("alive"))
        self.edges.write(n, delta)
        new, most = self.edges.read(n), seen.count() // MANY
        source = lambda modules: modules.withColumnRenamed("module_id", "src")

        shaken = lambda front: front.join(seen, "module_id", "left_semi").join(entries, "module_id", "left_anti")
        lost = delta.where("not alive").join(source(seen), "src", "left_semi").select(F.col("dst").alias("module_id")).distinct()
        doubted, ended = self._rounds(shaken(lost), old, shaken, most)
        if not ended:  # too much is in doubt: from the entries again; without added edges nothing else than before can be reached
            now = cut(reachable(entries, new if added else new.join(source(seen), "src", "left_semi")), "now")
            gone, come = seen.join(now, "module_id", "left_anti"), now.join(seen, "module_id", "left_anti")
        else:
            firm = cut(seen.join(doubted, "module_id", "left_anti"), "firm")
            holds = lambda edges: edges.join(source(firm), "src", "left_semi").select(F.col("dst").alias("module_id"))
            again = holds(new.join(doubted.withColumnRenamed("module_id", "dst"), "dst", "left_semi").select("src", "dst"))
            fresh = holds(delta.where("alive").select("src", "dst"))
            open_ = lambda front: front.join(firm, "module_id", "left_anti")
            found, ended = self._rounds(open_(again.union(fresh).distinct()), new, open_, most)
            if not ended:
                outside = cut(new.join(source(firm), "src", "left_anti").join(firm.withColumnRenamed("module_id", "dst"), "dst", "left_anti"), "outside")
                found, ended = self._rounds(found, outside, lambda front: front, FRONT)
                found = found if ended else cut(reachable(found, outside, plain=True), "found")
            gone, come = doubted.join(found, "module_id", "left_anti"), found.join(seen, "module_id", "left_anti")
        self.reached.write(n, cut(gone.withColumn("alive", F.lit(False)).union(come.withColumn("alive", F.lit(True))), "changed_modules"))

    def _rounds(self, front: DataFrame, edges: DataFrame, allowed, most: int) -> tuple[DataFrame, bool]:
        """front and what follows it over edges, as far as `allowed` lets it, and whether that is all; else more than `most` were found before the end."""
        front, size = cut_counting(front, "front", F.lit(True))
        found, total = front, size
        while size and total <= most:
            near = F.broadcast(front) if size <= FRONT else front
            step = near.join(edges, near["module_id"] == edges["src"]).select(F.col("dst").alias("module_id")).distinct()
            front, size = cut_counting(allowed(step).join(found, "module_id", "left_anti"), "front", F.lit(True))
            found, total = cut(found.union(front), "found"), total + size
        return found, not size

    def start(self, changes: DataFrame, checkpoint: str):
        """Run over what a stream of changes has, and stop."""
        return changes.writeStream.foreachBatch(lambda df, batch: self.apply(df, batch)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
