"""Dependencies: unused packages, coverage, update recommendations, nearest manifests, workspaces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.text import package_name
from graphloom.functions.versions import parse, satisfies, strip_requirement, update_type

#: Manifest sections and dependency types.
SECTIONS = {"dependencies": "Runtime", "devDependencies": "Development", "peerDependencies": "Peer", "optionalDependencies": "Optional"}


def used_packages(imports: DataFrame) -> DataFrame:
    return imports.where("is_external").select(package_name(F.col("source")).alias("package")).distinct()


def unused_packages(declared: DataFrame, imports: DataFrame, with_peer: bool = False) -> DataFrame:  # G9
    """Declared packages that no external import names; development ones count, peer ones do not unless asked."""
    rows = declared if with_peer else declared.where("dep_type <> 'Peer'")
    return rows.join(used_packages(imports), "package", "left_anti").select("package", "dep_type")


def coverage(declared: DataFrame, imports: DataFrame) -> DataFrame:  # F8, G10
    """Declared, used, unused and percentage by type, and over all of them under 'total'."""
    used = used_packages(imports).withColumn("used", F.lit(1))
    rows = declared.join(used, "package", "left")
    out = rows.rollup("dep_type").agg(F.count("*").alias("declared"), F.count("used").alias("used"))
    return out.select(F.coalesce("dep_type", F.lit("total")).alias("dep_type"), "declared", "used", (F.col("declared") - F.col("used")).alias("unused"), F.round(F.col("used") * 100.0 / F.col("declared"), 4).alias("percent"))


def updates(declared: DataFrame, latest: DataFrame, compat: bool = False) -> DataFrame:  # E12, J6, J7
    """Each dependency outside a workspace beside the registry's latest version: update type, and whether the requirement admits it."""
    rows = declared.where(~F.col("workspace")).join(latest, "dep_no")
    current = strip_requirement(F.col("version_req"))
    return rows.select("dep_no", "package", "dep_type", "version_req", F.col("version").alias("latest"), update_type(current, F.col("version"), compat).alias("update_type"), satisfies(F.col("version"), F.col("version_req")).alias("satisfied"))


def safe_updates(rows: DataFrame) -> DataFrame:  # D37
    return rows.where(F.col("update_type").isin("Minor", "Patch"))


def breaking_updates(rows: DataFrame) -> DataFrame:  # D37
    return rows.where("update_type = 'Major'")


def version_order(versions: DataFrame, key: str, column: str) -> DataFrame:  # J5
    """Ranks of versions, equal ones alike, those that can't be read last."""
    from pyspark.sql import Window

    distinct = versions.select(column).distinct().withColumn("sort", parse(F.col(column)))
    ranks = distinct.withColumn("rank", F.dense_rank().over(Window.orderBy(F.col("sort").asc_nulls_last())))  # a row a distinct version
    return versions.join(ranks.select(column, "rank"), column).select(key, column, "rank")


def manifest_rows(manifests: DataFrame) -> DataFrame:  # A9
    """(path, name, version, package, version_req, dep_type) of package manifests (path, content); name and version are mandatory."""
    fields = ", ".join(f"{s} map<string,string>" for s in SECTIONS)
    parsed = manifests.select("path", F.from_json("content", f"name string, version string, main string, module string, {fields}").alias("m")).where("m.name is not null and m.version is not null")
    parts = F.concat(*(_section(s, t) for s, t in SECTIONS.items()))
    return parsed.select("path", "m.name", "m.version", F.explode(parts).alias("d")).select("path", "name", "version", "d.*")


def _section(section: str, kind: str) -> Column:
    entries = F.coalesce(F.map_entries(F.col(f"m.{section}")), F.array().cast("array<struct<key:string,value:string>>"))
    return F.transform(entries, lambda e: F.struct(e.key.alias("package"), e.value.alias("version_req"), F.lit(kind).alias("dep_type")))


def apply_updates(declared: DataFrame, wanted: DataFrame) -> DataFrame:  # B6, E13
    """The manifest with new requirements where (package, dep_type, new_req) asks for one; old and new side by side."""
    return declared.join(wanted, ["package", "dep_type"], "left").select("package", "dep_type", F.col("version_req").alias("old_req"), F.coalesce("new_req", "version_req").alias("new_req"), F.col("new_req").isNotNull().alias("changed"))


def nearest_manifest(paths: DataFrame, manifests: DataFrame) -> DataFrame:  # E16
    """Each path's nearest directory upward that has a manifest (folder): paths' distinct directories are exploded to their ancestors and joined."""
    folder = F.regexp_replace(F.col("path"), "/[^/]*$", "")
    rows = paths.withColumn("folder", F.when(F.col("path").contains("/"), folder).otherwise(""))
    parts = F.split("folder", "/")
    ups = F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/")))
    above = rows.select("folder").distinct().select("folder", F.explode(F.array_distinct(ups)).alias("up"))
    near = above.join(manifests.select(F.col("folder").alias("up")).distinct(), "up").groupBy("folder").agg(F.max_by("up", F.length("up")).alias("manifest_folder"))
    return rows.join(near, "folder", "left").select("path", "manifest_folder")


def member_enabled(name: Column, enabled: Column, disabled: Column) -> Column:  # D35
    """A member named in disabled is off; else an allow-list, if there is one, decides."""
    return F.when(F.array_contains(disabled, name), False).when(F.size(enabled) > 0, F.array_contains(enabled, name)).otherwise(True)


def find_dependency(declared: DataFrame, name: str) -> DataFrame:  # C14
    """The first declaration of a package, by dependency type."""
    return declared.where(F.col("package") == name).orderBy("dep_type", "version_req").limit(1)


def first_declarations(declared: DataFrame) -> DataFrame:  # C14
    """find_dependency() for every package at once."""
    return declared.groupBy("package").agg(F.min(F.struct("dep_type", "version_req")).alias("d"), F.count("*").alias("declarations")).select("package", "d.*", "declarations")
