"""Registry answers, releases and other tools' output from saved tables and files; nothing here reaches a network."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.registry import repository

#: Names a changelog goes by, in the order they are tried.
CHANGELOGS = ("CHANGELOG.md", "CHANGELOG", "CHANGES.md", "CHANGES", "HISTORY.md", "HISTORY", "NEWS.md", "NEWS", "RELEASES.md", "RELEASES")


def latest(answers: DataFrame) -> DataFrame:  # A21
    """(registry, package, version, license, owner, repo) of saved answers (registry, package, body): null version where there is no answer.

    A JSR answer without a latest version says 'unknown'.
    """
    get = lambda path: F.get_json_object("body", path)
    version = F.when(F.col("registry") == "npm", get("$['dist-tags'].latest")).when(F.col("registry") == "crates.io", get("$.crate.max_version")).when(F.col("registry") == "jsr", F.coalesce(get("$.latest"), F.lit("unknown")))
    license_ = F.coalesce(get("$.license.type"), get("$.license"))  # J11
    address = F.coalesce(get("$.repository.url"), get("$.repository"), get("$.crate.repository"))
    parts = repository(address)
    return answers.select("registry", "package", F.when(F.col("body").isNotNull(), version).alias("version"), license_.alias("license"), parts["owner"].alias("owner"), parts["repo"].alias("repo"))


def changelog(files: DataFrame) -> DataFrame:  # A22
    """The first existing changelog of each repository in files (repo, name, content)."""
    rank = F.array_position(F.array(*(F.lit(x) for x in CHANGELOGS)), F.col("name"))
    return files.withColumn("rank", rank).where("rank > 0").groupBy("repo").agg(F.min_by("name", "rank").alias("name"), F.min_by("content", "rank").alias("content"))


def releases(answers: DataFrame) -> DataFrame:  # A22
    """(repo, tag, name, published_at, prerelease) of saved release lists (repo, body); dates stay text."""
    form = "array<struct<tag_name:string,name:string,published_at:string,prerelease:boolean>>"
    return answers.select("repo", F.explode(F.from_json("body", form)).alias("r")).select("repo", F.col("r.tag_name").alias("tag"), "r.name", "r.published_at", F.coalesce("r.prerelease", F.lit(False)).alias("prerelease"))


def own_output(documents: DataFrame) -> DataFrame:  # A27
    """(type, path, name) of this engine's reports (content): an object with findings."""
    form = "struct<findings:array<struct<type:string,path:string,module:string,name:string,export_name:string>>>"
    rows = documents.select(F.explode(F.from_json("content", form)["findings"]).alias("f"))
    return rows.select("f.type", F.coalesce("f.path", "f.module").alias("path"), F.coalesce("f.name", "f.export_name").alias("name"))


def other_output(documents: DataFrame) -> DataFrame:  # A27
    """(type, path, name) of another tool's reports (content): unused files, and the exports and dependencies of each issue."""
    form = "struct<files:array<string>,issues:array<struct<file:string,exports:array<struct<name:string>>,dependencies:array<struct<name:string>>>>>"
    parsed = documents.select(F.from_json("content", form).alias("j"))
    files = parsed.select(F.lit("unreachable_file").alias("type"), F.explode("j.files").alias("path")).withColumn("name", F.lit(None).cast("string"))
    issues = parsed.select(F.explode("j.issues").alias("i"))
    named = lambda kind, field: issues.select(F.lit(kind).alias("type"), F.col("i.file").alias("path"), F.explode(f"i.{field}").alias("e")).select("type", "path", F.col("e.name").alias("name"))
    return files.unionByName(named("unused_export", "exports")).unionByName(named("unused_npm_dependency", "dependencies"))


def any_output(documents: DataFrame) -> DataFrame:  # A27
    """(type, path, name) of reports (content) of either tool and of shapes in between, read as variants; texts that are no JSON give nothing.

    Findings, files, issues and their exports and dependencies may each be missing, or lists of names or of objects.
    """
    docs = documents.select(F.try_parse_json("content").alias("v")).where("v is not null")
    text = lambda v, path="$": F.when(F.schema_of_variant(F.try_variant_get(v, path, "variant")) == "STRING", F.try_variant_get(v, path, "string"))
    each = lambda df, path, keep=(): df.select(*keep, F.explode(F.try_variant_get("v", path, "array<variant>")).alias("v"))
    named = lambda field: F.coalesce(text("v"), text("v", f"$.{field}"))
    own = each(docs, "$.findings").select(text("v", "$.type").alias("type"), F.coalesce(text("v", "$.path"), text("v", "$.module")).alias("path"), F.coalesce(text("v", "$.name"), text("v", "$.export_name")).alias("name"))
    files = each(docs, "$.files").select(F.lit("unreachable_file").alias("type"), named("path").alias("path"), F.lit(None).cast("string").alias("name"))
    issues = each(docs, "$.issues").select(text("v", "$.file").alias("path"), "v")
    parts = [each(issues, f"$.{field}", ("path",)).select(F.lit(kind).alias("type"), "path", named("name").alias("name")) for kind, field in (("unused_export", "exports"), ("unused_npm_dependency", "dependencies"))]
    return own.union(files).union(parts[0]).union(parts[1]).where("type is not null and (path is not null or name is not null)")


def text_output(lines: DataFrame) -> DataFrame:  # A27
    """Lines (value) of any tool's text that speak of something unused or dead."""
    return lines.where(F.lower("value").rlike("unused|dead"))
