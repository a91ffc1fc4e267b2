"""Checksums, repository addresses and changelogs as Columns, and their registration for SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Heading grammar. Dated forms first, in order.
_VERSION = r"v?[\d.]+(?:-[\w.]+)?"
DATED = (
    rf"^\[({_VERSION})\]\s*-\s*(\d{{4}}-\d{{2}}-\d{{2}})",
    rf"^({_VERSION})\s*\((\d{{4}}-\d{{2}}-\d{{2}})\)",
    rf"^({_VERSION})\s*/\s*(\d{{4}}-\d{{2}}-\d{{2}})",
    rf"^\[({_VERSION})\]\s*-\s*([A-Za-z]+\s+\d{{1,2}},\s+\d{{4}})",
    rf"^({_VERSION})\s*-\s*([A-Za-z]+\s+\d{{1,2}}\s+\d{{4}})",
)
UNDATED = (rf"^\[({_VERSION})\]$", rf"^({_VERSION})$")


def sha256_hex(x: Column) -> Column:  # J8
    return F.sha2(x, 256)


def sha512_sri(x: Column) -> Column:  # J8
    return F.concat(F.lit("sha512-"), F.base64(F.unhex(F.sha2(x, 512))))


def verify_sri(x: Column, given: Column) -> Column:  # J8
    """Whether a SHA-512 checksum fits, with or without its prefix."""
    return sha512_sri(x) == F.concat(F.lit("sha512-"), F.regexp_replace(given, "^sha512-", ""))


def repository(url: Column) -> dict[str, Column]:  # J9, J10
    """owner, repo and canonical address of a repository field (text, or JSON with a url); null unless the host ends with github.com."""
    text = F.coalesce(F.get_json_object(url, "$.url"), F.trim(url))
    text = F.regexp_replace(F.trim(text), r"^git\+", "")
    text = F.regexp_replace(F.regexp_replace(text, r"^(?:ssh://)?git@([^:/]+)[:/]", "https://$1/"), r"\.git$", "")
    form = r"^[a-z]+://([^/]*github\.com)/([^/]+)/([^/#?]+)"
    part = lambda k: F.when(text.rlike(form), F.regexp_extract(text, form, k))
    return {"owner": part(2), "repo": part(3), "canonical": F.concat(F.lit("https://github.com/"), part(2), F.lit("/"), part(3))}


def heading(line: Column) -> dict[str, Column]:  # J12, J14
    """version and date of a changelog heading; both null if the line is none."""
    trimmed = F.trim(line)
    content = F.trim(F.regexp_replace(trimmed, "^#+", ""))
    is_head = trimmed.startswith("#")
    pick = lambda k, forms: F.coalesce(*(F.when(is_head & content.rlike(p), F.regexp_extract(content, p, k)) for p in forms))
    version = F.coalesce(pick(1, DATED), pick(1, UNDATED))
    return {"version": F.regexp_replace(version, "^v+", ""), "date": pick(2, DATED)}


def segments(texts: DataFrame, key: str, text: str) -> DataFrame:  # J13
    """(key, entry_no, version, date, body) of each changelog text: entry 0 is what stands before the first heading."""
    lines = texts.select(key, F.posexplode(F.split(F.coalesce(text, F.lit("")), "\n")).alias("no", "line"))
    marked = lines.withColumns(heading(F.col("line")))
    running = Window.partitionBy(key).orderBy("no")
    numbered = marked.withColumn("entry_no", F.sum(F.when(F.col("version").isNotNull(), 1).otherwise(0)).over(running))
    body = F.trim(F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("version").isNull(), F.struct("no", "line")))), lambda x: x.line), "\n"))
    return numbered.groupBy(key, "entry_no").agg(F.max("version").alias("version"), F.max("date").alias("date"), body.alias("body"))


def register_functions(spark: SparkSession) -> None:  # L9
    """format_bytes, sha512_sri and in_range as temporary SQL functions."""
    from graphloom.functions.versions import in_range_udf

    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION format_bytes(n BIGINT) RETURNS STRING RETURN CASE WHEN n >= 1048576 THEN format_string('%.2f MB', n / 1048576.0D) WHEN n >= 1024 THEN format_string('%.1f KB', n / 1024.0D) ELSE concat(n, ' bytes') END")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION sha512_sri(x STRING) RETURNS STRING RETURN concat('sha512-', base64(unhex(sha2(x, 512))))")
    spark.udf.register("in_range", in_range_udf())
