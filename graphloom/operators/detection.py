"""Framework detection: weighted evidence from imports, paths and manifests, with suppression and ranking.

Detection rules are a small table from rule files; each becomes a literal condition, so evidence is one scan of each input and no join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.text import glob_to_regex
from graphloom.sources.rule_files import Detection, RuleFile


def _condition(d: Detection, value: Column) -> Column:
    if d.type == "import":
        return value.rlike(d.pattern)
    if d.type == "package_dependency":
        return value == d.pattern
    if d.type == "file_extension":
        return F.regexp_extract(value, r"\.([^./]+)$", 1) == d.pattern.removeprefix(".")
    return value.rlike(glob_to_regex(d.pattern if d.pattern.startswith("**/") else f"**/{d.pattern}", star_crosses=False))


def evidence(values: DataFrame, column: str, kinds: tuple[str, ...], files: list[RuleFile]) -> DataFrame:  # E9
    """A row for each value and detection rule that holds: framework, type, pattern, weight. Repeated values count repeatedly."""
    rules = [d for f in files for d in f.detections if d.type in kinds]
    hits = [F.when(_condition(d, F.col(column)), F.struct(F.lit(d.framework).alias("framework"), F.lit(d.type).alias("type"), F.lit(d.pattern).alias("pattern"), F.lit(d.weight).alias("weight"))) for d in rules]
    return values.select(F.explode(F.filter(F.array(*hits), lambda x: x.isNotNull())).alias("e")).select("e.*")


def confidence(found: DataFrame) -> DataFrame:  # F10, F11
    """Of each framework: capped sum of weights (six digits), hits, and the distinct evidence."""
    return found.groupBy("framework").agg(
        F.round(F.least(F.lit(1.0), F.sum("weight")), 6).alias("confidence"), F.count("*").alias("hits"),
        F.array_join(F.sort_array(F.collect_set(F.concat_ws(":", "type", "pattern"))), ", ").alias("evidence"),
    )


def suppress(detected: DataFrame, files: list[RuleFile]) -> DataFrame:  # I5
    """Without the frameworks that another detected one suppresses."""
    spark = detected.sparkSession
    pairs = spark.createDataFrame([(f.framework, s) for f in files for s in f.suppresses], "framework string, suppressed string")
    gone = detected.select("framework").join(pairs, "framework").select(F.col("suppressed").alias("framework"))
    return detected.join(gone, "framework", "left_anti")


def ranked(detected: DataFrame, files: list[RuleFile]) -> DataFrame:  # H3
    """With priority and rank: priority descending, confidence descending, then name."""
    spark = detected.sparkSession
    table = spark.createDataFrame([(f.framework, f.priority) for f in files], "framework string, priority int")
    rows = detected.join(table, "framework", "left").withColumn("priority", F.coalesce("priority", F.lit(0)))
    from pyspark.sql import Window

    # one row a framework
    return rows.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("priority"), F.desc("confidence"), "framework")))


def detect(imports: DataFrame, paths: DataFrame, files: list[RuleFile]) -> DataFrame:  # F18
    """Frameworks detected from imports (source) or paths (path); suppression works within each, then the two are united."""
    by_import = suppress(confidence(evidence(imports, "source", ("import",), files)), files)
    by_path = suppress(confidence(evidence(paths, "path", ("file_path", "file_extension"), files)), files)
    return by_import.select("framework").union(by_path.select("framework")).distinct()


def export_framework(rows: DataFrame, files: list[RuleFile]) -> DataFrame:  # G18
    """Adds framework to rows (imports ARRAY<STRUCT<source, ...>>, path): the best by imports, else the best by path, else Unknown."""
    order = sorted(files, key=lambda f: (-f.priority, f.framework))

    def first(kinds, test):
        case = F.lit(None).cast("string")
        for f in reversed(order):
            any_ = F.lit(False)
            for d in f.detections:
                if d.type in kinds:
                    any_ = any_ | test(d)
            case = F.when(any_, f.framework).otherwise(case)
        return case

    by_import = first(("import",), lambda d: F.exists("imports", lambda i: _condition(d, i.source)))
    by_path = first(("file_path", "file_extension"), lambda d: _condition(d, F.col("path")))
    return rows.withColumn("framework", F.coalesce(by_import, by_path, F.lit("Unknown")))
