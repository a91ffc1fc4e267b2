"""Code smells in one scan of the symbols, and symbol, member and enum statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Smell, kind, metric, default threshold, largest threshold, message part, advice.
SMELLS = (
    ("LongFunction", "Function", "line_count", 50, 10000, "has %d lines", "Extract logical sections into separate functions"),
    ("TooManyParameters", "Function", "parameter_count", 4, 20, "has %d parameters", "Use options object to reduce parameter count"),
    ("LargeClass", "Class", "line_count", 300, 50000, "has %d lines", "Consider splitting into smaller, focused classes"),
    ("TooManyMethods", "Class", "method_count", 20, 200, "has %d methods", "Consider splitting into smaller classes or using composition"),
    ("TooManyFields", "Class", "field_count", 10, 100, "has %d fields", "Group related fields into separate objects or split the class"),
    ("ComplexConditional", "Function", "complexity", 10, 100, "has cyclomatic complexity of %d", "Break down into smaller functions with single responsibilities"),
    ("DeepNesting", "Function", "max_nesting_depth", 4, 20, "has nesting depth of %d", "Use early returns or extract nested logic into separate functions"),
    ("MultipleReturns", "Function", "return_count", 3, 20, "has %d return statements", "Refactor to use single return point or reduce control flow complexity"),
)
#: Symbol kinds that keep their name; any other is a Variable.
KINDS = ("Function", "Variable", "Class", "Parameter", "TypeAlias", "Interface", "Enum")
MEMBER_KINDS = {"ClassMethod": "Method", "ClassProperty": "Property", "ClassGetter": "Getter", "ClassSetter": "Setter", "ClassConstructor": "Constructor"}


def thresholds(given: dict[str, int] | None = None) -> dict[str, int]:  # D31, L7
    """Defaults with what is given; each must be above 0 and at most its largest."""
    out = {name: default for name, _, _, default, _, _, _ in SMELLS} | (given or {})
    largest = {name: most for name, _, _, _, most, _, _ in SMELLS}
    for name, value in out.items():
        if name not in largest:
            raise ValueError(f"no such smell: {name}")
        if not 0 < value <= largest[name]:
            raise ValueError(f"{name}: {value} is not in 1..{largest[name]}")
    return out


def symbol_kind(raw: Column) -> Column:  # C3
    return F.when(raw.isin(*KINDS), raw).otherwise("Variable")


def member_kind(raw: Column) -> Column:  # C5
    table = F.create_map(*(F.lit(x) for kv in MEMBER_KINDS.items() for x in kv))
    return F.coalesce(F.try_element_at(table, raw), F.lit("Method"))


def smells(symbols: DataFrame, limits: dict[str, int] | None = None, more: tuple[str, ...] = ()) -> DataFrame:  # K1-K8, C10, J20
    """One row for each metric over its threshold: path, name, line, smell, value, limit, severity, message, advice, and `more` columns of the symbols."""
    limits = thresholds(limits)
    found = []
    for name, kind, metric, _, _, said, advice in SMELLS:
        message = F.format_string(f"{kind} '%s' {said} (recommended: {limits[name]})", F.col("name"), F.col(metric))
        hit = (F.col("kind") == kind) & (F.col(metric) > limits[name])
        found.append(F.when(hit, F.struct(F.lit(name).alias("smell"), F.col(metric).alias("value"), F.lit(limits[name]).alias("threshold"), message.alias("message"), F.lit(advice).alias("advice"))))
    each = symbols.where(~F.col("path").startswith("virtual:")).select("path", "symbol_id", "name", "line", *more, F.explode(F.filter(F.array(*found), lambda x: x.isNotNull())).alias("s"))
    return each.select("path", "symbol_id", "name", "line", *more, "s.*", F.lit("Warning").alias("severity"))


def smell_stats(found: DataFrame) -> DataFrame:  # F1
    """Counts by smell and by severity in one pass: (dimension, value, n)."""
    grouped = found.groupingSets([["smell"], ["severity"]], "smell", "severity").agg(F.count("*").alias("n"), F.grouping("smell").alias("by_severity"))
    return grouped.select(F.when(F.col("by_severity") == 1, "severity").otherwise("smell").alias("dimension"), F.coalesce("smell", "severity").alias("value"), "n")


def unused_symbols(symbols: DataFrame, *more: str) -> DataFrame:  # G5, D21
    return symbols.where("not is_used and not is_exported and not startswith(name, '_') and not startswith(path, 'virtual:')").select("path", "symbol_id", "name", "kind", "line", *more)


def symbol_stats(symbols: DataFrame) -> DataFrame:  # F9
    return symbols.groupBy("kind").agg(F.count("*").alias("total"), F.count_if(~F.col("is_used")).alias("unused"))


def unused_members(symbols: DataFrame, *more: str) -> DataFrame:  # G7, F6
    """Unused members of classes: those with a leading underscore and those of virtual modules are not reported."""
    rows = symbols.where("not is_used").withColumn("member", member_kind(F.col("member_kind")))
    return rows.where("not startswith(name, '_') and not startswith(path, 'virtual:')").select("path", "owner", "name", "member", "visibility", *more)


def member_stats(symbols: DataFrame) -> DataFrame:  # F6
    """Totals over all unused members, before names and paths are filtered."""
    return symbols.where("not is_used").groupBy(member_kind(F.col("member_kind")).alias("member")).agg(F.count("*").alias("unused"), F.count_if(F.col("visibility") == "private").alias("private"), F.count_distinct("owner").alias("classes"))


def enum_value(raw: Column) -> dict[str, Column]:  # C6
    """Number, String (without its quotes) or Computed."""
    number, text = raw.rlike(r"^-?\d+(\.\d+)?$"), raw.rlike("^\"[^\"]*\"$")
    return {"value_kind": F.when(number, "Number").when(text, "String").otherwise("Computed"), "value": F.when(number, raw).when(text, F.substring(raw, F.lit(2), F.length(raw) - 2))}


def unused_enum_members(symbols: DataFrame, *more: str) -> DataFrame:  # G8
    rows = symbols.where("not is_used and not startswith(name, '_') and not startswith(path, 'virtual:')")
    return rows.withColumns(enum_value(F.col("enum_value"))).select("path", "owner", "name", "value_kind", "value", *more)


def enum_stats(symbols: DataFrame) -> DataFrame:  # F7
    """Enums and members count only enums with unused members; unused members count after the filters."""
    kept = F.expr("not startswith(name, '_') and not startswith(path, 'virtual:')")
    return symbols.where("not is_used").agg(F.count_distinct("module_id", "owner").alias("total_enums"), F.count("*").alias("total_members"), F.count_if(kept).alias("unused_members"))
