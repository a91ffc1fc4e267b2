"""Versions as sortable structs, requirement ranges, and the class of an update, in Columns."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TRIPLE = r"^v?(\d+)\.(\d+)\.(\d+)(?:-([0-9A-Za-z.-]+))?(?:\+[0-9A-Za-z.-]+)?$"


def parse(version: Column) -> Column:  # J5
    """(major, minor, patch, is_release, pre) or null; structs compare in the order of versions. Numeric parts of a prerelease are padded."""
    part = lambda k: F.regexp_extract(version, TRIPLE, k)
    number = lambda k: F.try_to_number(part(k), F.lit("999999999999")).cast("long")
    padded = F.array_join(F.transform(F.split(part(4), r"\."), lambda x: F.when(x.rlike(r"^\d+$"), F.concat(F.lit("0"), F.lpad(x, 12, "0"))).otherwise(F.concat(F.lit("1"), x))), ".")
    return F.when(version.rlike(TRIPLE), F.struct(number(1).alias("major"), number(2).alias("minor"), number(3).alias("patch"), (part(4) == "").alias("is_release"), F.when(part(4) == "", "").otherwise(padded).alias("pre")))


def strip_requirement(req: Column) -> Column:  # J7
    """Without one leading ^, ~ or >=."""
    return F.regexp_replace(req, r"^(\^|~|>=)", "")


def update_type(current: Column, latest: Column, compat: bool = False) -> Column:  # J6
    """Major, Minor, Patch or None. A downgrade is None; with compat the three numbers are tested one by one, so that it may be Minor or Patch."""
    a, b = parse(current), parse(latest)
    by_part = F.when(b.major > a.major, "Major").when(b.minor > a.minor, "Minor").when(b.patch > a.patch, "Patch").otherwise("None")
    known = a.isNotNull() & b.isNotNull()
    return F.when(known & (F.lit(True) if compat else b > a), by_part).otherwise("None")


def satisfies(version: Column, req: Column) -> Column:  # J4
    """Whether a version lies in a requirement of the forms ^x.y.z, ~x.y.z, >=x.y.z, =x.y.z, x.y.z, *; null for other forms. Prereleases only satisfy one of the same triple."""
    text = F.trim(req)
    base = parse(F.trim(F.regexp_replace(text, r"^(\^|~|>=|=)", "")))
    v = parse(version)
    same = (v.major == base.major) & (v.minor == base.minor) & (v.patch == base.patch)
    pre = v.is_release | (same & ~base.is_release)
    caret = F.when(base.major > 0, v.major == base.major).when(base.minor > 0, (v.major == 0) & (v.minor == base.minor)).otherwise(same)
    inside = F.when(text.startswith("^"), (v >= base) & caret).when(text.startswith("~"), (v >= base) & (v.major == base.major) & (v.minor == base.minor)).when(text.startswith(">="), v >= base).otherwise(v == base)
    return F.when(text == "*", v.is_release).when(base.isNotNull() & v.isNotNull(), inside & pre)


# --- ranges as intervals -----------------------------------------------------------------------

KEY = "struct<major:bigint,minor:bigint,patch:bigint,is_release:boolean,pre:string>"


def _key(major: Column, minor: Column, patch: Column, is_release: Column, pre: Column) -> Column:
    return F.struct(major.cast("long").alias("major"), minor.cast("long").alias("minor"), patch.cast("long").alias("patch"), is_release.alias("is_release"), pre.alias("pre"))


def _least() -> Column:
    return _key(F.lit(0), F.lit(0), F.lit(0), F.lit(False), F.lit(""))


def _beyond() -> Column:
    return _key(F.lit((1 << 63) - 1), F.lit(0), F.lit(0), F.lit(True), F.lit(""))


def _comparator(token: Column) -> Column:
    """(ok, lo, hi, pre) of one comparator: the half-open interval of keys it admits, and its triple if it names a prerelease."""
    form = r"^(\^|~|>=|<=|>|<|=)?\s*v?([^-]*)(?:-(.*))?$"
    op, pre = F.regexp_extract(token, form, 1), F.regexp_extract(token, form, 3)
    parts = F.filter(F.split(F.regexp_extract(token, form, 2), r"\."), lambda x: ~x.isin("x", "X", "*", ""))
    n = F.size(parts)
    at = lambda k: F.coalesce(F.try_to_number(F.try_element_at(parts, F.lit(k + 1)), F.lit("999999999999")).cast("long"), F.lit(0))
    padded = F.array_join(F.transform(F.split(pre, r"\."), lambda x: F.when(x.rlike(r"^\d+$"), F.concat(F.lit("0"), F.lpad(x, 12, "0"))).otherwise(F.concat(F.lit("1"), x))), ".")
    tag = F.when(pre == "", "").otherwise(padded)
    low = _key(at(0), at(1), at(2), pre == "", tag)
    after = _key(at(0), at(1), at(2), pre == "", F.concat(tag, F.lit("\0")))  # the next key: nothing lies between
    lowest = lambda a, b, c: _key(a, b, c, F.lit(False), F.lit(""))  # noqa: E731  below every prerelease of the triple
    upper = lambda k: F.when(k == 0, lowest(at(0) + 1, F.lit(0), F.lit(0))).when(k == 1, lowest(at(0), at(1) + 1, F.lit(0))).otherwise(lowest(at(0), at(1), at(2) + 1))
    last = n - 1
    fixed = F.when(at(0) > 0, F.lit(0)).when(at(1) > 0, F.lit(1)).when(at(2) > 0, F.lit(2)).otherwise(last)  # the first part that is not zero
    whole = n == 3
    lo = F.when(n == 0, _least()).when(op.isin("<", "<="), _least()).when(op == ">", F.when(whole, after).otherwise(upper(last))).otherwise(low)
    hi = F.when(n == 0, _beyond()).when(op.isin(">", ">="), _beyond()).when(op == "<", low).when(op == "<=", F.when(whole, after).otherwise(upper(last)))
    hi = hi.when(op == "^", upper(fixed)).when(op == "~", upper(F.least(last, F.lit(1)))).otherwise(F.when(whole, after).otherwise(upper(last)))
    ok = F.forall(parts, lambda x: x.rlike(r"^\d+$")) & (n <= 3)
    return F.struct(ok.alias("ok"), lo.alias("lo"), hi.alias("hi"), F.when((pre != "") & (n > 0), F.struct(at(0).alias("major"), at(1).alias("minor"), at(2).alias("patch"))).alias("pre"))


def intervals(req: Column) -> Column:  # J4
    """A requirement as an array of (lo, hi, pres), sorted: half-open intervals of version keys, and the triples whose prereleases each admits; null if it can't be read.

    Or-groups, hyphens, partial and x-ranges, ^ and ~. A group of comparators is the intersection of their intervals; empty ones go.
    """
    hyphens = F.regexp_replace(req, r"(\S+)\s+-\s+(\S+)", ">=$1 <=$2")
    groups = F.transform(F.split(hyphens, r"\|\|"), lambda g: F.transform(F.regexp_extract_all(g, F.lit(r"(\^|~|>=|<=|>|<|=)?\s*([^\s,<>=^~]+)"), F.lit(0)), _comparator))
    met = F.transform(groups, lambda g: F.struct(F.coalesce(F.array_max(F.transform(g, lambda c: c.lo)), _least()).alias("lo"), F.coalesce(F.array_min(F.transform(g, lambda c: c.hi)), _beyond()).alias("hi"), F.filter(F.transform(g, lambda c: c.pre), lambda x: x.isNotNull()).alias("pres")))
    return F.when(F.forall(groups, lambda g: F.forall(g, lambda c: c.ok)), F.sort_array(F.filter(met, lambda i: i.lo < i.hi)))


def in_intervals(version: Column, ranges: Column) -> Column:
    """Whether a parsed version lies in one of the intervals; a prerelease also needs its own triple named there. Null if either is."""
    triple = F.struct(version.major.alias("major"), version.minor.alias("minor"), version.patch.alias("patch"))
    inside = F.exists(ranges, lambda i: (version >= i.lo) & (version < i.hi) & (version.is_release | F.array_contains(i.pres, triple)))
    return F.when(version.isNotNull() & ranges.isNotNull(), inside)


def admits(version: Column, req: Column) -> Column:  # J4
    """The whole range grammar over text columns."""
    return in_intervals(parse(version), intervals(req))


def best_satisfying(requirements: DataFrame, published: DataFrame) -> DataFrame:  # E12
    """requirements (package, req) with best, the highest published (package, version) that each admits, or null.

    An as-of join: the ends of all intervals and the versions of a package go in one order, where each end sees the last release before it;
    no pairs of requirements and versions are made. Prereleases are only admitted by a triple, so those come by an equi-join on it.
    """
    asked = requirements.select("package", "req").distinct().withColumn("i", F.explode_outer(intervals(F.col("req")))).select("package", "req", "i.*")
    have = published.select("package", "version").distinct().withColumn("key", parse(F.col("version"))).where("key is not null")
    ends = asked.where("lo is not null").select("package", F.col("hi").alias("key"), F.lit(0).alias("side"), "req", "lo", F.lit(None).cast("string").alias("version"))
    releases = have.where("key.is_release").select("package", "key", F.lit(1).alias("side"), F.lit(None).cast("string").alias("req"), F.lit(None).cast(KEY).alias("lo"), "version")
    order = Window.partitionBy("package").orderBy("key", "side").rowsBetween(Window.unboundedPreceding, 0)  # an end comes before a version of the same key
    seen = ends.union(releases).withColumn("last", F.last(F.when(F.col("side") == 1, F.struct("key", "version")), ignorenulls=True).over(order))
    found = seen.where("side = 0 and last.key >= lo").select("package", "req", F.col("last.key").alias("key"), F.col("last.version").alias("version"))
    named = asked.select("package", "req", "lo", "hi", F.explode("pres").alias("triple"))
    tagged = have.where("not key.is_release").withColumn("triple", F.struct(F.col("key.major").alias("major"), F.col("key.minor").alias("minor"), F.col("key.patch").alias("patch")))
    found = found.union(named.join(tagged, ["package", "triple"]).where("key >= lo and key < hi").select("package", "req", "key", "version"))
    best = found.groupBy("package", "req").agg(F.max(F.struct("key", "version"))["version"].alias("best"))
    return requirements.join(best, ["package", "req"], "left")


# --- one range at a time: for the driver, and as a function of SQL text ---------------------------


def parse_local(version: str) -> tuple | None:
    """parse() for the driver."""
    m = re.match(TRIPLE, version)
    if not m:
        return None
    pre = m[4] or ""
    return (*(int(m[k]) for k in (1, 2, 3)), not pre, ".".join("0" + x.zfill(12) if x.isdigit() else "1" + x for x in pre.split(".")) if pre else "")


def _comparators(text: str) -> list[tuple[str, tuple]] | None:
    """One and-group of a range as (operator, version) pairs."""
    text = text.strip()
    hyphen = re.fullmatch(r"(\S+)\s+-\s+(\S+)", text)
    if hyphen:
        text = f">={hyphen[1]} <={hyphen[2]}"
    out: list[tuple[str, tuple]] = []
    for op, body in re.findall(r"(\^|~|>=|<=|>|<|=)?\s*([^\s,<>=^~]+)", text):
        body, _, pre = body.partition("-")
        parts = [x for x in body.lstrip("v").split(".") if x not in ("x", "X", "*", "")]
        if not all(x.isdigit() for x in parts) or len(parts) > 3:
            return None
        n = [int(x) for x in parts]
        low = (*(n + [0, 0, 0])[:3], not pre, ".".join("0" + x.zfill(12) if x.isdigit() else "1" + x for x in pre.split(".")) if pre else "")
        upper = lambda k, n=n: tuple([*n[:k], n[k] + 1, *[0] * (2 - k)]) + (False, "")
        if not n:
            out.append((">=", (0, 0, 0, False, "")))
        elif op == "^":
            k = next((i for i, x in enumerate(n) if x), len(n) - 1)
            out += [(">=", low), ("<", upper(k))]
        elif op == "~":
            out += [(">=", low), ("<", upper(min(1, len(n) - 1)))]
        elif op in (">=", "<") or len(n) == 3 and op:
            out.append((op, low))
        elif op == ">":
            out.append((">=", upper(len(n) - 1)))
        elif op == "<=":
            out.append(("<", upper(len(n) - 1)))
        elif len(n) < 3:
            out += [(">=", low), ("<", upper(len(n) - 1))]
        else:
            out.append(("=", low))
    return out


def in_range(version: str, req: str) -> bool | None:  # J4
    """The whole range grammar: or-groups, hyphens, partial and x-ranges. None if either side can't be read."""
    v = parse_local(version)
    groups = [_comparators(g) for g in req.split("||")]
    if v is None or any(g is None for g in groups):
        return None
    test = {">=": lambda a, b: a >= b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, "<": lambda a, b: a < b, "=": lambda a, b: a == b}
    return any(all(test[op](v, x) for op, x in g) and (v[3] or any(x[:3] == v[:3] and not x[3] and x[4] for _, x in g)) for g in groups)


def in_range_udf():
    """in_range over Arrow batches, for ranges that satisfies() can't read."""
    import pandas as pd

    def run(version, req):
        return pd.Series([in_range(a, b) if a is not None and b is not None else None for a, b in zip(version, req, strict=True)], dtype="object")

    run.__annotations__ = {"version": pd.Series, "req": pd.Series, "return": pd.Series}  # as objects: annotations are strings in this module
    return F.pandas_udf(run, "boolean")
