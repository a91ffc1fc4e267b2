"""First match of many glob patterns: the patterns are a table with an index of the text they require, not a condition each.

A pattern's required text is what stands outside its wildcards and braces. Where that holds a whole word (between slashes, dots or ends) or the
head of one, the one that fewest patterns share is its key, of any length, so that many patterns share no key. Others have a piece of their text
(three characters, or fewer where it has fewer). A path can only match a pattern whose key it holds, so candidates come by an equi-join on
keys, are tested by their regular expressions, and the least number wins. Patterns without any text have the empty key.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.text import glob_to_regex
from graphloom.operators.report import grams
from graphloom.storage import cut, spread

PIECES = (3, 2, 1, 0)
#: Heads of words are keys up to this length; keys and words meet by the first character's hash, of so many values.
MOST_HEAD, MARKS = 16, 256
#: A word holds none of these: slash, dot, and what an expression's end may stand before.
WORD = r"[^/.\n\r\x{85}\x{2028}\x{2029}]+"


def _regexes(batches):
    for rows in batches:
        yield pd.DataFrame({"idx": rows["idx"], "pattern": rows["pattern"], "regex": [glob_to_regex(x) for x in rows["pattern"]]})


def pattern_index(patterns: DataFrame) -> DataFrame:
    """(idx, pattern, regex, kind, size, key) of patterns (idx, pattern); null and empty ones match nothing and are left out."""
    rows = spread(patterns.where("pattern <> ''").select(F.col("idx").cast("long").alias("idx"), "pattern"))

    def outside(text):  # braces as a wildcard, innermost first; what is nested deeper stays unindexed
        for _ in range(4):
            text = F.regexp_replace(text, r"\{[^{}]*\}", "*")
        return F.when(text.rlike(r"[{}]"), "").otherwise(text)

    marked = outside(F.regexp_replace(F.regexp_replace("pattern", r"(?<=^|/)\*\*/", "/"), r"\*\*/", "*"))  # '**/' begins a word, of the path or after a slash
    runs = F.transform(F.regexp_extract_all(marked, F.lit(WORD), F.lit(0)), lambda x: F.struct(x.rlike("[*?]").alias("open"), F.regexp_extract(x, "^[^*?]*", 0).alias("text")))
    words = F.transform(F.filter(runs, lambda x: x["text"] != ""), lambda x: F.when(x["open"], F.struct(F.lit("head").alias("kind"), F.least(F.length(x["text"]), F.lit(MOST_HEAD)).alias("size"), F.substring(x["text"], 1, MOST_HEAD).alias("key"))).otherwise(F.struct(F.lit("word").alias("kind"), F.lit(0).alias("size"), x["text"].alias("key"))))
    plain = outside(F.regexp_replace("pattern", r"\*\*/", "*"))  # may stand for no folder at all
    texts = F.filter(F.split(F.regexp_replace(plain, r"(?<=[^/])/\*\*$|^/\*\*$", "/*"), r"[*?]+"), lambda x: x != "")
    longest = F.coalesce(F.array_max(F.transform(texts, F.length)), F.lit(0))
    sized = rows.withColumn("words", F.array_distinct(words)).withColumn("texts", texts).withColumn("size", F.least(longest, F.lit(PIECES[0])))
    wide = F.filter("texts", lambda x: F.length(x) >= F.col("size"))
    pieces = F.when(F.col("size") == 0, F.array(F.lit(""))).otherwise(F.array_distinct(F.flatten(F.transform(wide, lambda x: F.transform(F.sequence(F.lit(1), F.length(x) - F.col("size") + 1), lambda k: F.substring(x, k, F.col("size")))))))
    found = F.when(F.size("words") > 0, F.col("words")).otherwise(F.transform(pieces, lambda x: F.struct(F.lit("piece").alias("kind"), F.col("size").alias("size"), x.alias("key"))))
    each = sized.select("idx", "pattern", F.explode(found).alias("k")).select("idx", "pattern", "k.*")
    shared = each.groupBy("kind", "size", "key").agg(F.count("*").alias("n"))
    best = F.min(F.struct("n", (-F.length("key")).alias("short"), "kind", "size", "key")).alias("k")
    keyed = each.join(shared, ["kind", "size", "key"]).groupBy("idx", "pattern").agg(best).select("idx", "pattern", "k.kind", "k.size", "k.key")
    return cut(rows.mapInPandas(_regexes, "idx long, pattern string, regex string").join(keyed, ["idx", "pattern"]), "patterns")


def _mark(text):
    return F.crc32(F.substring(text, 1, 1)) % MARKS


def first_matches(paths: DataFrame, index: DataFrame) -> DataFrame:  # E10, D24
    """(path, idx, pattern) of each distinct path that some pattern matches: the one of least idx."""
    own = cut(paths.select("path").where("path is not null").distinct(), "paths")
    kinds = index.select("kind", "size").distinct().collect()  # at most 21 values
    if not kinds:
        return own.join(index.select("idx", "pattern"), F.lit(False))
    pieces = {k: F.array(F.lit("")) if k == 0 else grams(F.col("path"), k) for k in PIECES}
    held = [own.where(F.length("path") >= k).select("path", F.lit("piece").alias("kind"), F.lit(k).alias("size"), F.explode(pieces[k]).alias("key")) for kind, k in kinds if kind == "piece"]
    if any(kind != "piece" for kind, _ in kinds):  # words of a path that begin as some key does: the marks of keys are at most MARKS a kind and size
        marks = index.where("kind <> 'piece'").select("kind", "size", _mark("key").alias("mark")).distinct()
        words = own.select("path", F.explode(F.array_distinct(F.regexp_extract_all("path", F.lit(WORD), F.lit(0)))).alias("word")).withColumn("mark", _mark("word"))
        met = words.join(F.broadcast(marks), "mark").where(F.length("word") >= F.col("size"))
        held.append(met.select("path", "kind", "size", F.when(F.col("kind") == "word", F.col("word")).otherwise(F.substring("word", F.lit(1), F.col("size"))).alias("key")))
    hit = reduce(DataFrame.union, held).join(index, ["kind", "size", "key"]).where("path rlike regex")
    return hit.groupBy("path").agg(F.min("idx").alias("idx"), F.min_by("pattern", "idx").alias("pattern"))


def split_by_patterns(found: DataFrame, index: DataFrame) -> DataFrame:  # D26
    """found (path, ...) with matched_pattern, null where no pattern matches; rows without a path are kept."""
    return found.join(first_matches(found, index).select("path", F.col("pattern").alias("matched_pattern")), "path", "left")
