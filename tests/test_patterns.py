"""Many patterns by their index, against the condition that tests them one by one."""

import random

from pyspark.sql import functions as F

from graphloom.operators import findings, patterns


def test_index_equals_the_case(spark):
    globs = ["**/*.test.tsx", "lib/**", "app/d3/*", "", "**/m1*.js", "*", "?", "a/**/b", "**/{x,y}/z*", "{a,b}", "q?", "**", "ab*", "x.{js,{ts,tsx}}", "**/node_modules/**", "/**", "a/b"]
    paths = ["x.test.tsx", "s/x.test.tsx", "lib/a", "lib", "app/d3/k/l", "m12.js", "w/m1.js", "a/b", "a/c/d/b", "x/z", "k/y/zz", "a", "b", "q1", "abc", "x.js", "x.tsx", "x.ts", "node_modules/p", "s/node_modules/p/q", "", "/", "/k", "z"]
    found = spark.createDataFrame([*((k, p) for k, p in enumerate(paths)), (99, None)], "finding_id int, path string")
    rng = random.Random(2)
    for _ in range(2):
        order = rng.sample(globs, len(globs))
        one_by_one = findings.split_ignored(found, order)
        given = [*reversed(findings.DEFAULT_IGNORES), *(p for p in order if p)]
        index = patterns.pattern_index(spark.createDataFrame(list(enumerate(given)), "idx int, pattern string"))
        got = patterns.split_by_patterns(found, index)
        rows = lambda df: sorted((r["finding_id"], r["matched_pattern"] or "") for r in df.select("finding_id", "matched_pattern").collect())
        assert rows(got) == rows(one_by_one)


def test_ten_thousand_patterns(spark):
    given = spark.range(10_000).select(F.col("id").alias("idx"), F.concat(F.lit("**/dir"), F.col("id"), F.lit("/*.ts")).alias("pattern"))
    paths = spark.range(3000).select(F.concat(F.lit("src/dir"), F.col("id") * 7, F.lit("/a.ts")).alias("path"))
    got = patterns.first_matches(paths, patterns.pattern_index(given))
    assert got.count() == 1429
    assert got.where("idx % 7 <> 0").count() == 0


def test_patterns_share_no_keys(spark):
    """However many patterns differ in their numbers only, few have a key in common, and a path holds few keys."""
    given = spark.range(3000).select(F.col("id").alias("idx"), F.when(F.col("id") % 3 == 0, F.concat(F.lit("**/m"), "id", F.lit(".*"))).when(F.col("id") % 3 == 1, F.concat(F.lit("log/c"), "id", F.lit("/*"))).otherwise(F.concat(F.lit("**/d{1,5}/m"), "id", F.lit("*"))).alias("pattern"))
    index = patterns.pattern_index(given)
    assert index.groupBy("kind", "size", "key").count().agg(F.max("count")).first()[0] == 1


def test_words_and_heads_equal_the_case(spark):
    """Keys at the ends of words, beside wildcards that cross slashes, at line ends, and of other letters."""
    globs = ["a**/bc", "***/x", "a/**/**/b.c", "x*y/z", "ab?/c", "{a,b}c/d", "d.{ts,js}", "**/é*", "**/ab", "lib/a", "q.r", "**.s", "{a/**/,}k", "longer-than-sixteen-characters*", "a.b.*", "m\\n"]
    paths = ["abc", "a/bc", "axbc", "ax/bc", "/x", "w/x", "a/b.c", "a/k/b.c", "xy/z", "xq/wy/z", "abd/c", "ab/c", "ac/d", "d.ts", "dd.ts", "é1", "w/é", "ab", "w/ab", "lib/a", "lib/a\n", "q.r", "q.rr", "t.s", "a/k", "a/w/k", "k", "longer-than-sixteen-characters-x", "longer-than-sixteen-character", "a.b.", "a.bb.c", "m\\n"]
    found = spark.createDataFrame(list(enumerate(paths)), "finding_id int, path string")
    for order in (globs, globs[::-1]):
        index = patterns.pattern_index(spark.createDataFrame(list(enumerate(order)), "idx int, pattern string"))
        rows = lambda df: sorted((r["finding_id"], r["matched_pattern"] or "") for r in df.select("finding_id", "matched_pattern").collect())
        assert rows(patterns.split_by_patterns(found, index)) == rows(findings.split_ignored(found, order, defaults=False))
