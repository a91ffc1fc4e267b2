"""Merkle manifest, language identification and periodic runs: against plain versions, SQL and held-out texts."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from graphloom.llm import language_id, merkle_manifest, periodic_runs, registry

SF = "/root/testdata/sf0.001"


def same_as_sql(spark, name, folder, pattern):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{folder.removeprefix('file://')}/documents.parquet{pattern}'")
    found = con.execute(registry.oracle_sql()[name])
    names = [d[0] for d in found.description]
    got = registry.queries()[name](spark, folder)
    assert sorted(names) == sorted(got.columns)
    want = sorted(tuple(str(r[names.index(c)]) for c in sorted(names)) for r in found.fetchall())
    assert sorted(tuple(map(str, r)) for r in got.select(*sorted(names)).collect()) == want
    assert want


# --- periodic runs --------------------------------------------------------------------------------


def plain_runs(words, least=12):
    """Every maximal stretch of words equal to those q later, for every q, with the smallest q of each stretch."""
    found = {}
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, 2 * q):
                found.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted(((s, e - s, q) for (s, e), q in found.items()), key=lambda r: (r[0], r[2]))


def collapsed(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), max_size=90), min_size=1, max_size=4), st.integers(0, 40), st.integers(1, 20), st.sampled_from([12, 4, 7, 20]))
def test_runs_by_brute_force(texts, at, period, least):
    texts = [*texts, [(x := texts[0] or ["z"])[(i if i < at else at + (i - at) % period) % len(x)] for i in range(100)]]
    runs, upto, rest = periodic_runs.runs_of([" \n".join(t).encode() for t in texts], least)
    for k, words in enumerate(texts):
        want = plain_runs(words, least)
        assert [tuple(map(int, r)) for r in runs[upto[k] : upto[k + 1]]] == want
        assert rest[k].decode() == collapsed(words, want)


def test_masking_only_keeps_words_that_repeat():
    texts = [" ".join(f"w{i}" for i in range(200)).encode(), ("one two three four five six " * 4).encode()]
    _, numbers, before = periodic_runs.word_numbers(texts)
    starts, stops = periodic_runs.surviving(numbers, before, 6)
    assert [(int(a), int(b)) for a, b in zip(starts, stops, strict=True)] == [(200, 224)]


def test_planted_words(spark):
    rng = random.Random(4)
    rows = [(k, " ".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 60)))) for k in range(300)] + [(None, "x y z"), (-4, None), (7, "\t")]
    got = periodic_runs.planted(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    for (i, text), r in zip(rows, got, strict=True):
        words, h = (text or "").split(), zlib.crc32(b"" if i is None else str(i).encode())
        if h % 10 == 0 and words:
            g, n = h // 10, len(words)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[k] if k < a else words[a + (k - a) % p] for k in range(n)]
        assert (r["text"] or "").split() == words


def test_runs_as_sql(spark):
    same_as_sql(spark, "op13_periodic_runs", SF, "")


def test_runs_of_odd_texts(spark, odd):
    got = {r["doc_id"]: r for r in registry.queries()["op13_periodic_runs"](spark, odd).collect()}
    empty = hashlib.sha256(b"").hexdigest()
    for k in (0, 1, 2):  # null, empty, blank
        assert (got[k]["n_runs"], got[k]["start"], got[k]["runs_sha256"], got[k]["collapsed_sha256"]) == (0, None, empty, empty)
    long = periodic_runs.periodic_runs(spark.createDataFrame([(8, "a " * 50_000)], "doc_id long, text string")).first()
    assert [tuple(r) for r in long["runs"]] == [(0, 50_000, 1)]
    assert long["collapsed"] == "a"


# --- Merkle manifest ------------------------------------------------------------------------------


def plain_levels(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        x = levels[-1]
        levels.append([merkle_manifest.digest(*x[i : i + 2]) for i in range(0, len(x), 2)])
    return levels


@pytest.mark.parametrize("band", [1, 2, 3])
def test_traversal_gives_every_path(band):
    for n in [*range(1, 40), 64, 100]:
        leaves = [merkle_manifest.digest(str(k)) for k in range(n)]
        levels = plain_levels(leaves)
        got = list(merkle_manifest.traverse(leaves, len(levels) - 1, band))
        for j, (root, path) in enumerate(got):
            assert root == levels[-1][0] == merkle_manifest.fold(leaves[j], path)
            own = [x for mark, x in merkle_manifest.siblings(path) if mark != merkle_manifest.NONE]
            assert own == [lv[(j >> k) ^ 1] for k, lv in enumerate(levels[:-1]) if (j >> k) ^ 1 < len(lv)]
        assert len(got) == n


def test_subtrees_stay_small():
    leaves = [merkle_manifest.digest(str(k)) for k in range(512)]
    own = merkle_manifest.Subtree(leaves, 3, 3, 6)
    for _ in range(64):
        own.step()
        assert len(own.tail) <= 6
        assert len(own.nodes) <= 8 + 4 + 2
    assert own.root == plain_levels(leaves)[6][3]


def test_manifest_as_sql(spark):
    same_as_sql(spark, "op11_merkle_manifest", SF, "")


def test_manifest_of_odd_rows_as_sql(spark, odd):
    same_as_sql(spark, "op11_merkle_manifest", odd, "/*.parquet")
    rows = registry.queries()["op11_merkle_manifest"](spark, odd).collect()
    bad = [r for r in rows if zlib.crc32(b"" if r["doc_id"] is None else str(r["doc_id"]).encode()) % 7 == 0]
    assert bad
    assert all(r["verified"] for r in rows if r not in bad)


def test_manifest_over_layers(spark, monkeypatch):
    """Blocks of four leaves: several layers, a tree of one leaf, trees that end in a lone node."""
    monkeypatch.setattr(merkle_manifest, "BLOCK", 2)
    rows = [(tree, k, merkle_manifest.digest(tree, str(k))) for tree, n in (("", 1), ("=a", 70), ("=b", 5), ("=c", 16), ("=é", 4), ("=z", 17)) for k in range(n)]
    got = merkle_manifest.manifest(spark.createDataFrame(rows, "tree string, doc_id long, digest string").repartition(5), ["doc_id", "digest"]).collect()
    subroots = [plain_levels([d for t, _, d in rows if t == tree])[-1][0] for tree in sorted({t for t, _, _ in rows}, key=str.encode)]
    root = plain_levels(subroots)[-1][0]
    assert len(got) == len(rows)
    assert {r["root"] for r in got} == {root}
    assert {r["subroot"] for r in got} == set(subroots)
    assert all(merkle_manifest.fold(r["digest"], r["path"]) == root for r in got)


def test_tampering_breaks_the_fold(spark):
    rows = registry.queries()["op11_merkle_manifest"](spark, SF).collect()
    for r in rows:
        assert r["verified"] == (zlib.crc32(str(r["doc_id"]).encode()) % 7 != 0)


# --- language identification ----------------------------------------------------------------------


def plain_model(rows):
    """Counts of words and n-grams by language, all held: the model while no language has more than its share."""
    counts = {}
    for lang, text in rows:
        for w in re.findall(r"[^\W\d_]+", (text or "").lower()):
            for order in range(6):
                for x in [w] if order == 0 else language_id.grams(w, order):
                    counts.setdefault((order, lang), Counter())[x] += 1
    return counts


def plain_score(counts, langs, text):
    out = {x: math.log(counts[0, x].total() / sum(counts[0, y].total() for y in langs)) for x in langs}
    for w in re.findall(r"[^\W\d_]+", text.lower()):
        for order in (0, 5, 4, 3, 2, 1):
            own = [x for x in ([w] if order == 0 else language_id.grams(w, order)) if any(x in counts[order, y] for y in langs)]
            if own:
                for y in langs:
                    out[y] += sum(math.log((counts[order, y][x] or 0.5) / counts[order, y].total()) for x in own) / len(own)
                break
    best = max(sorted(langs), key=out.__getitem__)
    return best, 1 / sum(math.exp(v - out[best]) for v in out.values())


def test_languages_by_brute_force(spark):
    rng = random.Random(8)
    syllables = {"aa": "ba bo ti ta ko".split(), "bb": "ba bo ru na ze".split(), "cc": "ööl ko ze".split()}
    say = lambda x, n: " ".join("".join(rng.choice(syllables[x]) for _ in range(rng.randint(1, 3))) for _ in range(n))
    rows = [(x * 2, say(x * 2, 8)) for x in "aabcabcab"] + [("aa", "Ä² 1_b")]
    model = language_id.train(spark.createDataFrame([*rows, (None, "q"), ("bb", None)], "lang string, text string").repartition(3))
    tests = [say(x, n) for x in syllables for n in (1, 2, 5)] + ["BA bo", "ünknown babati", "日本", "xq", "ööööl"]
    counts = plain_model(rows)
    scorer = language_id.Scorer(model)
    want = [plain_score(counts, list(syllables), text) for text in tests]
    for room in (scorer.room, 2):  # a table that is forgotten all the time gives the same
        scorer.room = room
        got = scorer.predict(tests)
        assert [x for x, _ in got] == [x for x, _ in want]
        assert [s for _, s in got] == pytest.approx([s for _, s in want], rel=1e-9)


def test_gram_keys_tell_grams_apart():
    words = ["ab", "abc", "b", "日本語", "x" * 9, "cab"]
    for order in range(1, 6):
        keys, owner = language_id.gram_keys(words, order)
        texts = [(k, x) for k, w in enumerate(words) for x in language_id.grams(w, order)]
        assert [k for k, _ in texts] == owner.tolist()
        assert len(set(keys.tolist())) == len({x for _, x in texts})
        assert len({(x, i) for (_, x), i in zip(texts, keys.tolist(), strict=True)}) == len({x for _, x in texts})


def test_odd_texts_have_no_language(spark, odd, empty):
    got = {r["doc_id"]: r for r in registry.queries()["op12_language_id"](spark, odd).collect()}
    for k in (0, 1, 2):
        assert (got[k]["lang_pred"], got[k]["score"]) == ("und", 0.0)
    assert got[3]["lang_pred"] == "en"
    docs = spark.createDataFrame([(1, "some words"), (2, "12 ² _")], "doc_id long, text string")
    assert [tuple(r)[1:] for r in language_id.identify(docs, language_id.train(spark.createDataFrame([], "lang string, text string"))).collect()] == [("und", 0.0)] * 2


def test_entries_stay_within_their_bound(spark, monkeypatch):
    monkeypatch.setattr(language_id, "ENTRIES", 30)
    monkeypatch.setattr(language_id, "GRAM_ENTRIES", 60)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("lang", "text")
    model = language_id.train(docs)
    assert [len(o.lang) <= (60 if k else 30) for k, o in enumerate(model.orders)] == [True] * 6
    assert model.langs == ["de", "en", "es", "fr"]
    assert len(model.orders[1].lang) > 4


def test_held_out_languages(spark):
    rows = registry.queries()["op12_language_id"](spark, "/root/testdata/sf0.01")
    truth = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    out = rows.where("held_out").join(truth, "doc_id").agg(F.avg(F.expr("int(lang = lang_pred)")).alias("right"), F.min("score").alias("least"), F.max("score").alias("most")).first()
    assert out["right"] >= 0.99
    assert 0 <= out["least"] <= out["most"] <= 1
