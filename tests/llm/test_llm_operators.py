"""Operators against brute force, round trips and SQL."""

import collections
import heapq
import math
import re
import zlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from graphloom.llm import bpe, chat_format, license_scan, lm_scoring, mil_classifier, near_dedup, quality_rules, registry, source_mix, token_records, topk_search
from graphloom.llm.common import table

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
quiet = settings(max_examples=30, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] or "" for r in table(spark, SF, "documents").collect()}


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.default_path())


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_sql(spark, duck, name):
    got = registry.queries()[name](spark, SF)
    columns = sorted(got.columns)
    found = duck.execute(registry.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(map(str, (tuple(r) for r in got.select(*columns).collect()))) == sorted(str(tuple(r[names.index(c)] for c in columns)) for r in found.fetchall())


# --- near-duplicates ----------------------------------------------------------------------------


def brute_classes(texts):
    sh = {}
    for i, t in texts.items():
        w = [x.encode().lower() for x in WORD.findall(t)]
        sh[i] = collections.Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) > 4 else collections.Counter([tuple(w)] if w else [])
    df = collections.Counter(x for s in sh.values() for x in s)
    weight = {x: 1 - near_dedup.DAMPING + near_dedup.DAMPING * min(1, math.log1p(len(texts) / n) / math.log1p(len(texts))) for x, n in df.items()}
    label = {i: i for i in texts}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    ids = sorted(texts)
    for a in ids:
        for b in ids:
            if a < b and (texts[a] == texts[b] or sh[a] and sh[b]):
                common = sum(min(n, sh[b][x]) * weight[x] for x, n in sh[a].items() if x in sh[b])
                total = sum(n * weight[x] for s in (sh[a], sh[b]) for x, n in s.items())
                if texts[a] == texts[b] or common / (total - common) >= 0.8:
                    x, y = root(a), root(b)
                    label[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


def test_near_dedup(spark, texts):
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.query(spark, SF).collect()}
    assert got == brute_classes(texts)


def test_links_beside_the_star(spark):
    """A chain whose ends differ, and a family that is alike only through one member that is not its first."""
    base = [f"b{k}" for k in range(120)]
    change = lambda at, tag: " ".join(base[:at] + [f"{tag}{k}" for k in range(at, at + 2)] + base[at + 2 :])
    rows = [(k + 1, change(8 * k, f"c{k}")) for k in range(12)] + [(100, " ".join(base))]
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_classes(dict(rows))
    assert set(got.values()) == {1}


def test_exact_similarities():
    texts = ["a b c d e f g h", "a b c d e f g x", "a b c d e f g h", "q r s t u v"]
    weights = np.ones(near_dedup.BUCKETS, np.float32)
    got = near_dedup.exact_similarities(texts, np.array([0, 3]), np.array([1, 2]), weights)
    assert np.allclose(got, [[3 / 5, 1], [0, 0]])


# --- records ------------------------------------------------------------------------------------


def test_records(spark, texts, library):
    start, want = 0, []
    for i in sorted(texts):
        ids = [*library.encode(texts[i], add_special_tokens=False).ids, 2]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = token_records.query(spark, SF).select("doc_id", "start", "n_tokens", "ids_crc32").collect()
    assert sorted(tuple(r) for r in got) == want


def test_shuffled_reads(spark, library, tmp_path):
    docs = table(spark, SF, "documents").limit(20)
    token_records.write_records(docs, f"file://{tmp_path}/r")
    index = token_records.write_index(spark, f"file://{tmp_path}/r", f"file://{tmp_path}/i")
    a, b, c = ([(r["doc_id"], list(r["ids"])) for r in token_records.read_shuffled(spark, f"file://{tmp_path}/r", index, seed).collect()] for seed in (1, 1, 2))
    assert a == b
    assert a != c
    assert sorted(a) == sorted(c) == sorted((r["doc_id"], [*library.encode(r["text"] or "", add_special_tokens=False).ids, 2]) for r in docs.collect())


def test_record_files_are_closed_by_bytes(spark, tmp_path, monkeypatch):
    """A task's frames go to several files, which follow one another; index, starts and reads are those of one file."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    path = lambda x: f"file://{tmp_path}/{x}"
    token_records.write_records(docs, path("one"))
    monkeypatch.setattr(token_records, "PIECE_BYTES", 4000)
    monkeypatch.setattr(token_records, "FILE_PIECES", 2)
    token_records.write_records(docs, path("many"))
    one, many = (token_records.write_index(spark, path(x), path(f"{x}_index")) for x in ("one", "many"))
    files = [f for f in (tmp_path / "many").iterdir() if f.suffix == ".txt"]
    assert len(files) > 3 * max(1, len(list((tmp_path / "one").glob("*.txt"))))
    largest = many.agg({"length": "max"}).first()[0]
    assert max(f.stat().st_size for f in files) <= 2 * (4000 + largest)
    rows = lambda index: [tuple(r) for r in token_records.with_starts(index).select("start", "doc_id", "n_tokens", "ids_crc32").orderBy("start").collect()]
    assert rows(one) == rows(many)
    ids = [r[1] for r in rows(many)]
    assert ids == sorted(ids)
    a, b = ([(r["doc_id"], list(r["ids"])) for r in token_records.read_shuffled(spark, path(x), index, 3).collect()] for x, index in (("one", one), ("many", many)))
    assert a == b


def test_damage_is_found():
    data = bytearray(token_records.frame(7, np.array([1, 500, 2]), 2) + b"\n")
    doc_id, ids, end = token_records.parse(data, 0)
    assert (doc_id, ids.tolist(), end) == (7, [1, 500, 2], len(data))
    for at in (0, 9, 20, len(data) - 3):
        bad = bytearray(data)
        bad[at] ^= 1
        with pytest.raises(ValueError, match="damaged"):
            token_records.parse(bad, 0)


# --- mixing -------------------------------------------------------------------------------------


@quiet
@given(st.lists(st.integers(1, 500) | st.integers(1, 9) | st.sampled_from([1000, 50_000]), min_size=1, max_size=300), st.integers(0, 400))
def test_highest_quotients(weights, seats):
    held = [0] * len(weights)
    for _ in range(seats):
        k = max(range(len(weights)), key=lambda i: (weights[i] / (2 * held[i] + 1), -i))
        held[k] += 1
    got = source_mix.highest_quotients(np.array(weights), seats)
    assert got.sum() == seats
    quotient = lambda h: sorted(w / (2 * n - 1) for w, n in zip(weights, h, strict=True) if n)
    assert min(quotient(got), default=0) >= max((w / (2 * n + 1) for w, n in zip(weights, got, strict=True)), default=0) - 1e-9 or not seats


def test_highest_quotients_of_skewed_weights():
    for weights, seats in (([1000.0] + [0.6] * 1000, 1600), ([50_000.0] + [30.0] * 200, 1120)):
        held, heap = [0] * len(weights), [(-w, i) for i, w in enumerate(weights)]
        heapq.heapify(heap)
        for _ in range(seats):
            _, i = heapq.heappop(heap)
            held[i] += 1
            heapq.heappush(heap, (-weights[i] / (2 * held[i] + 1), i))
        assert source_mix.highest_quotients(np.array(weights), seats).tolist() == held


def test_targets():
    got = source_mix.targets([("b", 100), ("a", 10), (None, 1000)])
    assert got["a"] == 20  # weight 3, but at most twice its words
    assert math.isclose(sum(got.values()), 1.5 * 1110)
    assert got["b"] == 200
    assert math.isclose(got[None], 1.5 * 1110 - 220)


def brute_targets(sizes):
    """Shares by weight, with the excess of full sources shared again, in exact fractions."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight, left, out = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}, Fraction(3 * sum(sizes.values()), 2), {}
    while len(out) < len(order):
        free = [s for s in order if s not in out]
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        full = [s for s in free if share[s] > 2 * sizes[s]]
        for s in full or free:
            out[s] = Fraction(2 * sizes[s]) if full else share[s]
        left -= sum(out[s] for s in full)
    return {s: float(x) for s, x in out.items()}


def test_targets_of_the_query(spark, texts):
    sizes = collections.Counter()
    rows = source_mix.query(spark, SF).collect()
    for r in rows:
        sizes[r["source"]] += len(WORD.findall(texts[r["doc_id"]]))
    want = brute_targets(sizes)
    assert all(r["source_size"] == sizes[r["source"]] and math.isclose(r["target"], want[r["source"]]) for r in rows)


def test_small_sources_are_not_lost(spark):
    rows = [(k, "w " * 20, f"s{k:04}") for k in range(300)] + [(1000 + k, "x " * 500, "t") for k in range(20)]
    got = source_mix.mix(source_mix.sized(d := spark.createDataFrame(rows, "doc_id long, text string, source string")), source_mix.by_source(source_mix.sized(d))).collect()
    assert all(abs(r["taken"] - r["target"]) <= 1 for r in got if r["source"] != "t")


def test_mix(spark, texts):
    rows = source_mix.query(spark, SF).collect()
    again = {r["doc_id"]: r["taken"] for r in source_mix.query(spark, SF).collect()}
    assert {r["doc_id"]: r["taken"] for r in rows} == again
    assert all(r["size"] == len(WORD.findall(texts[r["doc_id"]])) and 0 <= r["taken"] <= 2 * r["size"] for r in rows)
    for source in {r["source"] for r in rows}:
        own = [r for r in rows if r["source"] == source]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 64


def test_mixed_documents_hold_the_words_taken(spark):
    taken = {r["doc_id"]: r["taken"] for r in source_mix.query(spark, SF).collect()}
    got = collections.Counter()
    for r in source_mix.stage(spark, table(spark, SF, "documents"), SF).collect():
        got[r["doc_id"]] += len(WORD.findall(r["text"]))
        assert r["n_chars"] == len(r["text"])
    assert {k: v for k, v in taken.items() if v} == dict(got)


# --- classifier and rules -----------------------------------------------------------------------


def test_classifier_on_the_held_out_fold(spark):
    sf = SF.replace("0.001", "0.1")
    rows = mil_classifier.query(spark, sf).join(table(spark, sf, "labels"), "doc_id").where("held_out").collect()
    right = sum(r["predicted"] == r["quality"] for r in rows) / len(rows)
    assert right >= 0.95
    low = [r["score"] for r in rows if r["quality"] == 0]
    high = [r["score"] for r in rows if r["quality"] == 1]
    assert np.mean([h > x for h in high for x in low]) > 0.95


def test_held_out_labels_teach_nothing(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    flipped = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (mil_classifier.fit(docs, x) for x in (labels, flipped))
    assert all((a.w[k] == b.w[k]).all() for k in a.w)


def test_passages_travel_as_counts(spark, texts):
    """Bit for bit the features of a plain count of buckets, from a third of their bytes."""
    some = [None, "", "\xe9 " * 70, *list(texts.values())[:40]]
    passages, first = mil_classifier.packed_passages(pa.array(some, pa.string()))
    x, at = mil_classifier.encode_passages(pa.array(some, pa.string()))
    assert passages.itemsize * 2.5 < x.shape[1] * x.itemsize and (first == at).all()
    found = np.frombuffer(passages.tobytes(), mil_classifier.PACKED)
    assert (mil_classifier.features(found) == x).all()
    k = 0
    for t in some:
        words = WORD.findall(t or "")
        for i in range(0, max(len(words), 1), mil_classifier.PASSAGE):
            own = words[i : i + mil_classifier.PASSAGE]
            assert passages["words"][k] == len(own) == passages["bag"][k].sum()
            assert np.allclose((x[k, mil_classifier.RATES :] ** 2).sum(), bool(own), atol=1e-5)
            k += 1
    assert k == len(passages) == first[-1]


def test_long_labelled_texts_pass_the_driver_in_parts(spark):
    """Finding F1: the passages of all labelled texts came to the driver's heap in one result."""
    docs = spark.range(90).select(F.col("id").alias("doc_id"), F.expr("array_join(transform(sequence(1, 17000), k -> substr(md5(cast(id * 100000 + k as string)), 1, 6)), ' ')").alias("text"))
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    held, key = spark.sparkContext._jsc.sc().conf(), "spark.driver.maxResultSize"
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    held.set(key, "1m")
    try:
        assert set(mil_classifier.fit(docs, labels).w) == set(mil_classifier.Model().w)
    finally:
        held.remove(key)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_gradients():
    rng = np.random.default_rng(1)
    x, first, y = rng.normal(size=(7, mil_classifier.RATES + mil_classifier.BUCKETS)).astype(np.float32), np.array([0, 3, 4, 7]), np.array([1, 0, 1], np.float32)
    model, one = mil_classifier.Model(), np.ones(3, np.float32)
    loss = lambda: -np.mean(y * np.log(model.forward(x, first)[-1]) + (1 - y) * np.log(1 - model.forward(x, first)[-1]))
    grads = model.gradients(x, first, y, one)
    for k, w in model.w.items():
        w = model.w[k] = w.astype(np.float64)
        at = tuple(0 for _ in w.shape)
        w[at] += 1e-4
        up = loss()
        w[at] -= 2e-4
        down = loss()
        w[at] += 1e-4
        assert abs((up - down) / 2e-4 - grads[k][at]) < 1e-3


def brute_statistics(t):
    w = WORD.findall(t)
    five = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
    n = collections.Counter(five)
    inside = {j for k, x in enumerate(five) if n[x] > 1 for j in range(k, k + 5)}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(t.count(x) for x in "#*$%&|<>"), dup, len(inside), len(set(w))


def test_statistics(spark, texts):
    rows = quality_rules.query(spark, SF).collect()
    for r in rows:
        want = brute_statistics(texts[r["doc_id"]])
        assert tuple(r[k] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_distinct")) == want
        assert r["base_failed"] == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert not (r["base_failed"] and r["kept"])


def test_rules_on_a_fold_held_out(spark):
    sf = SF.replace("0.001", "0.1")
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    out = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    rules = quality_rules.fit(docs, labels.where(~out))
    rows = quality_rules.text_statistics(docs.where(out)).withColumn("kept", quality_rules.verdict(rules)).where(~quality_rules.base_failed()).join(labels, "doc_id").collect()
    good, bad = [r["kept"] for r in rows if r["quality"] == 1], [r["kept"] for r in rows if r["quality"] == 0]
    assert np.mean(good) > 0.98
    assert np.mean(bad) < 0.35


def test_order_decides():
    """Rows of high a go, but for those of high b: no conjunction of the first kind is precise until a rule has kept the second."""
    rng = np.random.default_rng(4)
    x = {"a": rng.random(900), "b": rng.random(900)}
    reject = (x["a"] > 0.5) & (x["b"] < 0.5) | (x["b"] >= 0.5) & (x["a"] < 0.2)
    rules = quality_rules.learn_rules(x, reject)
    said = np.ones(900, bool)
    for rule in reversed(rules):
        said[quality_rules._covers(rule.conditions, x, 900)] = rule.keep
    assert (said != reject).mean() > 0.95


def test_one_row_an_id(spark):
    docs = spark.createDataFrame([(1, f"text {k % 3}") for k in range(500)] + [(2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 1)], "doc_id long, quality int")
    got = sorted(tuple(r) for r in quality_rules.labelled_sample(docs, labels, 10).select("doc_id", "quality").collect())
    assert got == [(1, 1), (2, 1)]


def test_learned_rule():
    rng = np.random.default_rng(2)
    x = {"a": rng.random(600), "b": rng.random(600)}
    reject = (x["a"] > 0.7) & (x["b"] < 0.4)
    (rule, *_) = quality_rules.learn_rules(x, reject)
    assert {(name, op) for name, op, _ in rule.conditions} <= {("a", ">="), ("b", "<="), ("a", "<="), ("b", ">=")}
    assert quality_rules.learn_rules(x, np.zeros(600, bool)) == []


# --- licences -----------------------------------------------------------------------------------


def test_nearest_ancestor(spark):
    rows = [("LICENSE", "Released under the MIT License."), ("a/LICENSE", "Licensed under CC BY-NC 4.0."), ("a/b/x", "no notice"), ("c/y", "no notice"), ("a/z", "head\nThis work is licensed under the GNU General Public License, version 3.\nmore text that has nothing to do with it at all")]
    got = {r["path"]: (r["license_own"], r["inherited"], r["inherited_from"], r["license"]) for r in license_scan.inherit(license_scan.scan(spark.createDataFrame(rows, "path string, text string"))).collect()}
    assert got["a/b/x"] == (None, "CC-BY-NC-4.0", "a", "CC-BY-NC-4.0")
    assert got["c/y"] == (None, "MIT", "", "MIT")
    assert got["a/z"][3] == "GPL-3.0"


def test_every_template_finds_itself(spark):
    rows = list(license_scan.TEMPLATES.items())
    got = license_scan.scan(spark.createDataFrame(rows, "name string, text string")).collect()
    assert all(r["name"] == r["license_own"] and r["own_score"] == 1 for r in got)


# --- search -------------------------------------------------------------------------------------


@quiet
@given(st.integers(1, 400), st.integers(1, 6), st.integers(0, 10**6))
def test_tree_search(n, dims, seed):
    rng = np.random.default_rng(seed)
    v, ids = rng.integers(-3, 4, (n, dims)), rng.permutation(n)
    tree = topk_search.build_tree(ids, v, leaf=8)
    q, qids = v[:5], ids[:5]
    floor = topk_search.probe(tree, qids, q, 4)
    got = list(zip(*(x.tolist() for x in topk_search.search(tree, qids, q, floor, 4)), strict=True))
    for i in range(len(q)):
        want = sorted((-int(q[i] @ v[j]), int(ids[j])) for j in range(n) if ids[j] != qids[i])[:4]
        assert [(x, -s) for a, x, s in got if a == qids[i]] == [(x, s) for s, x in want]


def test_large_components(spark):
    """Products beyond doubles, and beyond what a sum of longs may reach on the way."""
    rng = np.random.default_rng(5)
    rows = [(k, [float(x) for x in rng.integers(-300_000, 300_000, 64)]) for k in range(60)] + [(100, [300_000.0] * 64), (101, [2.0] * 64), (102, [-1e12] + [0.0] * 63), (200, [1e-3] * 64), (103, [3e14, -3e14, *[0.0] * 62])]
    vectors = topk_search.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = topk_search.topk(vectors, vectors.where("vec_id in (0, 100, 200)"), 5).collect()
    whole = {k: [math.floor(1024 * x) for x in v] for k, v in rows}
    for q in (0, 100, 200):
        want = sorted((-sum(a * b for a, b in zip(whole[q], v, strict=True)), k) for k, v in whole.items() if k != q)[:5]
        assert [(-r["score"], r["vec_id"]) for r in sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])] == want
    huge = topk_search.quantised(spark.createDataFrame([(0, [1e14]), (1, [1e14])], "vec_id long, embedding array<double>"))
    with pytest.raises(Exception, match="does not fit a long"):
        topk_search.topk(huge, huge, 5).collect()


# --- language model -----------------------------------------------------------------------------


def test_base_scores(spark, texts):
    docs = {i: [*t.encode().lower().split(), b""] for i, t in texts.items()}
    c = collections.Counter(w for i, own in docs.items() if zlib.crc32(str(i).encode()) % 10 for w in own)
    total, distinct = sum(c.values()), len(c)
    rows = lm_scoring.query(spark, SF).collect()
    for r in rows:
        own = docs[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(own), sum(c[w] > 0 for w in own), total)
        want = sum(math.log10((c[w] + 0.1) / (total + 0.1 * (distinct + 1))) for w in own)
        assert math.isclose(want, r["base_score"], rel_tol=1e-9)
    assert sum(r["score"] for r in rows) > sum(r["base_score"] for r in rows)


def test_words_beyond_the_table_join_the_counts(spark, monkeypatch):
    want = {r["doc_id"]: r["base_score"] for r in lm_scoring.query(spark, SF).collect()}
    monkeypatch.setattr(lm_scoring, "KNOWN", 50)
    got = {r["doc_id"]: r["base_score"] for r in lm_scoring.query(spark, SF).collect()}
    assert all(math.isclose(want[k], got[k], rel_tol=1e-9) for k in want)


def test_probabilities_are_normalised():
    model = lm_scoring.LogBilinear(np.array([50.0, 30, 9, 4, 3, 1, 1, 0, 0]))
    assert len(model.first) > 2
    for a in range(9):
        for b in range(9):
            every = np.arange(9)
            assert math.isclose(np.exp(model.log_probabilities(np.full(9, a), np.full(9, b), every)).sum(), 1, rel_tol=1e-5)


def test_words_of_a_bucket_share_it_out():
    """Of the words of a bucket and one more that training lacks, the shares add up to 1."""
    words, counts = np.arange(1, 400, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), np.arange(400, 1, -1)
    bucket = (words & np.uint64(31)).astype(int)
    every = [(k, int(counts[bucket == k].sum()), int((bucket == k).sum())) for k in range(32)]
    symbols = lm_scoring.Symbols(words, counts, 10, int(counts.sum()) + 10, every, 256)
    _, symbol, own = symbols.find(words)
    assert sorted(set(symbol[own < 0])) == sorted(set(range(256)) - set(symbols.of_bucket.tolist()) - {symbols.end})
    for k in set(own[own >= 0].tolist()):
        shares = (counts[own == k] + 0.1) / 10 ** symbols.bucket_all[k]
        assert math.isclose(shares.sum() + 0.1 / 10 ** symbols.bucket_all[k], 1, rel_tol=1e-9)


def test_contexts():
    w1, w2 = lm_scoring.contexts(np.array([5, 6, 7, 0, 8, 0]), np.array([0, 4, 6]), 0)
    assert w1.tolist() == [0, 5, 6, 7, 0, 8]
    assert w2.tolist() == [0, 0, 5, 6, 0, 0]


def test_held_out_gain_does_not_hang_on_partitions(spark):
    """The model beats the base by 0.08 of log10 a token on rows that it has not seen, whatever the scan's splits."""
    docs = table(spark, SF.replace("0.001", "0.01"), "documents")
    found = []
    for parts in (1, 64):
        rows = lm_scoring.score(docs.repartition(parts)).where("held_out").collect()
        assert sum(r["score"] - r["base_score"] for r in rows) / sum(r["n_tokens"] for r in rows) > 0.08
        found.append({(r["doc_id"]): r["score"] for r in rows})
    assert all(math.isclose(found[0][k], found[1][k], rel_tol=1e-6) for k in found[0])


# --- chat ---------------------------------------------------------------------------------------

piece = st.text(st.sampled_from("ab\\</>[]INSTSY é\n"), max_size=12) | st.sampled_from(["</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<\\s>", "[\\\\INST]"])


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "<s>"]), st.lists(piece, max_size=4).map("".join)), min_size=1, max_size=5))
def test_chat_round_trip(spark, turns):
    rows = spark.createDataFrame([(1, k, r, t) for k, (r, t) in enumerate(turns)], "conv_id long, turn long, role string, text string")
    made = chat_format.examples(rows)
    back = chat_format.read_back(made).first()
    assert [(t["role"], t["text"]) for t in back["turns"]] == turns
    assert back["loss"] == "".join(t for r, t in turns if r == "assistant")
    replies = sum(r == "assistant" for r, _ in turns)
    assert made.count() == replies + (turns[-1][0] != "assistant")


# --- BPE ----------------------------------------------------------------------------------------

letters = st.text(st.sampled_from("aabcdeéEÉ.!'s\n\t 12ΣσÍ#%<|>thinrê　́ſK"), max_size=60) | st.sampled_from(["a<|endoftext|>b", "<|startoftext|>", "they'll don't I'M", "!" * 90, "ab" * 300])


@settings(max_examples=150, deadline=None)
@given(st.lists(letters, max_size=6))
def test_bpe(texts):
    own, lib = vocabulary(), vocabulary.library
    for kind in (own, vocabulary.pieces):
        encoder = bpe.CachedEncoder(kind.split, kind.encode_pieces)
        for _ in range(2):
            ids, ends = encoder.encode(pa.array(texts, pa.string()))
            want = [lib.encode(t, add_special_tokens=False).ids for t in texts]
            assert [ids[a:b].tolist() for a, b in zip(ends[:-1], ends[1:], strict=True)] == want
    assert own.decode(ids.astype(np.int64), ends) == [lib.decode(x, skip_special_tokens=False).encode() for x in want]


def vocabulary():
    if not hasattr(vocabulary, "own"):
        from tokenizers import Tokenizer

        vocabulary.own = bpe.Vocabulary(bpe.default_path())
        vocabulary.spec = open(bpe.default_path(), encoding="utf-8").read()
        vocabulary.library, vocabulary.pieces = Tokenizer.from_str(vocabulary.spec), token_records.Library(vocabulary.spec)
    return vocabulary.own


def test_small_caches_give_the_same():
    own = vocabulary()
    texts = [f"word{k} and{k % 7} it's{k % 11}." for k in range(300)]
    big, small = bpe.CachedEncoder(own.split, own.encode_pieces), bpe.CachedEncoder(own.split, own.encode_pieces, 8, 8)
    for at in range(0, 300, 20):
        a, b = (e.encode(pa.array(texts[at : at + 20])) for e in (big, small))
        assert (a[0] == b[0]).all()
        assert (a[1] == b[1]).all()


def test_bpe_query(spark, texts, library):
    import hashlib

    for r in bpe.query(spark, SF).collect():
        ids = library.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_license_texts_headers_and_spdx(spark):
    """LICENSE files with a copyright line, headers wrapped as comments with code around them, SPDX lines."""
    import textwrap

    def wrapped(text, mark, width):
        return "#!/bin/x\n" + "\n".join(f"{mark} {x}" for x in textwrap.wrap(text, width)) + "\nimport os\nprint(os.name)\n" + "value = compute(total)\n" * 40

    texts = {k.split("/")[0]: v for k, v in license_scan.license_texts().items() if k.endswith("/text")}
    rows = [(f"{n}/LICENSE", n, "Copyright (c) 2021 Some Body and others\n\n" + x) for n, x in texts.items()]
    rows += [(f"{n}/{k}.py", n, wrapped(x, m, w)) for n, x in license_scan.HEADERS.items() for k, (m, w) in enumerate([("#", 40), ("//", 70), (" *", 100)])]
    mit = texts["MIT"].split("\n\n", 1)[1]
    rows += [("b/a.c", "MIT", "/*\n" + "\n".join(f" * {x}".rstrip() for x in mit.split("\n")) + "\n */\nint main() { return 0; }\n" * 3)]
    rows += [("s/a.c", "MIT", "// SPDX-License-Identifier: MIT\nint x;"), ("s/b.c", "GPL-2.0", "/* SPDX-License-Identifier: GPL-2.0-or-later */\nint x;"), ("s/c.c", "MIT OR Apache-2.0", "# SPDX-License-Identifier: MIT OR Apache-2.0\n")]
    rows += [("n/a", None, "A software license is a text about software and its copies."), ("MIT/src/x", None, "nothing here")]
    got = {r["path"]: r for r in license_scan.inherit(license_scan.scan(spark.createDataFrame(rows, "path string, want string, text string"))).collect()}
    assert {p: r["license_own"] for p, r in got.items()} == {p: w for p, w, _ in rows}
    assert all(got[f"{n}/LICENSE"]["file_license"] == n for n in texts)
    assert got["MIT/src/x"]["license"] == "MIT"


def test_rounds_take_every_group_once():
    for groups in (1, 2, 3, 14, 60, 2001):
        rounds = lm_scoring.growing(groups)
        assert [k for a, b in rounds for k in range(a, b)] == list(range(groups))
        assert all(b - a <= 2 * max(1, d - c) for (c, d), (a, b) in zip(rounds, rounds[1:], strict=False))
        assert len(rounds) <= 2 + math.log2(groups)


def test_parameters_add_up_over_many_levels(spark, monkeypatch):
    """Groups of few tokens and a tree that adds three sets at a time: many rounds and levels, on the same rows a model that is still better than none."""
    monkeypatch.setattr(lm_scoring, "FAN_IN", 3)
    monkeypatch.setattr(lm_scoring, "GROUP_TOKENS", 2000)
    monkeypatch.setattr(lm_scoring, "PASS_TOKENS", 1)
    rows = lm_scoring.score(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")).collect()
    held = [r for r in rows if r["held_out"]]
    gain = sum(r["score"] - r["base_score"] for r in held) / sum(r["n_tokens"] for r in held)
    assert all(math.isfinite(r["score"]) for r in rows)
    assert gain > -0.05


def test_lm_training_stays_in_single_precision(monkeypatch):
    """Training takes no doubles where it draws on float32 parameters, and probabilities are those of the plain softmaxes."""
    kinds, plain = set(), lm_scoring._sigmoid
    monkeypatch.setattr(lm_scoring, "_sigmoid", lambda x: (kinds.add(x.dtype), plain(x))[1])
    rng = np.random.default_rng(5)
    model, rows = lm_scoring.LogBilinear(rng.integers(1, 50, 300)[np.argsort(rng.random(300))]), rng.integers(0, 300, (2000, 3))
    model.train(rows, np.ones(len(rows), np.int64), np.random.default_rng(1), {k: np.full_like(x, 1e-8) for k, x in model.p.items()}, 256)
    assert kinds == {np.dtype(np.float32)} and all(x.dtype == np.float32 for x in model.p.values())
    w2, w1, w = rows[:50].T
    h = model.predict(w1, w2).astype(float)
    share = lambda x, k: x[k] - np.log(np.exp(x).sum())
    for i, found in enumerate(model.log_probabilities(w2, w1, w)):
        c = model.class_of[w[i]]
        a, b = model.first[c], model.first[c + 1]
        assert abs(found - share(model.p["S"] @ h[i] + model.p["s"], c) - share(model.p["Q"][a:b] @ h[i] + model.p["q"][a:b], w[i] - a)) < 1e-4
