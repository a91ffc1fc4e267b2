"""Near-duplicates by improved consistent weighted sampling over TF-IDF shingles, banded, verified by weighted Jaccard similarity.

1. Document frequencies of five-word shingles are counted over all documents in 2**20 hash buckets. A bucket's other shingles add a share
   of the documents that does not depend on how many there are, so the weights mean the same at every size.
2. A shingle weighs its count times a damped inverse document frequency. The damping (weights fall by a tenth at most) keeps a large
   family of copies from pushing its own members apart. 48 consistent weighted samples make a signature, 12 bands of 4 the buckets.
3. Exact copies are one text from here on. In each bucket every text is compared with the one of the least doc_id (a star, so no bucket
   emits its pairs), by the weighted Jaccard similarity of the whole texts; links of 0.8 or more join texts into classes.
4. Buckets of three texts or more that still hold several classes are looked at again: the texts outside the centre's class are compared
   exactly with all others of the bucket, in blocks of bounded size by products of their shingle matrices, which give as
   many links as join classes and no pairs. So no link between texts that share a bucket is lost.

Defined cases: a text of one to four words is one shingle; texts without words, null among them, are classes of exact copies only (null
equals empty); a null doc_id never names a class unless all its ids are null; repeated rows give a row each; an empty table gives no rows;
columns besides doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.bpe import texts_of
from graphloom.llm.common import LOWER, buffers, cut, mix, numbered, restored, row_of, slices, spans, table, text_column, windows, word_hashes
from graphloom.llm.components import components

WORDS, SIMILARITY = 5, 0.8
BANDS, ROWS = 12, 4
SAMPLES = BANDS * ROWS
BUCKETS, CHUNK = 1 << 20, 1 << 12
DAMPING = 0.1
#: Entries of the tables of random variables for each sample.
DRAWS = 1 << 15
#: Texts, and their bytes, on either side of a block in the second look, about.
MEMBERS, BLOCK_BYTES = 512, 2 << 20
_SHIFT, _LOW = np.uint64(50), np.uint64((1 << 50) - 1)
_TABLES: dict[int, tuple] = {}


def shingles(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Row, 50-bit shingle and count of each distinct shingle of each row, in that order, and the number of rows."""
    data, ends = buffers(column)
    data = LOWER[data]
    starts, stops, before = spans(data, ends)
    hashes = word_hashes(data, starts, stops)
    first, window = windows(hashes, before, WORDS)
    row = row_of(before)
    counts = np.diff(before)
    owner = row[first]
    for n in range(1, WORDS):  # short texts: one window of all words
        short = np.flatnonzero(counts == n)
        if len(short):
            place = before[short]
            h = np.zeros(len(short), np.uint64)
            for k in range(n):
                h = mix(h * np.uint64(0x9E3779B97F4A7C15) + hashes[place + k])
            owner, window = np.concatenate([owner, short]), np.concatenate([window, h])
    keys = np.sort(owner.astype(np.uint64) << _SHIFT | window >> np.uint64(14))
    fresh = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])[: len(keys)])
    return (keys[fresh] >> _SHIFT).astype(np.int64), keys[fresh] & _LOW, np.diff(np.append(fresh, len(keys))), len(ends) - 1


def bucket_of(shingle: np.ndarray) -> np.ndarray:
    return (mix(shingle) >> np.uint64(44)).astype(np.int64)


def pieces(batches, column: str = "text"):
    """Slices of at most 2**13 rows, so that a row's number fits beside a shingle."""
    for batch in slices(batches, column):
        for at in range(0, batch.num_rows, 8192):
            yield batch.slice(at, 8192)


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """Documents of each bucket, and documents with a shingle. Counts come as the non-zero ones of a chunk and are summed in two levels."""
    width = BUCKETS // CHUNK

    def packed(total: np.ndarray) -> bytes:
        at = np.flatnonzero(total)
        return at.astype("<u2").tobytes() + total[at].astype("<i8").tobytes()

    def run(batches):
        total, some, part = np.zeros(BUCKETS, np.int64), 0, None
        for batch in pieces(batches):
            row, shingle, _, _ = shingles(batch.column("text"))
            total += np.bincount(bucket_of(shingle), minlength=BUCKETS)
            some += len(np.unique(row))
            part = part if part is not None or not len(shingle) else int(shingle[0] % 64)
        if some:  # chunk -1 counts the documents
            chunks = [k for k in range(width) if total[k * CHUNK : (k + 1) * CHUNK].any()]
            data = [packed(total[k * CHUNK : (k + 1) * CHUNK]) for k in chunks]
            n = len(chunks)
            yield pa.RecordBatch.from_arrays([pa.array([*chunks, -1], pa.int32()), pa.array([part] * (n + 1), pa.int32()), pa.array([*data, b""], pa.binary()), pa.array([*[0] * n, some], pa.int64())], names=["chunk", "part", "counts", "docs"])

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(CHUNK, np.int64)
        for x in pdf["counts"]:
            n = len(x) // 10
            total[np.frombuffer(x, "<u2", n)] += np.frombuffer(x, "<i8", n, 2 * n)
        return pd.DataFrame({"chunk": [int(pdf["chunk"].iloc[0])], "part": [0], "counts": [packed(total)], "docs": [int(pdf["docs"].sum())]})

    schema = "chunk int, part int, counts binary, docs long"
    sums = docs.select("text").mapInArrow(run, schema)
    for keys in (["chunk", "part"], ["chunk"]):
        sums = sums.groupBy(*keys).applyInPandas(add, schema)
    out, n = np.zeros(BUCKETS, np.int64), 0
    for r in sums.toLocalIterator():
        m = len(r["counts"]) // 10
        out[max(r["chunk"], 0) * CHUNK + np.frombuffer(r["counts"], "<u2", m).astype(np.int64)] = np.frombuffer(r["counts"], "<i8", m, 2 * m)
        n += r["docs"]
    return out, n


def bucket_weights(df: np.ndarray, n: int) -> np.ndarray:
    """Damped inverse document frequency of each bucket, from 1 - DAMPING (in every document) to 1."""
    idf = np.log1p(n / np.maximum(df, 1)) / np.log1p(max(n, 1))
    return (1 - DAMPING + DAMPING * np.clip(idf, 0, 1)).astype(np.float32)


def _tables(k: int) -> tuple[np.ndarray, ...]:
    """For sample k: multiplier, r, 1/r, beta, ln c of the drawn entries."""
    if k not in _TABLES:
        rng = np.random.default_rng([2010, k])
        r, c, beta = rng.gamma(2, 1, DRAWS), rng.gamma(2, 1, DRAWS), rng.random(DRAWS)
        odd = np.uint64(int(rng.integers(1 << 62, 1 << 63)) * 2 + 1)
        _TABLES[k] = (odd, r.astype(np.float32), (1 / r).astype(np.float32), beta.astype(np.float32), np.log(c).astype(np.float32))
    return _TABLES[k]


def signatures(row: np.ndarray, shingle: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows that have shingles and their samples: 32 bits of (shingle, level) of the least draw; equal draws go to the lesser shingle."""
    first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]])[: len(row)])
    sizes = np.diff(np.append(first, len(row)))
    out = np.zeros((len(first), SAMPLES), np.uint32)
    log_w = np.log(weight).astype(np.float32)
    for k in range(SAMPLES):
        odd, r, r_inverse, beta, log_c = _tables(k)
        draw = ((shingle * odd) >> np.uint64(49)).astype(np.int64)
        b, own = beta[draw], r[draw]
        level = np.floor(log_w * r_inverse[draw] + b)
        value = log_c[draw] - own * (level - b + 1)
        least = np.minimum.reduceat(value, first)
        hit = np.flatnonzero(value == np.repeat(least, sizes))
        hit = hit[np.searchsorted(hit, first)]  # the first of each row
        out[:, k] = (mix(shingle[hit] + (level[hit].astype(np.int64).astype(np.uint64) << np.uint64(51))) >> np.uint64(32)).astype(np.uint32)
    return row[first], out


def sign(docs: DataFrame, weights) -> DataFrame:
    """doc_id, text_id (MD5 of the whole text), its bytes, and bands array<long> (null without words) of every row."""

    def run(batches):
        for batch in pieces(batches):
            row, shingle, count, rows = shingles(batch.column("text"))
            bands: list = [None] * rows
            if len(row):
                own, sig = signatures(row, shingle, count * weights.value[bucket_of(shingle)])
                band = np.zeros((len(own), BANDS), np.uint64)
                for k in range(SAMPLES):
                    band[:, k // ROWS] = mix(band[:, k // ROWS] * np.uint64(0x9E3779B97F4A7C15) + sig[:, k] + np.uint64(k))
                for i, b in zip(own.tolist(), band.view(np.int64).tolist(), strict=True):
                    bands[i] = b
            texts = texts_of(batch.column("text"))
            ids, size = [hashlib.md5(t).digest() for t in texts], [len(t) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.binary()), pa.array(size, pa.int64()), pa.array(bands, pa.list_(pa.int64()))], names=["doc_id", "text_id", "bytes", "bands"])

    return docs.mapInArrow(run, "doc_id long, text_id binary, bytes long, bands array<long>")


def verified(pairs: DataFrame, texts: DataFrame, weights, least: float) -> DataFrame:
    """The pairs (a, b) of text ids whose texts have a weighted Jaccard similarity of at least `least`. A hub's rows are split by the engine's skew join."""
    both = pairs.join(texts.select(F.col("text_id").alias("b"), F.col("text").alias("text_b")), "b").join(texts.select(F.col("text_id").alias("a"), F.col("text").alias("text_a")), "a")

    def run(batches):
        for batch in pieces(batches, "text_a"):
            at = [shingles(batch.column(c)) for c in ("text_a", "text_b")]
            keys = [row.astype(np.uint64) << _SHIFT | shingle for row, shingle, _, _ in at]
            weight = [count * weights.value[bucket_of(shingle)].astype(np.float64) for _, shingle, count, _ in at]
            _, i, j = np.intersect1d(*keys, assume_unique=True, return_indices=True)
            rows = batch.num_rows
            common = np.bincount(at[0][0][i], np.minimum(weight[0][i], weight[1][j]), minlength=rows)
            total = sum(np.bincount(x[0], w, minlength=rows) for x, w in zip(at, weight, strict=True))
            kept = common / np.maximum(total - common, 1e-12) >= least
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(pa.array(kept)), batch.column("b").filter(pa.array(kept))], names=["a", "b"])

    return both.select("a", "b", "text_a", "text_b").mapInArrow(run, "a binary, b binary")


def _occurrences(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row and column of every occurrence of a shingle, the columns' buckets, and each row's occurrences in order: a shingle that stands k times in a text has k columns."""
    row, shingle, count, _ = shingles(pa.array(texts, pa.large_string()))
    nth = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    row, shingle = np.repeat(row, count), np.repeat(shingle, count)
    _, first, column = np.unique(mix(shingle + mix(nth.astype(np.uint64) + np.uint64(1))), return_index=True, return_inverse=True)
    return row, column, bucket_of(shingle[first]), np.bincount(row, minlength=len(texts))


def exact_similarities(texts: list[str], asking: np.ndarray, asked: np.ndarray, weights: np.ndarray, width: int = 2048) -> np.ndarray:
    """Weighted Jaccard similarity of the rows `asking` with the rows `asked`, by products of column blocks; columns of a single row only count in the totals."""
    row, column, buckets, _ = _occurrences(texts)
    weight = weights[buckets].astype(np.float64)
    total = np.bincount(row, weight[column], minlength=len(texts))
    shared = np.flatnonzero(np.bincount(column, minlength=len(weight)) > 1)
    place = np.full(len(weight), -1)
    place[shared] = np.arange(len(shared))
    kept = place[column] >= 0
    row, column = row[kept], place[column[kept]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    common = np.zeros((len(asking), len(asked)))
    for at in range(0, len(shared), width):
        a, b = np.searchsorted(column, [at, at + width])
        block = np.zeros((len(texts), min(width, len(shared) - at)))
        block[row[a:b], column[a:b] - at] = 1
        common += (block[asking] * weight[shared[at : at + width]]) @ block[asked].T
    return common / np.maximum(total[asking][:, None] + total[asked][None] - common, 1e-12)


def second_look(members: DataFrame, texts: DataFrame, weights, least: float) -> DataFrame:
    """Links (a, b) across classes within a bucket: of members (bucket, text_id, bytes, label, centre, centre_text).

    Probes are the texts outside the centre's class, targets all but the centre, which the star has compared. Both are dealt to parts of
    about MEMBERS texts and BLOCK_BYTES, each side by its own number and size, so targets go to as many parts as the probes need. A pair of
    parts is compared exactly in one task and gives no more links than join its classes.
    """
    asks = F.col("label") != F.col("centre")
    sums = members.where("text_id <> centre_text").groupBy("bucket").agg(F.count("*").alias("n"), F.sum("bytes").alias("b"), F.count_if(asks).alias("pn"), F.sum(F.when(asks, F.col("bytes"))).alias("pb"))
    parts = lambda n, b: F.greatest(F.ceil(F.col(n) / MEMBERS), F.ceil(F.col(b) / BLOCK_BYTES), F.lit(1)).cast("int")
    own = members.where("text_id <> centre_text").join(sums.where("pn > 0").select("bucket", parts("n", "b").alias("target_parts"), parts("pn", "pb").alias("probe_parts")), "bucket")
    deal = lambda c: F.pmod(F.xxhash64("text_id"), F.col(c)).cast("int")
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    targets = own.select("bucket", deal("target_parts").alias("target_part"), every("probe_parts").alias("probe_part"), "text_id", "label", F.lit(False).alias("probe"))
    probes = own.where(asks).select("bucket", every("target_parts").alias("target_part"), deal("probe_parts").alias("probe_part"), "text_id", "label", F.lit(True).alias("probe"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["text_id", "probe"])
        ids, text = pdf["text_id"].tolist(), pdf["text"].tolist()
        asking, asked = np.flatnonzero(pdf["probe"]), np.flatnonzero(~pdf["probe"])
        out: list[tuple[bytes, bytes]] = []
        if len(asking) and len(asked):
            names, label = np.unique([x.hex() for x in pdf["label"]], return_inverse=True)
            joined = list(range(len(names)))

            def root(x: int) -> int:
                while joined[x] != x:
                    joined[x] = joined[joined[x]]
                    x = joined[x]
                return x

            near = (exact_similarities(text, asking, asked, weights.value) >= least) & (label[asking][:, None] != label[asked][None])
            for i, j in zip(*np.nonzero(near), strict=True):
                x, y = root(label[asking[i]]), root(label[asked[j]])
                if x != y:
                    joined[x] = y
                    out.append(tuple(sorted((ids[asking[i]], ids[asked[j]]))))
        return pd.DataFrame({"a": [x for x, _ in out], "b": [x for _, x in out]})

    both = targets.unionByName(probes).join(texts, "text_id")
    return both.groupBy("bucket", "target_part", "probe_part").applyInPandas(run, "a binary, b binary").distinct()


def classes(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """doc_id, text_id, class_id (least doc_id of the class), class_text (the text that stands for it) of every row of docs (doc_id, text)."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    weights = spark.sparkContext.broadcast(bucket_weights(*document_frequencies(docs)))  # 4 MB at every size
    signed = cut(sign(docs, weights), "signed")
    each = signed.groupBy("text_id").agg(F.min("doc_id").alias("doc_id"), F.first("bytes").alias("bytes"), F.first("bands").alias("bands"))
    distinct = cut(each, "texts")
    placed = distinct.where("bands is not null").select("text_id", "doc_id", "bytes", F.explode("bands").alias("bucket"))
    rank = F.struct(F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("doc_id"), F.col("text_id"))
    centres = placed.groupBy("bucket").agg(F.min(rank).alias("least"), F.count("*").alias("n")).where("n > 1").select("bucket", "n", F.col("least.text_id").alias("centre_text"))
    shared = cut(placed.join(centres, "bucket").select("bucket", "n", "centre_text", "text_id", "bytes"), "buckets")
    pairs = cut(shared.where("text_id <> centre_text").select(F.col("centre_text").alias("a"), F.col("text_id").alias("b")).distinct(), "pairs")
    needed = shared.select("text_id").distinct()
    whole = docs.select(F.unhex(F.md5("text")).alias("text_id"), "text")
    texts = cut(whole.join(needed, "text_id").groupBy("text_id").agg(F.first("text").alias("text")), "needed")

    links = cut(verified(pairs, texts, weights, least), "links")  # of the star
    labels = components(links)
    # a bucket of two has been compared; one of a single class has nothing left to join
    own = shared.where("n > 2").join(labels.withColumnRenamed("node", "text_id"), "text_id", "left").withColumn("label", F.coalesce("label", "text_id"))
    mixed = own.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.max(F.when(F.col("text_id") == F.col("centre_text"), F.col("label"))).alias("centre")).where("low <> high").select("bucket", "centre")
    found = cut(second_look(own.join(mixed, "bucket"), texts, weights, least), "links")
    if found.limit(1).count():
        labels = components(links.union(found))
    named = distinct.select("text_id", "doc_id").join(labels.withColumnRenamed("node", "text_id"), "text_id")
    stand = named.groupBy("label").agg(F.min("doc_id").alias("class_id"), F.min(F.struct(F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("d"), F.col("text_id"))).alias("m"))
    joined = named.select("text_id", "label").join(stand, "label").select("text_id", "class_id", F.col("m.text_id").alias("class_text"))
    by_text = distinct.select("text_id", "doc_id").join(joined, "text_id", "left").select("text_id", F.when(F.col("class_text").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("class_text", "text_id").alias("class_text"))
    return signed.select("doc_id", "text_id").join(by_text, "text_id").select("doc_id", "text_id", "class_id", "class_text")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class stays, in the columns of docs: of the text with the least doc_id, the row with the least one.

    Null and empty texts are one class of exact copies; a class whose ids are all null keeps one of its rows; of rows that are alike in id and text one stays; an empty table gives none.
    """
    keep = classes(docs).where("text_id = class_text").select("text_id", "class_id").distinct()
    own, text, doc_id = numbered(docs), text_column(docs), f"c{docs.columns.index('doc_id')}"
    own = own.withColumn("text_id", F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")))))
    rows = own.join(keep, "text_id").where(F.col(doc_id).cast("long").eqNullSafe(F.col("class_id")))
    return restored(rows.dropDuplicates(["text_id"]), docs)
