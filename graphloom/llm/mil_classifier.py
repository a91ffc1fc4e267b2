"""Quality classifier by attention-based multiple-instance learning.

A document is a bag of passages of 64 words. Every passage of the whole text is encoded (rates of characters and words,
a hashed bag of words, one tanh layer), a gated attention weighs the passages, and a logistic unit scores the weighted
sum; only document labels teach it. Training runs in numpy on a bounded sample of labelled rows (SAMPLE_ROWS ids, a row each, and of a longer
text BAG passages at even distances), which comes to the driver as counts, a partition at a time (about 160 MB at most); scoring is one Arrow pass over all passages of every whole text.

Defined cases: a null or empty text is a bag of one zero passage and still gets a score; repeated rows each give a row; a
null doc_id counts as empty text for the fold; without both labels in the sample every score is the label's mean, or 0.5.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import LOWER, SPACE, buffers, cut, mix, numbered, release, remainder, restored, row_of, slices, spans, table, text_column, word_hashes
from graphloom.llm.quality_rules import labelled_sample

#: Words in a passage, buckets of the hashed bag, width of the encoding and of the attention.
PASSAGE, BUCKETS, WIDTH, GATE = 64, 64, 24, 16
#: At most so many labelled rows are learned from, the first by hash of the id.
SAMPLE_ROWS = 6_000
#: Passages of a text that training sees at most, at even distances.
BAG = 256
RATES = 10
#: A passage as it travels and waits to be learned from: a third of the bytes of its features.
PACKED = np.dtype([("rates", np.float32, RATES), ("words", np.uint8), ("bag", np.uint8, BUCKETS)])

_CLASSES = [np.isin(np.arange(256), list(x)) for x in (b"#*$%&|<>@^~{}[]\\/_=+", bytes(range(65, 91)), bytes(range(48, 58)), b"!?", b".,;:")]
_HEAD = (np.arange(256) & 0xC0) != 0x80


def packed_passages(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Rates and counts (PACKED) of each passage, and the number of passages before each row; a row without words has one passage of zeros."""
    data, ends = buffers(column)
    starts, stops, before = spans(data, ends)
    counts, rows = np.diff(before), len(ends) - 1
    bags = np.maximum(-(-counts // PASSAGE), 1)
    first = np.concatenate([[0], np.cumsum(bags)])
    row = row_of(before)
    place = np.arange(len(starts)) - before[:-1][row]
    passage = first[:-1][row] + place // PASSAGE
    total = int(first[-1])
    words = np.bincount(passage, minlength=total).astype(np.float32)
    hashes = word_hashes(LOWER[data], starts, stops)
    out = np.zeros(total, PACKED)
    x, out["words"] = out["rates"], words
    out["bag"] = np.bincount(passage * BUCKETS + (hashes >> np.uint64(58)).astype(np.int64), minlength=total * BUCKETS).reshape(total, BUCKETS)
    some = np.maximum(words, 1)

    def within(mask: np.ndarray) -> np.ndarray:
        upto = np.concatenate([[0], np.cumsum(mask)])
        return np.bincount(passage, upto[stops] - upto[starts], minlength=total)

    chars = within(_HEAD[data] & ~SPACE[data])
    for k, one in enumerate(_CLASSES):
        x[:, k] = np.minimum(within(one[data]) / some, 3)
    x[:, 5] = np.minimum(chars / some / 8, 4)
    keyed = hashes ^ mix(passage.astype(np.uint64) + np.uint64(1))
    order = np.argsort(keyed)
    fresh = np.concatenate([[True], keyed[order][1:] != keyed[order][:-1]])[: len(keyed)]
    x[:, 6] = np.bincount(passage[order][fresh], minlength=total) / some
    size = (stops - starts).astype(np.float64)
    mean = np.bincount(passage, size, minlength=total) / some
    x[:, 7] = np.sqrt(np.maximum(np.bincount(passage, size * size, minlength=total) / some - mean * mean, 0)) / 8
    x[:, 8] = np.bincount(passage, (stops - starts) == 1, minlength=total) / some
    x[:, 9] = np.log1p(words) / 5
    return out, first


def features(passages: np.ndarray) -> np.ndarray:
    """Features of each of the passages (PACKED)."""
    some = np.maximum(passages["words"], 1).astype(np.float32)
    return np.hstack([passages["rates"], np.sqrt(passages["bag"].astype(np.int64) / some[:, None]).astype(np.float32)])


def encode_passages(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Features of each passage, and the number of passages before each row."""
    passages, first = packed_passages(column)
    return features(passages), first


def _segments(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    return np.add.reduceat(x, first[:-1], axis=0)


class Model:
    """Encoder, gated attention and logistic head; float32 arrays by name."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        d = RATES + BUCKETS
        draw = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        self.w = {"W": draw(d, WIDTH), "b": np.zeros(WIDTH, np.float32), "V": draw(WIDTH, GATE), "U": draw(WIDTH, GATE), "a": draw(GATE, 1), "c": draw(WIDTH, 1), "c0": np.zeros(1, np.float32)}

    def forward(self, x: np.ndarray, first: np.ndarray) -> tuple:
        w, n = self.w, np.diff(first)
        h = np.tanh(x @ w["W"] + w["b"])
        t, g = np.tanh(h @ w["V"]), 1 / (1 + np.exp(-np.clip(h @ w["U"], -30, 30)))
        s = ((t * g) @ w["a"])[:, 0]
        e = np.exp(s - np.repeat(np.maximum.reduceat(s, first[:-1]), n))
        att = e / np.repeat(_segments(e, first), n)
        z = _segments(att[:, None] * h, first)
        p = 1 / (1 + np.exp(-np.clip((z @ w["c"])[:, 0] + w["c0"][0], -30, 30)))
        return h, t, g, att, z, p

    def gradients(self, x, first, y, weight) -> dict[str, np.ndarray]:
        w, n = self.w, np.diff(first)
        h, t, g, att, z, p = self.forward(x, first)
        d = ((p - y) * weight / len(y)).astype(np.float32)
        dz = d[:, None] @ w["c"].T
        dz_each = np.repeat(dz, n, axis=0)
        da = (dz_each * h).sum(1)
        ds = att * (da - np.repeat(_segments(att * da, first), n))
        dtg = ds[:, None] @ w["a"].T
        dt, dg = dtg * g * (1 - t * t), dtg * t * g * (1 - g)
        dh = (att[:, None] * dz_each + dt @ w["V"].T + dg @ w["U"].T) * (1 - h * h)
        return {"W": x.T @ dh, "b": dh.sum(0), "V": h.T @ dt, "U": h.T @ dg, "a": (t * g).T @ ds[:, None], "c": z.T @ d[:, None], "c0": d.sum(keepdims=True)}

    def train(self, bags: list[np.ndarray], y: np.ndarray, epochs: int = 12, batch: int = 128, rate: float = 4e-3, decay: float = 1e-4, seed: int = 11) -> Model:
        """Learn from the passages (PACKED) of each row and its label."""
        rng = np.random.default_rng(seed)
        m, v = ({k: np.zeros_like(a) for k, a in self.w.items()} for _ in range(2))
        share = y.mean()
        weight = np.where(y == 1, 0.5 / share, 0.5 / (1 - share)).astype(np.float32) ** 0.5  # halfway to balance
        step = 0
        for epoch in range(epochs):
            order = rng.permutation(len(bags))
            for at in range(0, len(order), batch):
                own = order[at : at + batch]
                first = np.concatenate([[0], np.cumsum([len(bags[i]) for i in own])])
                grads = self.gradients(features(np.concatenate([bags[i] for i in own])), first, y[own], weight[own])
                step += 1
                for k, gr in grads.items():
                    gr = gr + decay * self.w[k]
                    m[k] = 0.9 * m[k] + 0.1 * gr
                    v[k] = 0.999 * v[k] + 0.001 * gr * gr
                    self.w[k] = (self.w[k] - rate * (0.5 ** (epoch // 4)) * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        return self

    def score(self, x: np.ndarray, first: np.ndarray) -> np.ndarray:
        return self.forward(x, first)[-1].astype(np.float64)


class Constant:
    """Stands in where the sample lacks a label."""

    def __init__(self, value: float):
        self.value = value

    def score(self, x: np.ndarray, first: np.ndarray) -> np.ndarray:
        return np.full(len(first) - 1, self.value)


def fit(docs: DataFrame, labels: DataFrame, most: int = SAMPLE_ROWS):
    """A model of the labelled rows outside the held-out fold."""
    sample = labelled_sample(docs, labels, most, remainder("doc_id", 3) != 1)

    def run(batches):
        for batch in slices(batches):
            x, first = packed_passages(batch.column("text"))
            seen = lambda a, b: x[a:b] if b - a <= BAG else x[np.linspace(a, b - 1, BAG).astype(np.int64)]
            bags = pa.array([seen(*first[i : i + 2]).tobytes() for i in range(batch.num_rows)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), bags, batch.column("quality")], names=["doc_id", "bag", "quality"])

    bags = cut(sample.mapInArrow(run, "doc_id long, bag binary, quality int"), "bags")
    rows = sorted(bags.toLocalIterator())  # a row an id; a partition of them is in the driver's JVM at a time
    release(bags)
    y = np.array([r["quality"] for r in rows], np.float32)
    if len(set(y.tolist())) < 2:
        return Constant(float(y.mean()) if len(y) else 0.5)
    return Model().train([np.frombuffer(r["bag"], PACKED) for r in rows], y)


def score(docs: DataFrame, model) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of docs (doc_id, text)."""

    def run(batches):
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.score(*encode_passages(batch.column("text"))))], names=["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", (remainder("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that score at least 0.5, in the columns of docs. The model learns from the labelled rows of the raw table, as an earlier stage has dropped most bad ones.

    Null and empty texts are scored like any other; repeated rows stay or go together; an empty table gives none; without both labels every score is one constant.
    """
    model = fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))

    own, text = numbered(docs), text_column(docs)

    def run(batches):
        for batch in slices(batches, text):
            yield batch.filter(pa.array(model.score(*encode_passages(batch.column(text))) >= 0.5))

    return restored(own.mapInArrow(run, own.schema), docs)
