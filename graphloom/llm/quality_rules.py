"""Quality rules: a decision list learned by sequential covering, emitted as ordered Spark conditions.

``text_statistics`` measures each whole text in one Arrow pass. ``learn_rules`` grows and prunes threshold conjunctions for both
verdicts on a bounded sample of labelled rows; ``verdict`` turns them into one CASE expression over the statistics. The first rule
that covers a document decides, to reject or to keep, so a rule is only right about what those before it left over.

Defined cases: a null or empty text has no words, so the base rule rejects it; a document without labels only takes
part in scoring; with no labelled rows the list is empty and the base rule alone decides; repeated rows each give a row, and
one of them (the least hash of the text) stands for a labelled id in the sample; columns besides doc_id and text are ignored by the
query and given back by the stage, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from graphloom.llm.common import SPACE, buffers, mix, numbered, restored, row_of, slices, spans, table, text_column, windows, word_hashes

#: Symbols that mark junk.
SYMBOLS = b"#*$%&|<>"
#: At most so many labelled rows, the first by hash of the id, fit the rules.
SAMPLE_ROWS = 12_000

STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_digits", "n_marks", "n_distinct", "n_ends")

#: Features of the rules: name and numerator over denominator, in the statistics' columns.
RATIOS = {
    "mean_word": ("word_chars", "n_words"), "symbol_rate": ("n_symbols", "n_words"), "dup_line_rate": ("n_dup_lines", "n_lines"), "repeat_rate": ("n_repeat_words", "n_words"),
    "upper_rate": ("n_upper", "n_letters"), "digit_rate": ("n_digits", "word_chars"), "mark_rate": ("n_marks", "n_words"), "distinct_rate": ("n_distinct", "n_words"),
    "sentence_rate": ("n_ends", "n_words"), "words": ("n_words", None),
}

_SYMBOL = np.isin(np.arange(256), list(SYMBOLS))
_UPPER = np.isin(np.arange(256), list(range(65, 91)))
_LETTER = _UPPER | np.isin(np.arange(256), list(range(97, 123)))
_DIGIT = np.isin(np.arange(256), list(range(48, 58)))
_MARK = np.isin(np.arange(256), list(b"!?"))
_END = np.isin(np.arange(256), list(b".!?"))
_HEAD = (np.arange(256) & 0xC0) != 0x80


def measure(column: pa.Array) -> dict[str, np.ndarray]:
    """The statistics of each text of a column."""
    data, ends = buffers(column)
    starts, stops, before = spans(data, ends)
    row, rows = row_of(before), len(ends) - 1

    def per_row(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(mask)])
        return total[ends[1:]] - total[ends[:-1]]

    hashes = word_hashes(data, starts, stops)
    own = mix(np.arange(rows, dtype=np.uint64) + np.uint64(1))  # tells rows apart in one sort
    first, window = windows(hashes, before)
    keys = window ^ own[row[first]]
    order = np.argsort(keys)
    same = keys[order][1:] == keys[order][:-1]
    twice = np.zeros(len(keys), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    cover = np.zeros(len(hashes) + 1, np.int64)
    np.add.at(cover, first[twice], 1)
    np.add.at(cover, first[twice] + 5, -1)
    inside = np.cumsum(cover)[:-1] > 0
    keyed = hashes ^ own[row]
    order = np.argsort(keyed)
    fresh = np.concatenate([[True], keyed[order][1:] != keyed[order][:-1]])[: len(keyed)]
    n_distinct = np.bincount(row[order][fresh], minlength=rows)

    raw, dup, lines = data.tobytes(), np.zeros(rows, np.int64), np.zeros(rows, np.int64)
    for i in range(rows):
        seen: set[bytes] = set()
        for line in raw[ends[i] : ends[i + 1]].split(b"\n"):
            if line and not line.isspace():
                lines[i] += 1
                if line in seen:
                    dup[i] += 1
                else:
                    seen.add(line)
    last = data[stops - 1] if len(stops) else np.zeros(0, np.uint8)
    return {
        "n_words": np.diff(before), "word_chars": per_row(_HEAD[data] & ~SPACE[data]), "n_symbols": per_row(_SYMBOL[data]), "n_dup_lines": dup,
        "n_repeat_words": np.bincount(row[inside], minlength=rows), "n_lines": lines, "n_upper": per_row(_UPPER[data]), "n_letters": per_row(_LETTER[data]),
        "n_digits": per_row(_DIGIT[data]), "n_marks": per_row(_MARK[data]), "n_distinct": n_distinct, "n_ends": np.bincount(row[_END[last]], minlength=rows),
    }


def text_statistics(docs: DataFrame, *beside: str) -> DataFrame:
    """doc_id, STATS and the columns `beside` of every row of docs (doc_id, text)."""

    def run(batches):
        for batch in slices(batches):
            stats = measure(batch.column("text"))
            kept = [*(batch.column(x) for x in beside), *(pa.array(stats[x].astype(np.int64)) for x in STATS)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *kept], names=["doc_id", *beside, *STATS])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *beside, F.col("text").cast("string").alias("text"))
    return own.mapInArrow(run, StructType([own.schema["doc_id"], *(own.schema[x] for x in beside), *(StructField(x, LongType()) for x in STATS)]))


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20)


def feature(name: str) -> Column:
    """The feature as a double; 0 where its denominator is 0."""
    top, below = RATIOS[name]
    if below is None:
        return F.col(top).cast("double")
    return F.when(F.col(below) > 0, F.col(top).cast("double") / F.col(below)).otherwise(F.lit(0.0))


@dataclass(frozen=True)
class Rule:
    """A conjunction of (feature, '<=' or '>=', threshold) and its verdict, with its precision on the pruning rows and the rows that it decides rightly."""

    conditions: tuple[tuple[str, str, float], ...]
    keep: bool
    precision: float
    covered: int


def _covers(conditions, x: dict[str, np.ndarray], n: int) -> np.ndarray:
    out = np.ones(n, bool)
    for name, op, at in conditions:
        out &= x[name] <= at if op == "<=" else x[name] >= at
    return out


def _grow(x: dict[str, np.ndarray], grid: dict[str, np.ndarray], wanted: np.ndarray, grow: np.ndarray, longest: int) -> list[tuple[str, str, float]]:
    """Conditions added one by one by information gain about `wanted` among the rows `grow`."""
    conditions: list[tuple[str, str, float]] = []
    inside = grow.copy()
    while len(conditions) < longest and (inside & ~wanted).any():
        p0, n0 = (inside & wanted).sum(), (inside & ~wanted).sum()
        if not p0:
            break
        best = (0.0, None)
        for name, cutpoints in grid.items():
            v, own = x[name][inside], wanted[inside]
            for op in ("<=", ">="):
                hit = v[:, None] <= cutpoints if op == "<=" else v[:, None] >= cutpoints
                p, q = hit[own].sum(0), hit[~own].sum(0)
                gain = np.where(p > 0, p * (np.log2(np.maximum(p, 1e-9) / np.maximum(p + q, 1e-9)) - np.log2(p0 / (p0 + n0))), 0)
                k = int(np.argmax(gain))
                if gain[k] > best[0] + 1e-9:
                    best = (float(gain[k]), (name, op, float(cutpoints[k])))
        if best[1] is None:
            break
        conditions.append(best[1])
        inside &= _covers(conditions[-1:], x, len(wanted))
    return conditions


def learn_rules(x: dict[str, np.ndarray], reject: np.ndarray, least_precision: float = 0.97, least_keep: float = 0.995, slack: float = 0.03, least_cover: int = 8, longest: int = 4, most_rules: int = 24, cuts: int = 48) -> list[Rule]:
    """Sequential covering over both verdicts: grow a conjunction for each on two thirds of what is left, prune it on the other third, take the one that rejects or, if none is precise enough, the one that keeps, drop what it covers, repeat."""
    n, rules = len(reject), []
    if not reject.any() or reject.all():
        return rules
    third = np.arange(n) % 3 == 2
    live = np.ones(n, bool)
    grid = {name: np.unique(np.quantile(v, np.linspace(0, 1, cuts))) for name, v in x.items()}
    while len(rules) < most_rules and (reject & live).any():
        found = []
        for keep, wanted, least in ((False, reject, least_precision), (True, ~reject, least_keep)):
            conditions = _grow(x, grid, wanted, live & ~third, longest)
            options = []
            for k in range(1, len(conditions) + 1):
                hit = live & _covers(conditions[:k], x, n)
                p, q = (hit & third & wanted).sum(), (hit & third & ~wanted).sum()
                whole = (hit & wanted).sum() / max(hit.sum(), 1)
                if p and p / (p + q) >= least - slack and whole >= least and (hit & wanted).sum() >= least_cover:
                    options.append((p / (p + q), int((hit & wanted).sum()), -k))
            if options:
                precision, covered, k = max(options)
                found.append((not keep, precision, Rule(tuple(conditions[:-k]), keep, float(precision), covered)))
        if not found:
            break
        rule = max(found, key=lambda f: f[:2])[2]
        rules.append(rule)
        live &= ~_covers(rule.conditions, x, n)
    while rules and rules[-1].keep:  # the default keeps
        rules.pop()
    return rules


def verdict(rules: list[Rule]) -> Column:
    """Whether a document is kept: as the first rule that covers it says; it stays if none does."""
    out = None
    for rule in rules:
        held = None
        for name, op, at in rule.conditions:
            one = feature(name) <= F.lit(at) if op == "<=" else feature(name) >= F.lit(at)
            held = one if held is None else held & one
        out = F.when(held, F.lit(rule.keep)) if out is None else out.when(held, F.lit(rule.keep))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def labelled_sample(docs: DataFrame, labels: DataFrame, most: int, keep: Column | None = None) -> DataFrame:
    """(doc_id, text, quality) of at most `most` labelled documents, a row an id: the first by hash of the id, so that reruns agree. Their ids are broadcast; `most` bounds them."""
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("doc_id is not null and quality in (0, 1)")
    own = own.groupBy("doc_id").agg(F.max("quality").alias("quality"))
    own = (own if keep is None else own.where(keep)).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(F.broadcast(own), "doc_id")
    return rows.groupBy("doc_id", "quality").agg(F.min_by("text", F.struct(F.xxhash64("text"), F.length("text"))).alias("text"))


def fit(docs: DataFrame, labels: DataFrame, most: int = SAMPLE_ROWS) -> list[Rule]:
    rows = text_statistics(labelled_sample(docs, labels, most), "quality").where(~base_failed())
    rows = rows.select("doc_id", "quality", *(feature(x).alias(x) for x in RATIOS)).toPandas().sort_values("doc_id")  # a row an id, at most `most`
    return learn_rules({x: rows[x].to_numpy(float) for x in RATIOS}, rows["quality"].to_numpy() == 0)


def apply_rules(docs: DataFrame, labels: DataFrame, most: int = SAMPLE_ROWS) -> DataFrame:
    """Statistics of every document, base_failed and kept."""
    rules = fit(docs, labels, most)
    return text_statistics(docs).withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & verdict(rules))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the rules keep, in the columns of docs. The verdict is made beside the text, in the same Arrow pass, so nothing is joined.

    Null and empty texts go (the base rule); repeated rows stay or go together; an empty table gives none; without labels the base rule alone decides.
    """
    rules = fit(docs, table(spark, sf_dir, "labels"))
    own, text = numbered(docs), text_column(docs)

    def run(batches):
        for batch in slices(batches, text):
            stats = measure(batch.column(text))
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(stats[x].astype(np.int64)) for x in STATS)], names=[*batch.schema.names, *STATS])

    both = own.mapInArrow(run, StructType([*own.schema, *(StructField(x, LongType()) for x in STATS)]))
    return restored(both.where(~base_failed() & verdict(rules)), docs)
