"""Shared helpers: table access, folds, and vectorised text scanning."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.storage import cut, release, scratch_path, shared_dir

__all__ = ["CRC_SQL", "buffers", "crc_sql", "cut", "mix", "numbered", "quoted", "release", "restored", "remainder", "row_of", "small_batches", "scratch_path", "shared_dir", "slices", "spans", "table", "windows", "word_hashes"]

#: Texts are scanned in slices of about this many bytes, so that scratch arrays stay small.
SLICE_BYTES = 2 << 20


#: Bytes and rows of the Arrow batches in which whole texts pass between the JVM and Python workers.
BATCH_BYTES, BATCH_ROWS = 4 << 20, 2048


def small_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small: whole texts are long, and a batch lives several times over in buffers outside the heap. Smaller settings of the session stay."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = spark.conf.get(key, None)
        if not (now and now.isdigit() and 0 < int(now) <= most):
            spark.conf.set(key, str(most))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder, by Spark's own reader."""
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quoted(name: str) -> str:
    """A column's name as one part of a path."""
    return "`" + name.replace("`", "``") + "`"


def numbered(docs: DataFrame) -> DataFrame:
    """The columns renamed c0, c1, ... in order, so that no name of a caller's column can clash or need quoting; text becomes a string."""
    out = docs.toDF(*(f"c{k}" for k in range(len(docs.columns))))
    return out.withColumn(text_column(docs), F.col(text_column(docs)).cast("string"))


def text_column(docs: DataFrame) -> str:
    """What numbered() calls the column text."""
    return f"c{docs.columns.index('text')}"


def restored(own: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of docs, by their own names, of a frame that numbered() began."""
    return own.select(*(F.col(f"c{k}").alias(c) for k, c in enumerate(docs.columns)))


def remainder(col: str, modulus: int):
    """crc32(doc_id as text) mod modulus; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit(""))) % modulus


#: crc32 of a decimal text as DuckDB's functions: the table is derived from the polynomial, the fold goes byte by byte.
CRC_SQL = r"""crc_table AS (SELECT list(v ORDER BY n) AS t FROM (SELECT n, list_reduce([n] || range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS v FROM (SELECT unnest(range(256)) AS n)))"""


def crc_sql(value: str) -> str:
    """SQL of crc32(decimal value) in a query that has crc_table (t) beside it; null counts as empty text."""
    return f"(CASE WHEN {value} IS NULL THEN 0 ELSE xor(4294967295, list_reduce([4294967295] || list_transform(string_split(CAST({value} AS VARCHAR), ''), lambda ch: CAST(ascii(ch) AS BIGINT)), lambda c, b: xor(t[CAST(xor(c, b) & 255 AS BIGINT) + 1], c >> 8))) END)"


# --- text scanning -------------------------------------------------------------------------------

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_M1, _M2, _M3 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
#: Longer words are hashed one by one.
_LONG = 256


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Record batches cut so that each holds about `most` bytes of the column, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = buffers(batch.column(column))[1]
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + most, "right")) - 1)
            yield batch.slice(at, to - at)
            at = to


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string or binary column; null counts as empty."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, ends - ends[0]


def spans(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and stops of the words [^\\x20\\x09-\\x0D]+ and the number of words before each row (one more entry than rows)."""
    if not len(data):
        empty = np.zeros(0, np.int64)
        return empty, empty, np.zeros(len(ends), np.int64)
    solid = ~SPACE[data]
    before, after = np.empty_like(solid), np.empty_like(solid)
    before[0], before[1:] = False, solid[:-1]
    before[ends[:-1][ends[:-1] < len(data)]] = False
    after[-1], after[:-1] = False, solid[1:]
    after[ends[1:][ends[1:] > 0] - 1] = False
    starts = np.flatnonzero(solid & ~before)
    return starts, np.flatnonzero(solid & ~after) + 1, np.searchsorted(starts, ends)


def word_hashes(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes, the same in every process."""
    import hashlib

    padded = np.concatenate([data, np.zeros(16, np.uint8)])
    window = np.ndarray(shape=(len(data) + 8,), dtype="<u8", buffer=padded, strides=(1,))
    size = stops - starts
    out = mix(size.astype(np.uint64) * _M3)
    live, k = np.flatnonzero(size <= _LONG), 0
    while len(live):
        left = np.minimum(size[live] - k, 8).astype(np.uint64)
        part = window[starts[live] + k]
        part &= np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - left * np.uint64(8))
        out[live] = mix(out[live] * _M3 + part)
        k += 8
        live = live[size[live] > k]
    for i in np.flatnonzero(size > _LONG):
        out[i] = np.frombuffer(hashlib.blake2b(data[starts[i] : stops[i]].tobytes(), digest_size=8).digest(), "<u8")[0]
    return out


def windows(hashes: np.ndarray, before: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """First word index and 64-bit hash of each window of `width` words that lies in one row."""
    counts = np.diff(before)
    per_row = np.maximum(counts - width + 1, 0)
    first = np.repeat(before[:-1] - np.concatenate([[0], np.cumsum(per_row)[:-1]]), per_row) + np.arange(per_row.sum())
    out = np.zeros(len(first), np.uint64)
    for k in range(width):
        out = mix(out * _M3 + hashes[first + k])
    return first, out


def row_of(before: np.ndarray) -> np.ndarray:
    """The row of each word."""
    return np.repeat(np.arange(len(before) - 1), np.diff(before))
