"""Token ids as length-delimited binary records, with a separate offset index.

A file holds frames, one a document, in ascending doc_id order; the files' numbers (task, then part) continue that order. Files are closed by
their bytes, so that reading one into a task stays small however large the corpus. A frame is

    u64 length of the payload | u32 masked CRC-32 of those 8 bytes | payload | u32 masked CRC-32 of the payload | 0x0A

all little-endian; the last byte is the writer's record separator. The mask is rotate right by 15 bits plus 0xA282EAD8. A payload
is i64 doc_id, u8 flags (1: the id is null), u8 width of an id (2 or 4), u32 number of ids, ids. Files are written and read by Spark
alone (its text writer takes raw bytes, binaryFile gives them back), so any store that Spark knows will do. The index has
doc_id, shard, offset, length, n_tokens, ids before it in the shard and their CRC-32; it is made by reading the files, which checks every frame.

Defined cases: null text counts as empty and gives the end id alone; null ids come first; repeated ids are ordered by the
text's hash; an empty table gives no frames and no rows; columns besides doc_id and text are ignored.
"""

from __future__ import annotations

import json
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.llm.bpe import CachedEncoder, default_path, hash_of, kept_encoder, split_words
from graphloom.llm.common import scratch_path, slices, table

END_ID = 2
#: Input bytes that a task writes, about, and tasks at most, so that the range sampler still sees each; beyond that a task writes more files.
SHARD_BYTES, MOST_SHARDS = 16 << 20, 1 << 17
#: A file is closed after so many pieces, each of at least PIECE_BYTES of frames or the last of its batch: no larger than FILE_PIECES pieces and their last frames.
PIECE_BYTES, FILE_PIECES = 1 << 20, 16
#: A shard is a file: its task's number above these bits, its number within the task in them.
PART_BITS = 24
_HEAD = struct.Struct("<qBBI")
INDEX = "doc_id long, shard long, offset long, length long, n_tokens long, before long, ids_crc32 long"


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + 0xA282EAD8) & 0xFFFFFFFF


def frame(doc_id: int | None, ids: np.ndarray, width: int) -> bytes:
    payload = _HEAD.pack(doc_id or 0, doc_id is None, width, len(ids)) + ids.astype(f"<u{width}").tobytes()
    length = struct.pack("<Q", len(payload))
    return length + struct.pack("<I", masked(length)) + payload + struct.pack("<I", masked(payload))


def parse(data, at: int) -> tuple[int | None, np.ndarray, int]:
    """doc_id and ids of the frame at a byte offset, and the offset after it; raises ValueError if a checksum fails."""
    size, check = struct.unpack_from("<QI", data, at)
    if masked(bytes(data[at : at + 8])) != check:
        raise ValueError(f"record at {at}: its length is damaged")
    payload = bytes(data[at + 12 : at + 12 + size])
    if len(payload) != size or masked(payload) != struct.unpack_from("<I", data, at + 12 + size)[0]:
        raise ValueError(f"record at {at}: its payload is damaged")
    doc_id, null, width, n = _HEAD.unpack_from(payload)
    return None if null else doc_id, np.frombuffer(payload, f"<u{width}", n, _HEAD.size), at + 12 + size + 5


class Library:
    """The tokenizers library over many pieces at once, with a special token between them."""

    def __init__(self, spec: str, sentinel: str = "<|endoftext|>"):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer

        self.own, self.sentinel = Tokenizer.from_str(spec), sentinel
        self.stop = self.own.token_to_id(sentinel)
        self.find = regex.compile(json.loads(spec)["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"] + "|\n").findall

    def split(self, words: list[bytes]) -> tuple[list[bytes], np.ndarray]:
        """Plain words are split here as the library splits them; others go to it whole."""
        return split_words(words, self.find, lambda word: [word])

    def encode_pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        out, counts = [], np.zeros(len(pieces), np.int64)
        for at in range(0, len(pieces), 2048):
            part = [w.decode("utf-8", "replace") for w in pieces[at : at + 2048]]
            odd = {k: self.own.encode(w, add_special_tokens=False).ids for k, w in enumerate(part) if "<|" in w}
            joined = self.sentinel.join("" if k in odd else w for k, w in enumerate(part))
            ids = np.array(self.own.encode_batch_fast([joined], add_special_tokens=False)[0].ids, np.int64)
            ends = np.append(np.flatnonzero(ids == self.stop), len(ids))
            starts = np.concatenate([[0], ends[:-1] + 1])
            counts[at : at + len(part)] = ends - starts
            if odd:
                for k in range(len(part)):
                    out.append(np.array(odd[k], np.int64) if k in odd else ids[starts[k] : ends[k]])
                    counts[at + k] = len(out[-1])
            else:
                out.append(ids[ids != self.stop])
        return np.concatenate(out) if out else np.zeros(0, np.int64), counts


def library_encoder(spec: str) -> CachedEncoder:
    own = Library(spec)
    return CachedEncoder(own.split, own.encode_pieces)


def _shards(docs: DataFrame) -> int:
    """As many shards as the input has pieces of SHARD_BYTES, by the scan's own splits, and at most MOST_SHARDS, which then are larger."""
    spark = docs.sparkSession
    split = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.files.maxPartitionBytes"))
    return min(MOST_SHARDS, max(1, docs.rdd.getNumPartitions() * max(1, -(-split // SHARD_BYTES))))


def write_records(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = END_ID) -> None:
    """Encode every whole text and write the frames under path. Rows are dealt by ranges of doc_id before the costly encoding."""
    spark = docs.sparkSession
    with open(tokenizer or default_path(), encoding="utf-8") as f:
        spec = spark.sparkContext.broadcast(f.read())

    def run(batches):
        width = 2 if max(json.loads(spec.value)["model"]["vocab"].values()) < 60_000 else 4
        encoder = kept_encoder(("library", hash_of(spec.value)), lambda: library_encoder(spec.value))
        for batch in slices(batches):
            ids, ends = encoder.encode(batch.column("text"))
            ends = ends.tolist()
            frames = [frame(d, np.append(ids[a:b], end_id), width) for d, a, b in zip(batch.column("doc_id").to_pylist(), ends[:-1], ends[1:], strict=True)]
            pieces, size = [[]], 0
            for x in frames:
                if size >= PIECE_BYTES:
                    pieces, size = [*pieces, []], 0
                pieces[-1].append(x)
                size += len(x)
            yield pa.RecordBatch.from_arrays([pa.array([b"\n".join(x) for x in pieces], pa.binary())], names=["value"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # the row's place in the scan splits a range of equal rows, which are interchangeable
    own = own.withColumn("place", F.monotonically_increasing_id())
    order = [F.col("doc_id"), F.xxhash64("text"), F.col("place")]
    dealt = own.repartitionByRange(_shards(own), *order).sortWithinPartitions(*order)
    dealt.select("doc_id", "text").mapInArrow(run, "value binary").select(F.col("value").cast("string")).write.option("lineSep", "\n").option("maxRecordsPerFile", FILE_PIECES).text(path)
    spec.destroy()


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """One row a file: its shard number and bytes."""
    number = lambda k: F.regexp_extract("path", r"part-(\d+)-[^/]*-c(\d+)[^/]*$", k).cast("long")
    return spark.read.format("binaryFile").load(path).select((F.shiftleft(number(1), PART_BITS) + number(2)).alias("shard"), "content")


def index_files(spark: SparkSession, path: str) -> DataFrame:
    """The index, made by reading every frame and checking it."""

    def run(batches):
        for batch in batches:
            for shard, content in zip(batch.column("shard"), batch.column("content"), strict=True):
                data, at, before, rows = memoryview(content.as_buffer()), 0, 0, []
                while at < len(data):
                    doc_id, ids, to = parse(data, at)
                    rows.append((doc_id, at, to - at, len(ids), before, zlib.crc32(ids.astype("<u4").tobytes())))
                    at, before = to, before + len(ids)
                doc_id, *rest = zip(*rows, strict=True) if rows else [[]] * 6
                doc_id, offset, length, n, upto, crc = (pa.array(x, pa.int64()) for x in (doc_id, *rest))
                yield pa.RecordBatch.from_arrays([doc_id, pa.array([shard.as_py()] * len(rows), pa.int64()), offset, length, n, upto, crc], names=["doc_id", "shard", "offset", "length", "n_tokens", "before", "ids_crc32"])

    return read_files(spark, path).mapInArrow(run, INDEX)


def write_index(spark: SparkSession, path: str, index_path: str) -> DataFrame:
    index_files(spark, path).write.parquet(index_path)
    return spark.read.schema(INDEX).parquet(index_path)


def with_starts(index: DataFrame) -> DataFrame:
    """Adds start: the number of ids of all documents before. One window runs over the files of each task, another over one row a task."""
    task = F.shiftright("shard", PART_BITS)
    totals = index.groupBy("shard").agg(F.sum("n_tokens").alias("n")).withColumn("task", task)
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    tasks = totals.groupBy("task").agg(F.sum("n").alias("n")).select("task", before(Window.orderBy("task")).alias("task_base"))
    files = totals.select("task", "shard", before(Window.partitionBy("task").orderBy("shard")).alias("file_base"))
    bases = files.join(tasks, "task").select("shard", (F.col("task_base") + F.col("file_base")).alias("base"))
    return index.join(bases, "shard").withColumn("start", F.col("base") + F.col("before")).drop("base")


def read_shuffled(spark: SparkSession, path: str, index: DataFrame, seed: int = 0) -> DataFrame:
    """(doc_id, ids) in an order drawn by the seed: the index's offsets cut each record out of its file, then a range sort by the draw deals them."""
    places = index.groupBy("shard").agg(F.collect_list("offset").alias("offsets"))  # bounded by a shard's file

    def run(batches):
        for batch in batches:
            for content, offsets in zip(batch.column("content"), batch.column("offsets"), strict=True):
                data = memoryview(content.as_buffer())
                found = [parse(data, at)[:2] for at in offsets.as_py()]
                yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in found], pa.int64()), pa.array([x.tolist() for _, x in found], pa.list_(pa.int32()))], names=["doc_id", "ids"])

    rows = read_files(spark, path).join(places, "shard").select("content", "offsets").mapInArrow(run, "doc_id long, ids array<int>")
    return rows.withColumn("draw", F.xxhash64(F.lit(seed), F.col("doc_id"))).orderBy("draw", "doc_id").drop("draw")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "token_records")
    write_records(table(spark, sf_dir, "documents"), f"{path}/records")
    index = write_index(spark, f"{path}/records", f"{path}/index")
    return with_starts(index).select("doc_id", "start", "n_tokens", "ids_crc32", "shard", "offset", "length")
