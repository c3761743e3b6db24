"""Token-id files: each document's ids compressed on their own under one shared, trained zstandard dictionary.

A store is a folder in any file system that Spark reaches:

``dictionary`` one row: the dictionary's bytes, their SHA-256 and the id width.
``blocks``     rows in ascending document order; a row is a block of documents: block number, its
               first and last document, the index (document ids, frame offsets, id counts, as
               little-endian integers; how many documents, the first ones, have a null id), the
               dictionary's hash, and the frames end to end.

A document is read by its block (Parquet statistics on first_doc/last_doc find it), the offset index
and one frame. A block is closed at BLOCK_BYTES, so a task's memory is bounded by that and one document.
The dictionary is trained on at most SAMPLE_DOCS documents (those with the smallest hashed keys), of
which SAMPLE_IDS ids each; it is a codec parameter: whatever it is, all documents are stored exactly.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import encoder
from .shared import small_batches, tidy
from .textops import chunks, string_buffers

BLOCK_BYTES = 4 << 20
DICT_BYTES = 64 << 10
SAMPLE_DOCS = 1000
SAMPLE_IDS = 4096
LEVEL = 3

BLOCK_SCHEMA = "block long, first_doc long, last_doc long, n_docs int, n_ids long, dict_sha256 string, doc_ids binary, frame_offsets binary, counts binary, frames binary, n_null int"


def serialize(ids: np.ndarray) -> bytes:
    return np.ascontiguousarray(ids, "<u4").tobytes()


def train(docs: DataFrame, tokenizer_path: str, key: str = "doc_id", text: str = "text") -> bytes:
    """The dictionary; empty (which means none) when the sample is too small to train on."""
    import zstandard

    # The keys first: a sort for the smallest sends that many rows from each task, which should not be texts.
    keys = {r[0] for r in docs.filter(F.col(key).isNotNull()).select(key).orderBy(F.xxhash64(key), key).limit(SAMPLE_DOCS).collect()}
    head = F.coalesce(F.substring(text, 1, 8 * SAMPLE_IDS), F.lit(""))
    rows = docs.filter(F.col(key).isin(sorted(keys))).groupBy(key).agg(F.min(F.struct(F.xxhash64(text), head)).alias("t")).select(key, "t.*").collect() if keys else []  # one text of a repeated key
    ids = encoder(tokenizer_path).encode([r[2] for r in sorted(rows)])
    try:
        return zstandard.train_dictionary(DICT_BYTES, [serialize(x[:SAMPLE_IDS]) for x in ids if len(x) >= 2]).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b""


def _compressor(dictionary: bytes):
    import zstandard

    return zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)


def _decompressor(dictionary: bytes):
    import zstandard

    return zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)


def write(docs: DataFrame, path: str, tokenizer_path: str, end_id: int | None = 2, key: str = "doc_id", text: str = "text", partitions: int | None = None) -> None:
    """Encode, append end_id, and write a store in ascending order of key.

    Null text is an empty one. Rows with equal keys are documents of their own, side by side; rows
    whose key is null come first. An empty table gives a store without blocks.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    dictionary = train(docs, tokenizer_path, "doc_id", "text")
    sha = hashlib.sha256(dictionary).hexdigest()
    spark.createDataFrame([(bytearray(dictionary), sha, 4)], "dictionary binary, sha256 string, id_bytes int").coalesce(1).write.parquet(f"{path}/dictionary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, zip_ = encoder(tokenizer_path), _compressor(dictionary)
        number = TaskContext.get().partitionId() << 33
        keys: list = []
        frames: list[bytes] = []
        counts: list[int] = []
        size = 0

        def close() -> pa.RecordBatch:
            nonlocal number, size
            offsets = np.concatenate([[0], np.cumsum([len(f) for f in frames])]).astype("<i8")
            # Null keys are first in order. They are written as the least long; n_null tells them from a key of that value.
            plain = np.array([-(2**63) if k is None else k for k in keys], "<i8")
            row = (number, int(plain[0]), int(plain[-1]), len(keys), sum(counts), sha, plain.tobytes(), offsets.tobytes(), np.array(counts, "<i8").tobytes(), b"".join(frames), sum(k is None for k in keys))
            out = pa.RecordBatch.from_pylist([dict(zip(BLOCK_NAMES, row))], schema=BLOCK_ARROW)
            number, size = number + 1, 0
            keys.clear(), frames.clear(), counts.clear()
            return out

        for batch in batches:
            _, offsets = string_buffers(batch.column(1))
            for a, b in chunks(offsets):
                texts = ["" if t is None else t for t in batch.column(1).slice(a, b - a).to_pylist()]
                for k, ids in zip(batch.column(0).slice(a, b - a).to_pylist(), enc.encode(texts)):
                    if end_id is not None:
                        ids = np.append(ids, np.int32(end_id))
                    keys.append(k)
                    frames.append(zip_.compress(serialize(ids)))
                    counts.append(len(ids))
                    size += len(frames[-1])
                    if size >= BLOCK_BYTES:
                        yield close()
        if keys:
            yield close()

    ordered = docs.repartitionByRange(*([partitions] if partitions else []), "doc_id").sortWithinPartitions("doc_id")
    ordered.mapInArrow(tidy(run, ("bpe",)), BLOCK_SCHEMA).write.option("compression", "uncompressed").parquet(f"{path}/blocks")


BLOCK_NAMES = [x.split()[0] for x in BLOCK_SCHEMA.split(", ")]
_ARROW = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}
BLOCK_ARROW = pa.schema([(n, _ARROW[x.split()[1]]) for n, x in zip(BLOCK_NAMES, BLOCK_SCHEMA.split(", "))])


def load_dictionary(spark: SparkSession, path: str) -> tuple[bytes, str]:
    row = spark.read.parquet(f"{path}/dictionary").first()
    if hashlib.sha256(row["dictionary"]).hexdigest() != row["sha256"]:
        raise ValueError(f"{path}: the dictionary does not match its hash")
    return bytes(row["dictionary"]), row["sha256"]


def decode_block(row: dict, unzip, which: range | None = None) -> Iterator[tuple[int | None, np.ndarray]]:
    """(document id or None, ids) of a block's documents; which: their places in it, by default all. Only their frames are looked at."""
    keys, at = np.frombuffer(row["doc_ids"], "<i8"), np.frombuffer(row["frame_offsets"], "<i8")
    counts = np.frombuffer(row["counts"], "<i8")
    for i in which if which is not None else range(len(keys)):
        ids = np.frombuffer(unzip.decompress(row["frames"][at[i] : at[i + 1]]), "<u4")
        if len(ids) != counts[i]:
            raise ValueError("a frame does not hold the number of ids that the index says")
        yield None if i < row["n_null"] else int(keys[i]), ids


def read(spark: SparkSession, path: str) -> DataFrame:
    """A row for each document in the files: doc_id, start (ids of all documents before it), n_tokens, ids (little-endian unsigned 32-bit integers)."""
    dictionary, sha = load_dictionary(spark, path)
    blocks = spark.read.parquet(f"{path}/blocks")
    # Two levels, so that no task sees all blocks: totals of each writing task's blocks, then starts inside it.
    index = blocks.select("block", "n_ids", F.shiftright("block", 33).alias("part"))
    before = index.groupBy("part").agg(F.sum("n_ids").alias("ids")).orderBy("part").collect()  # one number for each file of the store
    run, starts = 0, []
    for r in before:
        starts.append((r["part"], run))
        run += r["ids"]
    from pyspark.sql import Window

    inside = index.withColumn("inside", F.sum("n_ids").over(Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)))
    base = spark.createDataFrame(starts, "part long, base long")
    index = inside.join(base, "part").select("block", (F.col("base") + F.coalesce("inside", F.lit(0))).alias("start"))

    def run_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unzip = _decompressor(dictionary)
        for batch in batches:
            for row in batch.to_pylist():
                if row["dict_sha256"] != sha:
                    raise ValueError("a block was written under another dictionary")
                docs, start, size = ([], [], [], []), row["start"], 0
                for k, ids in decode_block(row, unzip):
                    for col, v in zip(docs, (k, start, len(ids), ids.tobytes())):
                        col.append(v)
                    start += len(ids)
                    size += ids.nbytes
                    if size > BLOCK_BYTES:
                        yield _doc_rows(docs)
                        docs, size = ([], [], [], []), 0
                if docs[0]:
                    yield _doc_rows(docs)

    return blocks.join(index, "block").select("start", *BLOCK_NAMES).mapInArrow(tidy(run_), "doc_id long, start long, n_tokens long, ids binary")


def _doc_rows(cols) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["doc_id", "start", "n_tokens", "ids"])


def fetch(spark: SparkSession, path: str, doc_id: int) -> list[np.ndarray]:
    """The ids of one document (of each row with that key): one or two blocks, and one frame each."""
    dictionary, _ = load_dictionary(spark, path)
    unzip, out = _decompressor(dictionary), []
    for row in spark.read.parquet(f"{path}/blocks").filter((F.col("first_doc") <= doc_id) & (F.col("last_doc") >= doc_id)).orderBy("block").collect():
        keys = np.frombuffer(row["doc_ids"], "<i8")
        a, b = row["n_null"] + np.searchsorted(keys[row["n_null"] :], doc_id), np.searchsorted(keys, doc_id, "right")
        out += [ids for _, ids in decode_block(row.asDict(), unzip, range(a, b))]
    return out
