"""Exact token counts at every prefix of a text, stored once and then asked without encoding again.

Counts come from prefix dynamic programming (see bpe.BatchEncoder). They are stored as the steps
between neighbouring prefixes, two bytes each, with an index of the running count every STRIDE
characters; ``tokens_at`` and ``longest_within`` answer truncation and budget questions from them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import encoder
from .shared import small_batches, tidy
from .textops import chunks, string_buffers

STRIDE = 1024


def pack_counts(counts: np.ndarray) -> bytes:
    """counts[i]: tokens of the prefix of i characters. Steps as int16; a count whose steps don't fit is stored as int32."""
    steps = np.diff(counts)
    if len(steps) and np.abs(steps).max() > 32_767:
        return b"w" + counts.astype("<i4").tobytes()
    return b"s" + counts[::STRIDE].astype("<i4").tobytes() + steps.astype("<i2").tobytes()


def unpack_counts(blob: bytes, n_chars: int) -> np.ndarray:
    if blob[:1] == b"w":
        return np.frombuffer(blob, "<i4", offset=1)
    marks = n_chars // STRIDE + 1
    return np.concatenate([[0], np.cumsum(np.frombuffer(blob, "<i2", offset=1 + 4 * marks), dtype=np.int64)])


def tokens_at(blob: bytes, n_chars: int, prefix: int) -> int:
    """Tokens of the first prefix characters, from the nearest mark before."""
    prefix = max(0, min(prefix, n_chars))
    if blob[:1] == b"w":
        return int(np.frombuffer(blob, "<i4", 1, 1 + 4 * prefix)[0])
    marks, m = n_chars // STRIDE + 1, prefix // STRIDE
    at = int(np.frombuffer(blob, "<i4", 1, 1 + 4 * m)[0])
    return at + int(np.frombuffer(blob, "<i2", prefix - m * STRIDE, 1 + 4 * marks + 2 * m * STRIDE).sum(dtype=np.int64))


def longest_within(blob: bytes, n_chars: int, budget: int) -> int:
    """Characters of the longest prefix of at most budget tokens. (Counts may fall as a prefix grows, so all are looked at.)"""
    return int(np.flatnonzero(unpack_counts(blob, n_chars) <= budget)[-1]) if budget >= 0 else 0


def count_tokens(docs: DataFrame, tokenizer_path: str, key: str = "doc_id", text: str = "text", budget: int = 512, keep_prefixes: bool = False) -> DataFrame:
    """A row for each document: doc_id, n_bytes, n_chars, n_tokens, fits_chars (of the longest prefix within the budget) and, if asked, prefix_counts.

    Null text is an empty one (0 tokens). Rows with equal keys stay rows of their own, and null keys stay null. An empty
    table gives none. Other columns are not looked at. One pass, no shuffle; a very long text is one chunk of its own, in time
    and memory that grow with its length, whatever its characters.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer_path)
        for batch in batches:
            _, offsets = string_buffers(batch.column(1))
            for a, b in chunks(offsets, 1 << 19):
                texts = ["" if t is None else t for t in batch.column(1).slice(a, b - a).to_pylist()]
                counts = enc.count_prefixes(texts)
                cols = [
                    batch.column(0).slice(a, b - a),
                    pa.array(np.diff(offsets[a : b + 1])),
                    pa.array([len(t) for t in texts], pa.int64()),
                    pa.array([int(c[-1]) for c in counts], pa.int64()),
                    pa.array([int(np.flatnonzero(c <= budget)[-1]) for c in counts], pa.int64()),
                ]
                names = ["doc_id", "n_bytes", "n_chars", "n_tokens", "fits_chars"]
                if keep_prefixes:
                    cols.append(pa.array([pack_counts(c) for c in counts], pa.binary()))
                    names.append("prefix_counts")
                yield pa.RecordBatch.from_arrays(cols, names=names)

    schema = "doc_id long, n_bytes long, n_chars long, n_tokens long, fits_chars long" + ", prefix_counts binary" * keep_prefixes
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(tidy(run, ("bpe",)), schema)
