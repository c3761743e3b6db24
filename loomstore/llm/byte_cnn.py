"""Document quality by a byte-level convolutional network in numpy.

Bytes are embedded (learned), learned filters of WIDTH bytes slide over the text in steps of STRIDE,
in chunks that overlap by WIDTH - STRIDE so that no filter position is lost and the whole document is
covered, responses pass a ReLU, and each filter's maximum and mean over all chunks are combined into
one probability by a learned linear layer. A document's result does not depend on the chunk size.

Training is on the driver, on at most `max_train` labelled documents (those with the smallest hashed
ids, as many of each label as there are, up to half of that). Of each, a window of TRAIN_CHARS characters at a hashed place of
its whole text is fetched, and each round of training draws TRAIN_BYTES from that; it is deterministic. Scoring covers every byte of every document, in one pass without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import small_batches, tidy
from .textops import string_buffers

EMBED, WIDTH, STRIDE, FILTERS = 6, 8, 4, 24
CHUNK_STEPS = 2048
MAX_TRAIN, TRAIN_CHARS, TRAIN_BYTES, EPOCHS, BATCH = 1600, 4096, 1024, 5, 32


def _start(seed: int = 7) -> dict[str, np.ndarray]:
    r = np.random.Generator(np.random.PCG64(seed))
    return {
        "embed": (r.standard_normal((257, EMBED)) * 0.5).astype(np.float32),
        "filters": (r.standard_normal((WIDTH * EMBED, FILTERS)) * np.sqrt(2 / (WIDTH * EMBED))).astype(np.float32),
        "shift": np.zeros(FILTERS, np.float32),
        "out": (r.standard_normal(2 * FILTERS) * 0.1).astype(np.float32),
        "bias": np.zeros(1, np.float32),
    }


def _windows(codes: np.ndarray) -> np.ndarray:
    """codes padded to a whole number of steps -> (steps, WIDTH), without a copy."""
    return np.lib.stride_tricks.sliding_window_view(codes, WIDTH)[::STRIDE]


def _codes(data: np.ndarray) -> np.ndarray:
    """Byte values; 256 pads the end so that each byte is under a filter and there is one step at least."""
    steps = max(1, -(-max(0, len(data) - WIDTH) // STRIDE) + 1)
    out = np.full((steps - 1) * STRIDE + WIDTH, 256, np.int16)
    out[: len(data)] = data
    return out


class ByteCNN:
    def __init__(self, weights: dict[str, np.ndarray], threshold: float = 0.5):
        self.w, self.threshold = weights, threshold

    def pooled(self, data: np.ndarray) -> np.ndarray:
        codes, w = _codes(data), self.w
        steps = (len(codes) - WIDTH) // STRIDE + 1
        top, total = np.full(FILTERS, -np.inf, np.float32), np.zeros(FILTERS, np.float64)
        head, tail = w["filters"][: STRIDE * EMBED], w["filters"][STRIDE * EMBED :]
        for a in range(0, steps, CHUNK_STEPS):
            b = min(steps, a + CHUNK_STEPS)
            part = codes[a * STRIDE : (b - 1) * STRIDE + WIDTH]
            x = w["embed"].take(part, 0).reshape(-1, STRIDE * EMBED)  # WIDTH is twice STRIDE: a filter sees two neighbours
            y = x[:-1] @ head
            y += x[1:] @ tail
            y += w["shift"]
            np.maximum(top, y.max(0), out=top)
            np.maximum(y, 0, out=y)
            total += np.ones(len(y), np.float32) @ y
        return np.concatenate([np.maximum(top, 0), total / steps]).astype(np.float32)

    def score(self, data: np.ndarray) -> float:
        """Probability of label 1; a text without bytes is one padded step."""
        z = float(self.pooled(data).astype(np.float64) @ self.w["out"].astype(np.float64) + float(self.w["bias"][0]))
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def train(samples: list[bytes], labels: list[int], seed: int = 7) -> ByteCNN:
    """Adam on the weighted logistic loss (each label weighs the same). Without samples of both labels, the constant answer of the only label (1 with none)."""
    w = _start(seed)
    y = np.array(labels, np.float32)
    if not len(y) or y.min() == y.max():
        w["out"][:] = 0
        w["bias"][0] = 4.0 if not len(y) or y[0] else -4.0
        return ByteCNN(w)
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean())).astype(np.float32)
    r = np.random.Generator(np.random.PCG64(seed + 1))
    size = TRAIN_BYTES
    m, v, t = {k: np.zeros_like(x) for k, x in w.items()}, {k: np.zeros_like(x) for k, x in w.items()}, 0
    for _ in range(EPOCHS):
        order = r.permutation(len(y))
        for a in range(0, len(order), BATCH):
            pick = order[a : a + BATCH]
            g = {k: np.zeros_like(x) for k, x in w.items()}
            for i in pick:
                raw = np.frombuffer(samples[i], np.uint8)
                s = int(r.integers(0, max(1, len(raw) - size + 1)))
                codes = _codes(raw[s : s + size])
                win = _windows(codes)
                x = w["embed"][win].reshape(len(win), -1)
                h = x @ w["filters"] + w["shift"]
                act = np.maximum(h, 0)
                arg = act.argmax(0)
                feat = np.concatenate([act[arg, np.arange(FILTERS)], act.mean(0)])
                p = 1 / (1 + np.exp(-np.clip(feat @ w["out"] + w["bias"][0], -30, 30)))
                d = np.float32((p - y[i]) * weight[i] / len(pick))
                g["out"] += d * feat
                g["bias"] += d
                back = np.broadcast_to(d * w["out"][FILTERS:] / len(win), act.shape).copy()
                back[arg, np.arange(FILTERS)] += d * w["out"][:FILTERS]
                back *= h > 0
                g["filters"] += x.T @ back
                g["shift"] += back.sum(0)
                dx = (back @ w["filters"].T).reshape(-1, EMBED)
                flat = win.reshape(-1)
                for e in range(EMBED):
                    g["embed"][:, e] += np.bincount(flat, dx[:, e], 257).astype(np.float32)
            t += 1
            for k in w:
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                v[k] = 0.999 * v[k] + 0.001 * g[k] ** 2
                w[k] -= (0.01 * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
    return ByteCNN(w)


def fit(docs: DataFrame, labels: DataFrame, allowed=None, key: str = "doc_id", text: str = "text", label: str = "quality", max_train: int = MAX_TRAIN) -> ByteCNN:
    """Train on the rows of labels for which allowed (a Column over key; by default all) holds.

    Rows whose label or text is null take no part. At most max_train documents come to the driver, each as a bounded window from
    a hashed place in its whole text; of several texts under one key, the one of smallest hash. A key with both labels counts for each.
    """
    lab = labels.select(F.col(key).alias("doc_id"), F.col(label).cast("int").alias("y")).filter(F.col("y").isin(0, 1) & F.col("doc_id").isNotNull())
    if allowed is not None:
        lab = lab.filter(allowed)
    picked = []
    for y in (0, 1):  # the ids first, without texts
        rows = lab.filter(F.col("y") == y).groupBy("doc_id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train // 2).collect()
        picked += [(r["doc_id"], y) for r in rows]
    if not picked:
        return train([], [])
    chosen = docs.sparkSession.createDataFrame(sorted(picked), "doc_id long, y int")
    mine = docs.filter(F.col(text).isNotNull()).select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).join(F.broadcast(chosen), "doc_id")
    place = F.pmod(F.xxhash64("doc_id", F.lit("window")), F.greatest(F.length("text") - TRAIN_CHARS + 1, F.lit(1))).cast("int") + 1
    piece = mine.select("doc_id", "y", F.xxhash64("text").alias("h"), F.substring("text", place, F.lit(TRAIN_CHARS)).alias("text"))
    rows = piece.groupBy("doc_id", "y").agg(F.min(F.struct("h", "text"))["text"].alias("text")).collect()
    rows.sort(key=lambda r: (r["doc_id"], r["y"]))
    return train([r["text"].encode() for r in rows], [r["y"] for r in rows])


def score(docs: DataFrame, model: ByteCNN, text: str = "text", name: str = "score") -> DataFrame:
    """docs with a column of scores added (replacing one of that name).

    Null text is an empty one. Repeated rows and rows of equal or null key are scored each by itself, very long texts whole. An empty
    table gives none. Any other columns stay as they are.
    """
    small_batches(docs.sparkSession)
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model.w)  # some 10 kB
    keep = [c for c in docs.columns if c != name]
    place = keep.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = ByteCNN(shared.value)
        for batch in batches:
            data, off = string_buffers(batch.column(place))
            got = [net.score(data[a:b]) for a, b in zip(off[:-1].tolist(), off[1:].tolist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got, pa.float64())], names=[*keep, name])

    from pyspark.sql import types as T

    kept = docs.select(*[docs[f"`{c}`"] for c in keep])
    return kept.mapInArrow(tidy(run), T.StructType([*kept.schema.fields, T.StructField(name, T.DoubleType())]))
