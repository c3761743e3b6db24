"""Byte kernels in numpy, and their Arrow functions for Spark. The functions on bytes are plain Python, so they can be tested without Spark."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import functions as F

U64 = (1 << 64) - 1
# The frame of chunked payloads, and the sketch's seed generator.
FRAME_MAGIC, CHUNK = 0x54584350, 2 << 20
LCG_START, LCG_MUL, LCG_ADD = 42, 6364136223846793005, 1442695040888963407


def content_hash(data: bytes) -> str:
    """K1"""
    return xxhash.xxh3_128_hexdigest(data)


def lcg_seeds(n: int) -> list[int]:
    out, s = [], LCG_START
    for _ in range(n):
        s = (s * LCG_MUL + LCG_ADD) & U64
        out.append(s)
    return out


def row_seeds(d: int) -> list[int]:
    """K5: every second seed, finished by a mixing step, made odd"""
    out = []
    for s in lcg_seeds(2 * d)[::2]:
        s = (s ^ s >> 30) * 0xBF58476D1CE4E5B9 & U64
        s = (s ^ s >> 27) * 0x94D049BB133111EB & U64
        out.append((s ^ s >> 31) | 1)
    return out


def sketch(data: bytes, d: int = 2, w: int = 1024, first: int = 0) -> np.ndarray | None:
    """K3: d rows of w signed bit counts over 16-bit elements; additive over parts (first: the place of the first element). None for an odd number of bytes."""
    if len(data) % 2 or w & (w - 1):
        return None
    v = np.frombuffer(data, "<u2")
    at = np.flatnonzero(v)
    v, place = v[at], (at + first).astype(np.uint64)
    out = np.zeros((d, w), np.int64)
    ones = np.bitwise_count(v).astype(np.int64)
    for r, seed in enumerate(row_seeds(d)):
        h = place * np.uint64(seed)
        h ^= h >> np.uint64(31)
        sign = np.bitwise_count(v & (h >> np.uint64(1)).astype(np.uint16)).astype(np.int64)
        out[r] = np.bincount(((h >> np.uint64(32)) & np.uint64(w - 1)).astype(np.int64), 2 * sign - ones, w).astype(np.int64)
    return out.reshape(-1).astype(np.int32)


def sketch_many(datas: list[bytes | None], d: int = 2, w: int = 1024, firsts: np.ndarray | None = None) -> list[np.ndarray | None]:
    """sketch() of many payloads (parts that begin at element firsts[i]) by a few operations on all of them; None for a null or an odd number of bytes."""
    if w & (w - 1):
        return [None] * len(datas)
    fine = [i for i, x in enumerate(datas) if x is not None and len(x) % 2 == 0]
    out: list[np.ndarray | None] = [None] * len(datas)
    step = max(1, (1 << 21) // (d * w))
    for a in range(0, len(fine), step):
        some = fine[a : a + step]
        size = np.array([len(datas[i]) // 2 for i in some], np.int64)
        v = np.frombuffer(b"".join(datas[i] for i in some), "<u2")
        row = np.repeat(np.arange(len(some)), size)
        place = np.arange(len(v)) - np.repeat(np.cumsum(size) - size, size)
        if firsts is not None:
            place = place + np.repeat(np.asarray(firsts)[some], size)
        at = np.flatnonzero(v)
        v, row, place = v[at], row[at], place[at].astype(np.uint64)
        ones = np.bitwise_count(v).astype(np.int64)
        table = np.zeros((len(some), d, w), np.int64)
        for r, seed in enumerate(row_seeds(d)):
            h = place * np.uint64(seed)
            h ^= h >> np.uint64(31)
            sign = np.bitwise_count(v & (h >> np.uint64(1)).astype(np.uint16)).astype(np.int64)
            slot = row * w + ((h >> np.uint64(32)) & np.uint64(w - 1)).astype(np.int64)
            table[:, r] = np.bincount(slot, 2 * sign - ones, len(some) * w).reshape(len(some), w)
        for i, x in zip(some, table.reshape(len(some), -1).astype(np.int32)):
            out[i] = x
    return out


def entropy_many(datas: list[bytes | None]) -> list[float | None]:
    """byte_entropy() of many payloads: counts of all of them in one table, in blocks"""
    out: list[float | None] = [None] * len(datas)
    fine = [i for i, x in enumerate(datas) if x is not None]
    a = 0
    while a < len(fine):
        b, total = a, 0
        while b < len(fine) and b - a < 4096 and (b == a or total + len(datas[fine[b]]) <= 1 << 23):
            total += len(datas[fine[b]])
            b += 1
        some = fine[a:b]
        size = np.array([len(datas[i]) for i in some], np.int64)
        flat = np.frombuffer(b"".join(datas[i] for i in some), np.uint8)
        count = np.bincount(np.repeat(np.arange(len(some)), size) * 256 + flat, minlength=256 * len(some)).reshape(len(some), 256)
        p = count / np.maximum(size, 1)[:, None]
        h = -(p * np.log2(np.where(p > 0, p, 1))).sum(1)
        for i, x in zip(some, (h + 0.0).tolist()):
            out[i] = x
        a = b
    return out


def hamming_many(a: list[bytes | None], b: list[bytes | None]) -> list[int | None]:
    """hamming() of many pairs; those of unequal length are an error"""
    fine = [i for i, (x, y) in enumerate(zip(a, b)) if x is not None and y is not None]
    out: list[int | None] = [None] * len(a)
    size = np.array([len(a[i]) for i in fine], np.int64)
    if any(len(b[i]) != n for i, n in zip(fine, size.tolist())):
        raise ValueError("payloads differ in length")
    x = np.bitwise_count(np.frombuffer(b"".join(a[i] for i in fine), np.uint8) ^ np.frombuffer(b"".join(b[i] for i in fine), np.uint8))
    ends = np.concatenate([[0], np.cumsum(x, dtype=np.int64)])[np.concatenate([[0], np.cumsum(size)])]
    for i, n in zip(fine, np.diff(ends).tolist()):
        out[i] = n
    return out


def sketch_distance(a: np.ndarray, b: np.ndarray, n_bits: int, d: int = 2) -> float:
    """E1"""
    x = a.astype(np.int64) - b.astype(np.int64)
    return float((x * x).sum()) / d / max(n_bits, 1)


def hamming_estimate(a: np.ndarray, b: np.ndarray, d: int = 2) -> float:
    """K6: median over rows"""
    x = (a.astype(np.int64) - b.astype(np.int64)).reshape(d, -1)
    return float(np.median((x * x).sum(1)))


def hamming(a: bytes, b: bytes) -> int:
    """K8"""
    return int(np.bitwise_count(np.bitwise_xor(np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8))).sum())


def zero_bit_ratio(a: bytes, b: bytes) -> float:
    """B22"""
    return 1 - hamming(a, b) / (8 * len(a)) if a else 1.0


def byte_entropy(data: bytes) -> float:
    """F19"""
    if not data:
        return 0.0
    p = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    p = p[p > 0] / len(data)
    return float(-(p * np.log2(p)).sum())


def xor_bytes(a: bytes, b: bytes) -> bytes:
    """B21"""
    return np.bitwise_xor(np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)).tobytes()


def sub_u16(a: bytes, b: bytes) -> bytes:
    """difference of 16-bit elements, wrapping"""
    return (np.frombuffer(a, "<u2") - np.frombuffer(b, "<u2")).tobytes()


def transpose(data: bytes, item: int) -> bytes:
    """Byte planes, low byte first"""
    return np.frombuffer(data, np.uint8).reshape(-1, item).T.tobytes()


def untranspose(data: bytes, item: int) -> bytes:
    return np.frombuffer(data, np.uint8).reshape(item, -1).T.tobytes()


def regroup_bf16(data: bytes) -> bytes:
    """A plane of exponents, then a plane of sign and mantissa"""
    v = np.frombuffer(data, "<u2")
    return ((v >> 7) & 0xFF).astype(np.uint8).tobytes() + ((v >> 8 & 0x80) | (v & 0x7F)).astype(np.uint8).tobytes()


def ungroup_bf16(data: bytes) -> bytes:
    e, s = np.frombuffer(data, np.uint8).reshape(2, -1).astype(np.uint16)
    return ((s & 0x80) << 8 | e << 7 | (s & 0x7F)).astype("<u2").tobytes()


def zigzag16(data: bytes) -> bytes:
    """B20"""
    v = np.frombuffer(data, "<i2").astype(np.int32)
    return ((v << 1) ^ (v >> 15)).astype(np.uint16).astype("<u2").tobytes()


def encode_delta(target: bytes, base: bytes, item: int = 2, level: int = 1) -> bytes:
    """XOR with the base, byte planes, zstandard; above the chunk size a frame of chunks. Items of 2 or 4 bytes."""
    if len(target) != len(base):
        raise ValueError("target and base differ in length")
    if item not in (2, 4) or len(target) % item:
        raise ValueError(f"items of {item} bytes are not supported")
    one = lambda a, b: zstandard.ZstdCompressor(level=level).compress(transpose(xor_bytes(a, b), item))
    if len(target) <= CHUNK:
        return one(target, base)
    bodies = [one(target[i : i + CHUNK], base[i : i + CHUNK]) for i in range(0, len(target), CHUNK)]
    return struct.pack("<IIQ", FRAME_MAGIC, len(bodies), len(target)) + struct.pack(f"<{len(bodies)}I", *map(len, bodies)) + b"".join(bodies)


def decode_delta(blob: bytes, base: bytes, item: int = 2) -> bytes:
    """K11"""
    one = lambda x, b: xor_bytes(untranspose(zstandard.ZstdDecompressor().decompress(x, max_output_size=max(1, len(b))), item), b) if b else b""
    if len(blob) < 16 or struct.unpack_from("<I", blob)[0] != FRAME_MAGIC:
        return one(blob, base)
    n = struct.unpack_from("<I", blob, 4)[0]
    sizes, at, out = struct.unpack_from(f"<{n}I", blob, 16), 16 + 4 * n, []
    for i, s in enumerate(sizes):
        out.append(one(blob[at : at + s], base[i * CHUNK : (i + 1) * CHUNK]))
        at += s
    return b"".join(out)


def encode_planes(target: bytes, base: bytes | None, item: int, bf16: bool = False, level: int = 3) -> bytes:
    """Base optional, any item size"""
    x = xor_bytes(target, base) if base is not None else target
    x = x if item <= 1 else regroup_bf16(x) if item == 2 and bf16 else transpose(x, item)
    return zstandard.ZstdCompressor(level=level).compress(x)


def decode_planes(blob: bytes, base: bytes | None, item: int, size: int, bf16: bool = False) -> bytes:
    x = zstandard.ZstdDecompressor().decompress(blob, max_output_size=max(1, size))
    x = x if item <= 1 else ungroup_bf16(x) if item == 2 and bf16 else untranspose(x, item)
    return xor_bytes(x, base) if base is not None else x


def _udf(kind: str, f, *_):
    """An Arrow-batched function of binary columns; a null argument gives null."""

    @F.pandas_udf(kind)
    def run(it: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for cols in it:
            cols = cols if isinstance(cols, tuple) else (cols,)
            yield pd.Series([None if any(x is None for x in row) else f(*row) for row in zip(*cols)], dtype=object)

    return run


def _batch_udf(kind: str, f):
    """An Arrow-batched function of binary columns, given each column of a batch as a list; null is None."""

    @F.pandas_udf(kind)
    def run(it: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for cols in it:
            cols = cols if isinstance(cols, tuple) else (cols,)
            yield pd.Series(f(*(c.tolist() for c in cols)), dtype=object)

    return run


def content_hash_udf():
    return _udf("string", content_hash)


def sketch_udf(d: int = 2, w: int = 1024):
    return _batch_udf("array<int>", lambda datas: sketch_many(datas, d, w))


def entropy_udf():
    return _batch_udf("double", entropy_many)


def hamming_udf():
    return _batch_udf("long", hamming_many)


def delta_udf(item: int = 2):
    return _udf("binary", lambda a, b: encode_delta(a, b, item))


def undelta_udf(item: int = 2):
    return _udf("binary", lambda x, b: decode_delta(x, b, item))


def floats_to_bytes():
    """The little-endian float32 bytes of an array of floats; null for a null array."""

    def many(rows):
        size = [0 if x is None else 4 * len(x) for x in rows]
        raw = np.concatenate([np.zeros(0, "<f4"), *(np.asarray(x, "<f4") for x in rows if x is not None)]).astype("<f4").tobytes()
        ends = np.cumsum(size).tolist()
        return [None if x is None else raw[e - n : e] for x, e, n in zip(rows, ends, size)]

    return _batch_udf("binary", many)


FLOATS = {"float16": "<f2", "float32": "<f4", "float64": "<f8"}


def cast_floats(data: bytes, have: str, want: str) -> bytes:
    """Values of one kind of float as another, rounded to the nearest (ties to even); bfloat16 is the upper half of a float32."""
    if have == want:
        return data
    if have == "bfloat16":
        x = (np.frombuffer(data, "<u2").astype("<u4") << 16).view("<f4")
    elif have in FLOATS:
        x = np.frombuffer(data, FLOATS[have])
    else:
        raise ValueError(f"no cast from {have}")
    if want == "bfloat16":
        u = x.astype("<f4").view("<u4")
        up = (u + 0x7FFF + (u >> 16 & 1)) >> 16
        return np.where(np.isnan(x.astype("<f4")), u >> 16 | 0x40, up).astype("<u2").tobytes()
    if want not in FLOATS:
        raise ValueError(f"no cast to {want}")
    with np.errstate(over="ignore"):
        return x.astype(FLOATS[want]).tobytes()


def train_xor_dictionary(samples: list[bytes], size: int = 64 << 10) -> bytes:
    """A zstandard dictionary of XOR differences; an error where there are none, or too few to train on"""
    samples = [s for s in samples if s]
    if not samples:
        raise ValueError("no samples to train a dictionary on")
    return zstandard.train_dictionary(size, samples).as_bytes()


def encode_with(target: bytes, base: bytes, dictionary: bytes, level: int = 3) -> bytes:
    """The XOR under a trained dictionary"""
    return zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(dictionary)).compress(xor_bytes(target, base))


def decode_with(blob: bytes, base: bytes, dictionary: bytes) -> bytes:
    return xor_bytes(zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary)).decompress(blob, max_output_size=max(1, len(base))), base)
