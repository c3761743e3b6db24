"""Hierarchical multi-length packing of tokenised documents into context windows.

A document is routed by its length to the smallest tier (context size) that holds it. One longer
than the largest tier is cut: full windows of the largest tier, and the rest is routed. A document
of tier T is longer than the next smaller tier and opens a window of its own size class; the gap that
it leaves is filled from the shorter tiers, longest fitting document first, and what gap is then left
takes the head of the shortest document at hand, which is cut there. So each window is full; only at
the end of a task one window may need padding, which is cut into tiers of powers of two as far as it goes.

Packing is local to a task: there is no shuffle, and a task holds the documents of a bounded pool.
Windows get ids from the task's number and a counter, so a task that runs again gives the same ids.
Windows of equal size are dealt in turn to step groups; each task and tier begins at another group, so what is left over by
full turns falls on all groups alike, and the groups of a tier are of about equal length.
"""

from __future__ import annotations

import bisect
import math
from collections import deque
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bpe import encoder
from .shared import small_batches, tidy
from .textops import chunks, string_buffers

TIERS = (128, 256, 512, 1024)
POOL_TOKENS = 1 << 20

PIECE_SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, tier int, step_group int"


class Packer:
    """Packs documents (key, ids) into windows; yields lists of pieces (key, start, ids, doc_tokens)."""

    def __init__(self, tiers: Sequence[int] = TIERS, pool_tokens: int = POOL_TOKENS):
        if list(tiers) != sorted(set(tiers)) or any(t & (t - 1) for t in tiers):
            raise ValueError("tiers must be ascending powers of two")
        self.tiers, self.top, self.pool_tokens = list(tiers), tiers[-1], pool_tokens
        self.routes: list[deque] = [deque() for _ in tiers]
        self.held = 0

    def _put(self, piece) -> None:
        self.routes[bisect.bisect_left(self.tiers, len(piece[2]))].append(piece)

    def add(self, key: int, ids: np.ndarray) -> Iterator[list]:
        n, s = len(ids), 0
        while n - s >= self.top:
            yield [(key, s, ids[s : s + self.top], n)]
            s += self.top
        if s < n:
            self._put((key, s, ids[s:], n))
            self.held += n - s
        if self.held > self.pool_tokens:
            yield from self.drain(self.pool_tokens // 4)

    def _take(self, gap: int, below: int):
        """From tiers below the given one: the first piece of the longest class that surely or actually fits, else the head of the shortest at hand."""
        for t in range(below - 1, -1, -1):
            route = self.routes[t]
            if route and self.tiers[t] <= gap:
                return route.popleft()
            for _ in range(min(8, len(route))):
                if len(route[0][2]) <= gap:
                    return route.popleft()
                route.rotate(-1)
        for route in self.routes[:below] if any(self.routes[:below]) else self.routes:
            if route:
                key, s, ids, n = route.popleft()
                if len(ids) > gap:
                    self._put((key, s + gap, ids[gap:], n))
                return key, s, ids[:gap], n
        return None

    def drain(self, leave: int = 0) -> Iterator[list]:
        """Windows until at most leave tokens are held. With 0, the last one is cut into powers of two."""
        while self.held > leave and any(self.routes):
            t = max(i for i, r in enumerate(self.routes) if r)
            window, size = [self.routes[t].popleft()], 0
            size = len(window[0][2])
            # A document opens the window of its own tier; a tier without enough company is packed at the top tier.
            goal = self.tiers[t] if self.held >= self.tiers[t] else 0
            if goal != self.top and self.held >= self.top and t == 0:
                goal = self.top
            while goal and size < goal and (p := self._take(goal - size, max(t, 1))):
                window.append(p)
                size += len(p[2])
            if not goal:
                while p := self._take(self.held - size, len(self.tiers)):
                    window.append(p)
                    size += len(p[2])
                    if size >= self.held:
                        break
                yield from self._tail(window)
                self.held -= size
                continue
            self.held -= size
            yield window

    def _tail(self, window: list) -> Iterator[list]:
        """Less than a tier of tokens: cut off powers of two from the largest tier down; what is left after the smallest is one padded window."""
        for tier in reversed(self.tiers):
            while window and sum(len(p[2]) for p in window) >= tier:
                full, room = [], tier
                while room:
                    key, s, ids, n = window.pop(0)
                    full.append((key, s, ids[:room], n))
                    if len(ids) > room:
                        window.insert(0, (key, s + room, ids[room:], n))
                    room -= len(full[-1][2])
                yield full
        if window:
            yield window


def first_turns(task: int, tiers: Sequence[int], groups: int) -> dict[int, int]:
    """The step group of a task's first window of each tier: tasks in a row begin `step` groups apart, which meets all groups, and tiers one further."""
    step = next(s for s in range(max(1, groups * 5 // 8), 2 * groups + 2) if math.gcd(s, groups) == 1)
    return {t: (task * step + i) % groups for i, t in enumerate(tiers)}


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    key: str = "doc_id",
    text: str = "text",
    end_id: int | None = 0,
    tiers: Sequence[int] = TIERS,
    groups: int = 8,
) -> DataFrame:
    """Pieces of the documents' token ids, placed in windows; columns as PIECE_SCHEMA, ids as little-endian unsigned 32-bit integers.

    Null text is an empty one: its only token is end_id (with end_id None it has no piece). Rows with
    equal keys are documents of their own. An empty table gives none. Other columns are not looked at.
    """
    tiers = tuple(tiers)
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, packer = encoder(tokenizer_path), Packer(tiers)
        task = TaskContext.get().partitionId()
        made = task << 33
        turn = first_turns(task, tiers, groups)
        rows: list[list] = [[] for _ in range(9)]

        def place(window) -> None:
            nonlocal made
            size = sum(len(p[2]) for p in window)
            tier = tiers[bisect.bisect_left(tiers, size)]
            at = 0
            for k, s, ids, n in window:
                for col, v in zip(rows, (k, s, len(ids), ids.astype("<u4").tobytes(), n, made, at, tier, turn[tier] % groups)):
                    col.append(v)
                at += len(ids)
            made += 1
            turn[tier] += 1

        def flush() -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32())
            out = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds)], names=[x.split()[0] for x in PIECE_SCHEMA.split(", ")])
            for c in rows:
                c.clear()
            return out

        for batch in batches:
            keys = batch.column(0)
            _, offsets = string_buffers(batch.column(1))
            for a, b in chunks(offsets):
                texts = ["" if t is None else t for t in batch.column(1).slice(a, b - a).to_pylist()]
                for k, ids in zip(keys.slice(a, b - a).to_pylist(), enc.encode(texts)):
                    for window in packer.add(k, ids if end_id is None else np.append(ids, np.int32(end_id))):
                        place(window)
                if len(rows[0]) >= 4096:
                    yield flush()
        for window in packer.drain():
            place(window)
        if rows[0]:
            yield flush()

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(tidy(run, ("bpe",)), PIECE_SCHEMA)


def ids_crc32(ids: Column) -> Column:
    """Unsigned CRC-32 of a binary column of ids."""
    return F.crc32(ids)
