"""Passages that an earlier document has too: found with suffix automata of reference shards, and taken out.

A window is `window` consecutive words. Of the 7-word grams in it, the one of least hash is its anchor, so
equal windows have equal anchors; neighbouring windows mostly share theirs, and form a segment.

1. One pass sends out each document's distinct anchors (hash, document, fingerprint of the whole text), as
   blobs sorted by hash range. Only anchors that two different texts have can matter; documents
   with equal word sequences are one text, whose later copies are taken out whole.
2. The texts that have such anchors give their segments around them. Equal segments are one, with the least
   document that has it; the distinct segments are the reference.
3. References are dealt to shards of bounded size by anchor. A shard's suffix automaton knows for each state
   the least document whose segment ends there; the texts' distinct segments are streamed through it, and the state of
   the last `window` words (matching statistics cut at that length) tells the least document that has them.
   An anchor with more segments than a shard takes is cut into single windows first, which meet by their content.
4. The windows so found go back to their documents, and the words that they cover are removed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .jaccard_join import BATCH_BYTES, BATCH_DOCS, _ranges
from .shared import small_batches, stored, tidy, tidy_group
from .textops import chunks, gram_hashes, string_buffers, word_hashes, words

GRAM = 7
SHARD_SEGMENTS = 8_000
META = np.dtype([("doc_id", "<i8"), ("null", "?"), ("n", "<i4"), ("node", "<i8")])


def _node(h: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(h.tobytes(), digest_size=8).digest(), "little", signed=True)


def anchors(h: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window of one document's word hashes: its anchor's hash, and where that starts (the first of equals)."""
    n = len(h) - window + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    gram = min(GRAM, window)
    g = gram_hashes(h, gram)[: len(h) - gram + 1]
    view = np.lib.stride_tricks.sliding_window_view(g, window - gram + 1)
    at = view.argmin(1)
    return view[np.arange(n), at], at + np.arange(n)


def text_anchors(docs: DataFrame, window: int, n_ranges: int) -> DataFrame:
    """(doc_id, node, n, anchors): for each row its text's hash, number of words, and the anchors (cut to 32 bits and the range's) that another text has, as sorted little-endian 64-bit integers; null if there are none."""
    bits = n_ranges.bit_length() - 1

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = string_buffers(batch.column(1))
            keys = batch.column(0)
            for a, b in ((x, min(x + BATCH_DOCS, d)) for c, d in chunks(offsets, BATCH_BYTES) for x in range(c, d, BATCH_DOCS)):
                found, nodes, sizes = [], [], []
                for c, d in chunks(offsets[a : b + 1] - offsets[a]):
                    lo = offsets[a + c]
                    raw, s, e, first = words(data[lo : offsets[a + d]], offsets[a + c : a + d + 1] - lo)
                    h = word_hashes(raw, s, e)
                    for i, j in zip(first[:-1].tolist(), first[1:].tolist()):
                        found.append(np.unique(anchors(h[i:j], window)[0]))
                        nodes.append(_node(h[i:j]))
                        sizes.append(j - i)
                meta = np.zeros(b - a, META)
                ids = keys.slice(a, b - a)
                meta["null"] = ids.is_null().to_numpy(zero_copy_only=False)
                meta["doc_id"] = ids.fill_null(0).to_numpy(zero_copy_only=False)
                meta["n"], meta["node"] = sizes, nodes
                count = np.array([0 if x else len(f) for x, f in zip(meta["null"], found)], np.int64)
                h = np.concatenate([f[:c] for f, c in zip(found, count)]) if len(found) else np.zeros(0, np.uint64)
                doc = np.repeat(np.arange(b - a), count)
                order = np.argsort(h, kind="stable")
                h, doc = h[order], doc[order]
                cut = np.searchsorted(h >> np.uint64(64 - bits), np.arange(n_ranges + 1))
                low, mark, doc = (h >> np.uint64(32 - bits)).astype("<u4"), (meta["node"][doc] & 0xFFFFFFFF).astype("<u4"), doc.astype("<u2")
                uid = int.from_bytes(hashlib.blake2b(meta.tobytes(), digest_size=8).digest(), "little", signed=True)
                home = uid % n_ranges
                rows = [{"range": r, "batch": uid, "h": low[cut[r] : cut[r + 1]].tobytes(), "doc": doc[cut[r] : cut[r + 1]].tobytes(), "mark": mark[cut[r] : cut[r + 1]].tobytes(), "meta": meta.tobytes() if r == home else None} for r in range(n_ranges) if cut[r] < cut[r + 1] or r == home]
                yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("range", pa.int32()), ("batch", pa.int64()), ("h", pa.binary()), ("doc", pa.binary()), ("mark", pa.binary()), ("meta", pa.binary())]))

    def meet(rows: pd.DataFrame) -> pd.DataFrame:
        sizes = rows.h.map(len).to_numpy() // 4
        h, mark = np.frombuffer(b"".join(rows.h), "<u4"), np.frombuffer(b"".join(rows.mark), "<u4")
        order = np.lexsort((mark, h))
        hs, ms = h[order], mark[order]
        first = np.flatnonzero(np.concatenate([[True], hs[1:] != hs[:-1]])) if len(hs) else np.zeros(0, np.int64)
        size = np.diff(np.append(first, len(hs)))
        several = ms[first] != ms[first + size - 1]
        shared = np.zeros(len(h), bool)
        shared[order] = np.repeat(several, size)
        top, out, at = int(rows["range"].iloc[0]) << 32, [], 0
        for batch, doc, meta, n in zip(rows.batch, rows.doc, rows.meta, sizes.tolist()):
            hit = shared[at : at + n]
            d, a = np.frombuffer(doc, "<u2")[hit], h[at : at + n][hit].astype("<i8") + top
            at += n
            if len(d) or meta is not None:
                out.append((batch, d.tobytes(), a.astype("<i8").tobytes(), meta))
        return pd.DataFrame(out, columns=["batch", "doc", "hits", "meta"])

    def gather(rows: pd.DataFrame) -> pd.DataFrame:
        metas = [m for m in rows.meta if m is not None]
        if not metas:
            raise RuntimeError("a batch of anchors came without its documents")
        meta = np.frombuffer(metas[0], META)
        d, a = np.frombuffer(b"".join(rows.doc), "<u2"), np.frombuffer(b"".join(rows.hits), "<i8")
        order = np.lexsort((a, d))
        d, a = d[order], a[order]
        cut = np.searchsorted(d, np.arange(len(meta) + 1))
        got = [np.unique(a[i:j]).tobytes() if j > i else None for i, j in zip(cut[:-1].tolist(), cut[1:].tolist())]
        one = pd.DataFrame({"doc_id": pd.array(meta["doc_id"], "Int64").copy(), "node": meta["node"], "n": meta["n"], "anchors": got})
        one.loc[meta["null"], "doc_id"] = pd.NA
        return pd.concat([one] * len(metas))

    blobs = docs.mapInArrow(tidy(emit), "range int, batch long, h binary, doc binary, mark binary, meta binary")
    met = blobs.groupBy("range").applyInPandas(tidy_group(meet), "batch long, doc binary, hits binary, meta binary")
    return met.groupBy("batch").applyInPandas(tidy_group(gather), "doc_id long, node long, n int, anchors binary")


def segments(docs: DataFrame, hits: DataFrame, window: int, n_ranges: int) -> DataFrame:
    """(anchor, seg, doc_id, node, starts, words): runs of windows with one of the text's hit anchors; words as 64-bit hashes, seg their hash.

    A run that a text has several times (a text that repeats itself) is one row, with all places where it starts.
    """
    bits = n_ranges.bit_length() - 1
    schema = pa.schema([("anchor", pa.int64()), ("seg", pa.int64()), ("doc_id", pa.int64()), ("node", pa.int64()), ("starts", pa.binary()), ("words", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = string_buffers(batch.column(1))
            for a, b in chunks(offsets):
                raw, s, e, first = words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                h = word_hashes(raw, s, e)
                part, out = batch.slice(a, b - a), ([], [], [], [], [], [])
                for key, lists, i, j in zip(part.column(0).to_pylist(), part.column(2).to_pylist(), first[:-1].tolist(), first[1:].tolist()):
                    node = _node(h[i:j])
                    want = next((x["anchors"] for x in lists if x["node"] == node), None)
                    if want is None:
                        continue
                    value, at = anchors(h[i:j], window)
                    value = (value >> np.uint64(32 - bits)).astype(np.int64)
                    hit = np.isin(value, np.frombuffer(want, "<i8"))
                    turn = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]])) if len(at) else at
                    runs: dict[bytes, list[int]] = {}
                    for p, q in zip(turn.tolist(), np.append(turn[1:], len(at)).tolist()):
                        if hit[p]:
                            runs.setdefault(h[i + p : i + q + window - 1].tobytes(), []).append(p)
                    for w, places in runs.items():
                        out[0].append(value[places[0]])
                        out[1].append(xxhash.xxh3_64_intdigest(w))
                        out[2].append(key)
                        out[3].append(node)
                        out[4].append(np.array(places, "<i4").tobytes())
                        out[5].append(w)
                if out[0]:
                    first = [pa.array(np.array(out[0], np.int64)), pa.array(np.array(out[1], np.uint64).view(np.int64))]
                    yield pa.RecordBatch.from_arrays([*first, *(pa.array(c, f.type) for c, f in zip(out[2:], list(schema)[2:]))], schema=schema)

    return docs.join(hits, "doc_id").select("doc_id", "text", "lists").mapInArrow(tidy(run), "anchor long, seg long, doc_id long, node long, starts binary, words binary")


class SuffixAutomaton:
    """Of several sequences; each state knows the least mark of the sequences in which it occurs."""

    def __init__(self, sequences, marks):
        none = 2**63 - 1
        next_, link, length, least = [{}], [-1], [0], [none]

        def split(p: int, c, q: int) -> int:
            """The state of the longest string of p followed by c, taken out of q if that has longer ones."""
            if length[q] == length[p] + 1:
                return q
            clone = len(length)
            next_.append(dict(next_[q]))
            link.append(link[q])
            length.append(length[p] + 1)
            least.append(none)
            link[q] = clone
            while p >= 0 and next_[p].get(c) == q:
                next_[p][c] = clone
                p = link[p]
            return clone

        for seq, mark in zip(sequences, marks):
            last = 0
            for c in seq:
                q = next_[last].get(c)
                if q is not None:
                    last = split(last, c, q)
                else:
                    cur, p = len(length), last
                    next_.append({})
                    link.append(0)
                    length.append(length[last] + 1)
                    least.append(none)
                    while p >= 0 and c not in next_[p]:
                        next_[p][c] = cur
                        p = link[p]
                    if p >= 0:
                        link[cur] = split(p, c, next_[p][c])
                    last = cur
                if mark < least[last]:
                    least[last] = mark
        for v in sorted(range(1, len(length)), key=length.__getitem__, reverse=True):
            if least[v] < least[link[v]]:
                least[link[v]] = least[v]
        self.next, self.link, self.len, self.mark = next_, link, length, least

    def least_marks(self, seq, window: int) -> list[int]:
        """For each window of the sequence the least mark of the sequences that have it (2**63 - 1: none): matching statistics cut at the window's length."""
        next_, link, length, mark = self.next, self.link, self.len, self.mark
        out, v, n = [], 0, 0
        for i, c in enumerate(seq, 1):
            while v and c not in next_[v]:
                v = link[v]
                n = length[v]
            to = next_[v].get(c)
            if to is not None:
                v, n = to, n + 1
            while v and length[link[v]] >= window:
                v = link[v]
            n = min(n, window) if v else 0
            if i >= window:
                out.append(mark[v] if n >= window else 2**63 - 1)
        return out


def _joined(raw: np.ndarray, bounds: np.ndarray, s: np.ndarray, e: np.ndarray, first: np.ndarray, stays: np.ndarray) -> pa.Array:
    """For each document the words that stay, joined by one space: their bytes, and after each but the document's last the byte behind it (white space), as a space."""
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))[stays]
    s, e = s[stays], e[stays]
    step = np.zeros(len(raw) + 1, np.int8)
    step[s] += 1
    step[e] -= 1
    taken = np.cumsum(step[:-1], dtype=np.int8).astype(bool)
    gaps = e[:-1][doc[1:] == doc[:-1]]
    raw = raw.copy()
    raw[gaps] = 32
    taken[gaps] = True
    place = np.concatenate([[0], np.cumsum(taken)])[bounds].astype(np.int64)
    return pa.LargeStringArray.from_buffers(len(bounds) - 1, pa.py_buffer(place), pa.py_buffer(raw[taken])).cast(pa.string())


def least_documents(found: DataFrame, window: int) -> DataFrame:
    """found: segments -> (anchor, seg, least): for each distinct segment and window of it the least document that has the window, as little-endian 64-bit integers."""
    one = found.groupBy("anchor", "seg").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.first("words").alias("words"))
    one = stored(one, "dedup-reference")
    of = one.groupBy("anchor").agg(F.count(F.lit(1)).alias("segs"), F.min("first").alias("lo"), F.max("last").alias("hi"))
    # An anchor that one document has alone (another's had equal leading bits) is left out.
    known = stored(one.join(of.filter("lo < hi").select("anchor", "segs"), "anchor"), "dedup-known")
    total = known.count()
    shards = max(1, -(-total // SHARD_SEGMENTS))

    def by_automaton(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["anchor", "seg"])
        seqs = [np.frombuffer(w, "<u8").tolist() for w in rows.words]
        auto = SuffixAutomaton(seqs, rows["first"].tolist())
        return pd.DataFrame({"anchor": rows.anchor, "seg": rows.seg, "least": [np.array(auto.least_marks(s, window), "<i8").tobytes() for s in seqs]})

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(a, s, f, i, w[8 * i : 8 * (i + window)]) for a, s, f, w in zip(*(c.to_pylist() for c in b.columns)) for i in range(len(w) // 8 - window + 1)]
            yield pa.RecordBatch.from_pylist([dict(zip(("anchor", "seg", "first", "i", "words"), r)) for r in rows], schema=pa.schema([("anchor", pa.int64()), ("seg", pa.int64()), ("first", pa.int64()), ("i", pa.int32()), ("words", pa.binary())]))

    schema, cols = "anchor long, seg long, least binary", ("anchor", "seg", "first", "words")
    some = known.filter(f"segs <= {SHARD_SEGMENTS}").select(*cols, F.pmod(F.xxhash64("anchor"), F.lit(shards)).alias("shard"))
    out = some.groupBy("shard").applyInPandas(tidy_group(by_automaton), schema)
    if not known.filter(f"segs > {SHARD_SEGMENTS}").isEmpty():
        piece = known.filter(f"segs > {SHARD_SEGMENTS}").select(*cols).mapInArrow(tidy(cut), "anchor long, seg long, first long, i int, words binary")
        piece = stored(piece.select("anchor", "seg", "first", "i", F.xxhash64("words").alias("x"), F.xxhash64(F.reverse(F.hex("words"))).alias("y")), "dedup-hot")
        least = piece.groupBy("x", "y").agg(F.min("first").alias("least"))
        listed = piece.join(least, ["x", "y"]).groupBy("anchor", "seg").agg(F.sort_array(F.collect_list(F.struct("i", "least"))).alias("all"))

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([np.array(x, "<i8").tobytes() for x in b.column(2).to_pylist()], pa.binary())], names=["anchor", "seg", "least"])

        out = out.unionByName(listed.select("anchor", "seg", F.transform("all", lambda x: x["least"]).alias("all")).mapInArrow(tidy(pack), schema))
    return out


def remove_repeats(docs: DataFrame, window: int = 13, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs with n_words, n_removed and kept (the words left, joined by one space) added.

    A word goes when a window of `window` words covers it whose words also start in a document with a
    smaller key; windows are judged on the input. Null text has no words (kept is empty). A row whose
    key is null is left whole and is no reference. Rows of equal key are judged by themselves and are no reference
    for each other. A very long text is handled whole, as a chunk of its own. An empty table gives none. Extra columns stay;
    ones named n_words, n_removed or kept are replaced.
    """
    if window < 1:
        raise ValueError("window must be positive")
    small_batches(docs.sparkSession)
    keep = [c for c in docs.columns if c not in ("n_words", "n_removed", "kept")]
    slim = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    n_ranges = _ranges(docs, text, 0.25)
    rows = stored(text_anchors(slim, window, n_ranges), "dedup-texts")
    firsts = rows.filter("doc_id IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("rep"))
    named = rows.join(firsts, "node")
    hits = named.filter("doc_id = rep AND anchors IS NOT NULL").groupBy("doc_id").agg(F.collect_set(F.struct("node", "anchors")).alias("lists"))
    found = stored(segments(slim, hits, window, n_ranges), "dedup-segments")
    least = least_documents(found, window)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Starts of the windows that an earlier document has."""
        for b in batches:
            out = ([], [], [])
            for doc, node, starts, blob in zip(*(c.to_pylist() for c in b.columns)):
                at = np.flatnonzero(np.frombuffer(blob, "<i8") < doc)
                if len(at):
                    at = (np.frombuffer(starts, "<i4")[:, None] + at).reshape(-1)
                    for col, v in zip(out, (doc, node, at.astype("<i4").tobytes())):
                        col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.binary())], names=["doc_id", "node", "starts"])

    marks = found.select("anchor", "seg", "doc_id", "node", "starts").join(least, ["anchor", "seg"]).select("doc_id", "node", "starts", "least").mapInArrow(tidy(mark), "doc_id long, node long, starts binary")
    copies = named.filter(f"rep < doc_id AND n >= {window}").select("doc_id", "node", F.lit(None).cast("binary").alias("starts"))
    verdicts = marks.unionByName(copies).groupBy(F.col("doc_id").alias("__key")).agg(F.collect_set(F.struct("node", "starts")).alias("__marks"))
    both = docs.select(*[docs[f"`{c}`"] for c in keep])
    place, types = keep.index(text), both.schema
    joined = both.join(verdicts, F.col(f"`{key}`").cast("long") == F.col("__key"), "left").select(*[F.col(f"`{c}`") for c in keep], "__marks")

    span = np.arange(window)

    def take_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = string_buffers(batch.column(place))
            verdict = batch.column(len(keep)).to_pylist()
            for a, b in chunks(offsets):
                bounds = offsets[a : b + 1] - offsets[a]
                raw, s, e, first = words(data[offsets[a] : offsets[b]], bounds)
                gone = np.zeros(len(s), bool)
                for d, (i, j) in enumerate(zip(first[:-1].tolist(), first[1:].tolist()), a):
                    if verdict[d]:
                        lo, hi = (s[i], e[j - 1]) if j > i else (0, 0)
                        node = _node(word_hashes(raw[lo:hi], s[i:j] - lo, e[i:j] - lo))
                        mine = [m["starts"] for m in verdict[d] if m["node"] == node]
                        if None in mine:  # a copy
                            gone[i:j] = True
                        elif mine:
                            gone[i + (np.frombuffer(b"".join(mine), "<i4")[:, None] + span).reshape(-1)] = True
                before = np.concatenate([[0], np.cumsum(gone)])
                out = [pa.array(np.diff(first)), pa.array(before[first[1:]] - before[first[:-1]]), _joined(raw, bounds, s, e, first, ~gone)]
                yield pa.RecordBatch.from_arrays([*(c.slice(a, b - a) for c in batch.columns[: len(keep)]), *out], names=[*keep, "n_words", "n_removed", "kept"])

    new = [T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType())]
    return joined.mapInArrow(tidy(take_out), T.StructType([*types.fields, *new]))
