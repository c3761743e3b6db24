"""Documents whose sets of word shingles are alike: an exact Jaccard join by vertical partitioning.

1. One pass hashes shingles. For each document the smallest hashes go out as *probes*, in blobs sorted by
   hash range. Two linked documents miss at most m = n - ceil(t n) of each other's shingles, so among
   the first 2m + 1 hashes of a document at least m + 1 must be found in another one. Few documents
   pass; the rest have no link. (Enough hashes go out that a partner's shared probes are among them.)
2. Documents with equal sets are one node from here on.
3. The global n-gram order is (rare before frequent, hash), by the count among nodes. A node with more
   than m shingles of its own has no link. Prefixes in that order give candidates: a node and another share
   one of the first m + 1 of each.
4. Candidates are first taken against one pivot for each prefix n-gram, a number linear in the prefixes. Then
   components are contracted, and only pairs of nodes of different components that share a prefix n-gram
   are left. Of these, two bounds drop pairs that cannot be linked: at the first n-gram two nodes share, what follows
   in the order must hold the overlap; and parity signatures of the sets differ in at most as many bits as the sets
   in n-grams. All others are tried, so no link that joins components is lost.
5. A pair is decided by vertical partitions: the global order is cut into fragments, overlaps are counted
   in each fragment by itself, and summed for each pair; the test is in whole numbers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import stored, tidy, tidy_group
from .textops import chunks, document_grams, string_buffers, word_hashes, words

RANGE_TOKENS = 2_000_000
BATCH_BYTES, BATCH_DOCS = 8 << 20, 16_384
FRAGMENTS = 8
PARITY_WORDS = 16  # longs of a parity signature; a power of two
META = np.dtype([("doc_id", "<i8"), ("null", "?"), ("n", "<i4"), ("node", "<i8"), ("tag", "<i8")])


def _sets(data: np.ndarray, offsets: np.ndarray, k: int) -> Iterator[np.ndarray]:
    """Each document's distinct shingle hashes, ascending."""
    low, starts, ends, first = words(data, offsets, lower=True)
    for g in document_grams(word_hashes(low, starts, ends), first, k):
        yield np.unique(g)


def _node(s: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True)


def _ranges(docs: DataFrame, text: str, probes: float) -> int:
    """A power of two: ranges of hashes, of about RANGE_TOKENS probes each."""
    chars = docs.agg(F.sum(F.length(text).cast("long"))).first()[0] or 0
    return 1 << max(4, int(np.ceil(np.log2(max(1.0, chars / 6 * probes / RANGE_TOKENS)))))


def document_nodes(docs: DataFrame, k: int, num: int, den: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n, node, may, tag): for each row the size and the hash of its set, whether it may have a link, and xxhash64 of its text."""
    miss = lambda n: n - (n * num + den - 1) // den
    probe = lambda n: np.minimum(n, 2 * miss(n) + 1)
    n_ranges = _ranges(docs, text, min(1.0, 2 * (den - num) / num + (den - num) / den))
    bits = n_ranges.bit_length() - 1

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = string_buffers(batch.column(1))
            keys = batch.column(0)
            for a, b in ((x, min(x + BATCH_DOCS, d)) for c, d in chunks(offsets, BATCH_BYTES) for x in range(c, d, BATCH_DOCS)):
                sets: list[np.ndarray] = []
                for c, d in chunks(offsets[a : b + 1] - offsets[a]):
                    lo = offsets[a + c]
                    sets += _sets(data[lo : offsets[a + d]], offsets[a + c : a + d + 1] - lo, k)
                meta = np.zeros(b - a, META)
                ids = keys.slice(a, b - a)
                meta["null"] = ids.is_null().to_numpy(zero_copy_only=False)
                meta["doc_id"] = ids.fill_null(0).to_numpy(zero_copy_only=False)
                meta["tag"] = batch.column(2).slice(a, b - a).to_numpy(zero_copy_only=False)
                n = meta["n"] = np.array([len(s) for s in sets], np.int64)
                meta["node"] = [_node(s) for s in sets]
                q = probe(n.astype(np.int64))
                out = np.minimum(n, (2 * ((n * (den - num)) // num) + 2) + miss(n.astype(np.int64)) + 1)
                h = np.concatenate([s[:o] for s, o in zip(sets, out)]) if len(sets) else np.zeros(0, np.uint64)
                doc = np.repeat(np.arange(b - a), out)
                asks = np.arange(len(h)) - np.repeat(np.cumsum(out) - out, out) < np.repeat(q, out)
                order = np.argsort(h, kind="stable")
                h, doc = h[order], (doc | asks.astype(np.int64) << 15)[order].astype("<u2")
                cut = np.searchsorted(h >> np.uint64(64 - bits), np.arange(n_ranges + 1))
                low = (h >> np.uint64(32 - bits)).astype("<u4")
                uid = int.from_bytes(hashlib.blake2b(meta.tobytes() + h[:4096].tobytes(), digest_size=8).digest(), "little", signed=True)
                home = uid % n_ranges
                rows = [{"range": r, "batch": uid, "h": low[cut[r] : cut[r + 1]].tobytes(), "doc": doc[cut[r] : cut[r + 1]].tobytes(), "meta": meta.tobytes() if r == home else None} for r in range(n_ranges) if cut[r] < cut[r + 1] or r == home]
                yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("range", pa.int32()), ("batch", pa.int64()), ("h", pa.binary()), ("doc", pa.binary()), ("meta", pa.binary())]))

    def meet(rows: pd.DataFrame) -> pd.DataFrame:
        """Which of one range's probes more than one document has; counts for each batch's documents."""
        sizes = rows.h.map(len).to_numpy() // 4
        h = np.frombuffer(b"".join(rows.h), "<u4")
        order = np.argsort(h, kind="stable")
        same = h[order][1:] == h[order][:-1]
        shared = np.zeros(len(h), bool)
        shared[order[1:]] |= same
        shared[order[:-1]] |= same
        out, at = [], 0
        for batch, doc, meta, n in zip(rows.batch, rows.doc, rows.meta, sizes.tolist()):
            d = np.frombuffer(doc, "<u2")
            got = np.bincount(d[(d >> 15 == 1) & shared[at : at + n]] & 0x7FFF)
            hit = np.flatnonzero(got)
            at += n
            if len(hit) or meta is not None:
                out.append((batch, hit.astype("<u2").tobytes(), got[hit].astype("<u4").tobytes(), meta))
        return pd.DataFrame(out, columns=["batch", "doc", "hits", "meta"])

    def decide(rows: pd.DataFrame) -> pd.DataFrame:
        metas = [m for m in rows.meta if m is not None]
        if not metas:
            raise RuntimeError("a batch of probes came without its documents")
        meta = np.frombuffer(metas[0], META)  # batches of equal content (repeated rows) have equal documents
        hits = np.zeros(len(meta), np.int64)
        for d, c in zip(rows.doc, rows.hits):
            np.add.at(hits, np.frombuffer(d, "<u2"), np.frombuffer(c, "<u4"))
        n = meta["n"].astype(np.int64)
        may = (n > 0) & (hits >= probe(n) - miss(n)) & ~meta["null"]
        one = pd.DataFrame({"doc_id": pd.array(meta["doc_id"], "Int64").copy(), "n": n.astype(np.int32), "node": meta["node"], "may": may, "tag": meta["tag"]})
        one.loc[meta["null"], "doc_id"] = pd.NA
        return pd.concat([one] * len(metas))

    blobs = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("tag")).mapInArrow(tidy(hashes), "range int, batch long, h binary, doc binary, meta binary")
    counts = blobs.groupBy("range").applyInPandas(tidy_group(meet), "batch long, doc binary, hits binary, meta binary")
    return counts.groupBy("batch").applyInPandas(tidy_group(decide), "doc_id long, n int, node long, may boolean, tag long")


def node_sets(docs: DataFrame, nodes: DataFrame, k: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(node, n, grams) of one document for each node; nodes (doc_id, node)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = string_buffers(batch.column(1))
            want = batch.column(0).to_numpy(zero_copy_only=False)
            for a, b in chunks(offsets):
                sets = list(_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], k))
                keep = [(w, s) for w, s in zip(want[a:b].tolist(), sets) if _node(s) == w]  # a row of the same id but another text is not meant
                flat = np.concatenate([s for _, s in keep]).view(np.int64) if keep else np.zeros(0, np.int64)
                off = np.concatenate([[0], np.cumsum([len(s) for _, s in keep])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in keep], pa.int64()), pa.array([len(s) for _, s in keep], pa.int32()), pa.ListArray.from_arrays(pa.array(off), pa.array(flat))], names=["node", "n", "grams"])

    mine = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).join(nodes, "doc_id").select("node", "text")
    return mine.mapInArrow(tidy(run), "node long, n int, grams array<long>")


def parities(nodes: DataFrame) -> DataFrame:
    """(node, grams) -> (node, s0, s1, ...): bit i is set where an odd number of the grams fall on i."""
    names = [f"s{i}" for i in range(PARITY_WORDS)]
    bits = PARITY_WORDS * 64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grams = batch.column(1)
            flat = grams.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            row = np.repeat(np.arange(len(grams)), np.diff(grams.offsets.to_numpy()))
            odd = np.bincount(row * bits + (flat % np.uint64(bits)).astype(np.int64), minlength=len(grams) * bits) & 1
            sig = np.packbits(odd.astype(np.uint8)).view(np.int64).reshape(len(grams), PARITY_WORDS)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(np.ascontiguousarray(x)) for x in sig.T)], names=["node", *names])

    return nodes.select("node", "grams").mapInArrow(tidy(run), ", ".join(f"{x} long" for x in ["node", *names]))


def _differ(x: str, y: str) -> Column:
    """A lower bound of the number of n-grams in one of two sets only: each's own n-grams, and the bits in which the signatures of the others differ."""
    own = F.col(f"{x}.n") - F.col(f"{x}.c") + F.col(f"{y}.n") - F.col(f"{y}.c")
    return sum((F.bit_count(F.col(f"{x}.s{i}").bitwiseXOR(F.col(f"{y}.s{i}"))) for i in range(PARITY_WORDS)), own)


def _enough(least: Column, n1: Column, n2: Column, num: int, den: int) -> Column:
    """Can an overlap of `least` reach num/den of the union?"""
    return (num + den) * least >= num * (n1.cast("long") + n2.cast("long"))


def verified(pairs: DataFrame, segments: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b, na, nb) whose overlap o, counted in fragments and summed, reaches num/den of the union."""
    one = pairs.join(segments.withColumnRenamed("node", "a").withColumnRenamed("segment", "sa"), "a")
    two = one.join(segments.withColumnRenamed("node", "b").withColumnRenamed("segment", "sb"), ["b", "fragment"])
    partial = two.select("a", "b", "na", "nb", F.size(F.array_intersect("sa", "sb")).cast("long").alias("part"))
    whole = partial.groupBy("a", "b", "na", "nb").agg(F.sum("part").alias("o"))
    return whole.filter(den * F.col("o") >= num * (F.col("na").cast("long") + F.col("nb") - F.col("o")))


def _postings(sets: DataFrame, num: int, den: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of sets (node, n, grams): the nodes that may have a link with their n-grams in the global order, the postings of their prefixes, and all their n-grams in fragments."""
    long_n = F.col("n").cast("long")
    miss = long_n - F.ceil(long_n * num / den).cast("long")
    tokens = sets.select("node", "n", F.explode("grams").alias("h"))
    often = tokens.groupBy("h").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    common = tokens.join(often, "h").groupBy("node", "n").agg(F.sort_array(F.collect_set(F.struct("df", "h"))).alias("g"))
    # Not those with more shingles of their own than a link can miss.
    common = stored(common.withColumn("c", F.size("g")).filter(den * F.col("c").cast("long") >= num * long_n), "join-nodes")
    prefix = F.slice("g", F.lit(1), F.greatest(F.lit(0), miss + 1 - (F.col("n") - F.col("c"))).cast("int"))
    posts = stored(common.select("node", "n", "c", F.posexplode(prefix).alias("at", "t")).select(F.col("t.h").alias("h"), "node", "n", "c", "at"), "join-prefixes")

    def fragment(f: int) -> Column:
        """Contiguous in the order (df under 4 or not, hash)."""
        rare, quarter = f < FRAGMENTS // 2, f % (FRAGMENTS // 2)
        step = 2**64 // (FRAGMENTS // 2)
        lo, hi = -(2**63) + quarter * step, -(2**63) + (quarter + 1) * step - 1
        return F.transform(F.filter("g", lambda t: ((t["df"] < 4) == F.lit(rare)) & t["h"].between(lo, hi)), lambda t: t["h"])

    cut = F.explode(F.array(*[F.struct(F.lit(f).alias("fragment"), fragment(f).alias("segment")) for f in range(FRAGMENTS)]))
    segments = common.select("node", cut.alias("s")).select("node", "s.fragment", "s.segment").filter(F.size("segment") > 0)
    return common, posts, segments


def _ordered(df: DataFrame, x: str, nx: str, y: str, ny: str) -> DataFrame:
    flip = F.col(x) > F.col(y)
    return df.select(F.when(flip, F.col(y)).otherwise(F.col(x)).alias("a"), F.when(flip, F.col(x)).otherwise(F.col(y)).alias("b"), F.when(flip, F.col(ny)).otherwise(F.col(nx)).alias("na"), F.when(flip, F.col(nx)).otherwise(F.col(ny)).alias("nb")).distinct()


def _met(left: DataFrame, common: DataFrame, apart: str, num: int, den: int) -> DataFrame:
    """The pairs (a, b, na, nb) of postings that share a prefix n-gram, differ in `apart`, and may be linked by position and by parity signatures."""
    signed = parities(common.join(left.select("node").distinct(), "node", "left_semi").select("node", F.transform("g", lambda t: t["h"]).alias("grams")))
    left = stored(left.join(signed, "node"), "join-rest-signed")
    x, y = left.alias("x"), left.alias("y")
    sizes = F.col("x.n").cast("long") + F.col("y.n")
    # At the first n-gram that both have, the overlap is in what follows; there the pair is found, if it is linked.
    follows = _enough(F.least(F.col("x.c") - F.col("x.at"), F.col("y.c") - F.col("y.at")), F.col("x.n"), F.col("y.n"), num, den)
    close = (num + den) * _differ("x", "y").cast("long") <= (den - num) * sizes
    met = x.join(y, (F.col("x.h") == F.col("y.h")) & (F.col(f"x.{apart}") < F.col(f"y.{apart}")) & follows & close)
    return _ordered(met.select(F.col("x.node").alias("node"), F.col("x.n").alias("n"), F.col("y.node").alias("pn"), F.col("y.n").alias("pnn")), "node", "n", "pn", "pnn")


def class_links(sets: DataFrame, num: int, den: int) -> DataFrame:
    """sets (node, n, grams) -> (a, b, na, nb, o): every linked pair of nodes once, a < b, with its counted overlap. As many rows as links: a group of m that all link has m (m - 1) / 2."""
    common, posts, segments = _postings(sets, num, den)
    return verified(stored(_met(posts, common, "node", num, den), "join-pairs"), segments, num, den)


def link(sets: DataFrame, num: int, den: int) -> DataFrame:
    """sets (node, n, grams) -> (node, component) of the nodes that have a link. Not all links are counted for that; class_links has them."""
    common, posts, segments = _postings(sets, num, den)
    pivots = posts.groupBy("h").agg(F.min(F.struct((F.col("n") - F.col("c")).alias("own"), "node", "n", "c")).alias("p"), F.count(F.lit(1)).alias("posts")).filter("posts > 1")
    near = posts.join(pivots.select("h", "p"), "h").filter(F.col("node") != F.col("p.node")).filter(_enough(F.least("c", "p.c"), F.col("n"), F.col("p.n"), num, den))

    tried = stored(_ordered(near.select("node", "n", F.col("p.node").alias("pn"), F.col("p.n").alias("pnn")), "node", "n", "pn", "pnn"), "join-pairs")
    links = stored(verified(tried, segments, num, den).select(F.col("a").alias("u"), F.col("b").alias("v")), "join-links")
    parts = stored(components(links), "join-parts")

    named = posts.join(parts, "node", "left").select("h", "node", "n", "c", "at", F.coalesce("component", "node").alias("part"))
    mixed = named.groupBy("h").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).filter("lo <> hi").select("h")
    left = stored(named.join(mixed, "h", "left_semi"), "join-rest")
    rest = _met(left, common, "part", num, den).join(tried.select("a", "b"), ["a", "b"], "left_anti")
    more = verified(rest, segments, num, den).select(F.col("a").alias("u"), F.col("b").alias("v"))
    return components(links.unionByName(more))


def _clustered(docs: DataFrame, k: int, num: int, den: int, key: str, text: str) -> DataFrame:
    """(doc_id, tag, n, may, component_id) for each row of docs; those that may not have a link are alone."""
    nodes = stored(document_nodes(docs, k, num, den, key, text), "join-documents")
    reps = nodes.filter("may").groupBy("node").agg(F.min("doc_id").alias("rep"))
    parts = link(stored(node_sets(docs, reps.select(F.col("rep").alias("doc_id"), "node"), k, key, text), "join-sets"), num, den)
    named = reps.join(parts, "node", "left").select("node", "rep", F.coalesce("component", "node").alias("part"))
    least = named.groupBy("part").agg(F.min("rep").alias("component_id"))
    by_node = named.join(least, "part").select("node", "component_id")
    known = nodes.filter("may").join(by_node, "node").select("doc_id", "tag", "n", "may", "component_id")
    return known.unionByName(nodes.filter("NOT may").select("doc_id", "tag", "n", "may", F.col("doc_id").alias("component_id")))


def cluster(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id for each row of docs; two documents are linked when the Jaccard similarity of their sets of k-word shingles is num/den at least.

    A-Z are lower-cased. A document of fewer than k words has one shingle; without words (or text) it has
    none and no link. component_id is the smallest doc_id that links reach. Rows of equal doc_id but other
    text are judged by themselves; a row whose doc_id is null has no link and component_id null. A very long text is handled
    whole. An empty table gives none. Extra columns are not looked at.
    """
    return _clustered(docs, k, num, den, key, text).select("doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id")


def one_of_each(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, but of each group of linked documents only one: that of the smallest key, and of its texts the one of smallest hash.

    Rows are told apart by key and text (its 64-bit hash), so another text under the key of a copy stays. Of rows that agree in
    both, one stays. Rows without words or without a key have no link, and all stay. An empty table gives none.
    """
    rows = stored(_clustered(docs, k, num, den, key, text).filter("may").select("doc_id", "tag", "component_id"), "join-groups")
    # A component is named by its smallest key, so only the rows of that key are looked at together; the others go.
    heads = rows.filter("doc_id = component_id").groupBy("doc_id", "tag").agg(F.count(F.lit(1)).alias("rows"))
    first = heads.groupBy("doc_id").agg(F.min("tag").alias("first"))
    told = heads.join(first, "doc_id").select("doc_id", "tag", (F.col("tag") == F.col("first")).alias("__stays"), "rows").filter("NOT __stays OR rows > 1")
    told = told.unionByName(rows.filter("component_id < doc_id").select("doc_id", "tag").distinct().withColumns({"__stays": F.lit(False), "rows": F.lit(1).cast("long")}))
    told = stored(told.select(F.col("doc_id").alias("__key"), F.col("tag").alias("__tag"), "__stays"), "join-gone")
    same = (F.col(f"`{key}`").cast("long") == F.col("__key")) & (F.xxhash64(f"`{text}`") == F.col("__tag"))
    out = docs.join(told, same, "left_anti")
    if not told.filter("__stays").isEmpty():
        out = out.unionByName(docs.join(told.filter("__stays"), same).dropDuplicates(["__key", "__tag"]).select(*[f"`{c}`" for c in docs.columns]))
    return out


def links(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """All links, as (pairs, members), with the rules of cluster().

    pairs: (a, b, n_a, n_b, overlap) of linked classes, a < b, each once. A class is all rows with the same set of shingles.
    members: (doc_id, n_shingles, class_id, n_links) for each row of docs; n_links counts the other rows of its class and all rows
    of the classes linked to it. Rows without words, or without a doc_id, have no link; class_id is null for those without words.
    """
    nodes = stored(document_nodes(docs, k, num, den, key, text), "join-documents")
    may = nodes.filter("may")
    reps = may.groupBy("node").agg(F.min("doc_id").alias("doc_id"))
    pairs = stored(class_links(stored(node_sets(docs, reps, k, key, text), "join-sets"), num, den), "join-links")
    size = may.groupBy("node").agg(F.count(F.lit(1)).alias("size"))
    both = pairs.select(F.col("a").alias("to"), F.col("b").alias("node")).unionByName(pairs.select(F.col("b").alias("to"), F.col("a").alias("node")))
    other = both.join(size, "node").groupBy(F.col("to").alias("node")).agg(F.sum("size").alias("other"))
    count = size.join(other, "node", "left").select("node", F.lit(True).alias("may"), (F.col("size") - 1 + F.coalesce("other", F.lit(0))).alias("links"))
    members = nodes.join(count, ["node", "may"], "left")
    members = members.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") > 0, F.col("node")).alias("class_id"), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"))
    return pairs.select("a", "b", F.col("na").alias("n_a"), F.col("nb").alias("n_b"), F.col("o").alias("overlap")), members
