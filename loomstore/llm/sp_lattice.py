"""SentencePiece encoding and decoding as relations.

1. One pass cuts texts into *words*: runs that no piece can cross, as no piece has the two characters on either
   side of a cut next to each other. (So white space ends a word, and so does punctuation that no piece joins to letters.)
   A task gathers its texts into blocks of bounded size; a block has each of its distinct words once, and its texts as lists of
   places among them. Words and texts of a block meet by one shuffle, which is all that there is.
2. A word becomes its lattice: its substrings up to the longest piece are exploded, joined to the piece table by
   equality, and grouped again by word.
3. The lattice is folded with Spark's higher-order ``aggregate``. The models at hand are of the BPE kind, whose result is not the
   path of best total score (Viterbi's) but that of merging the best pair of neighbours again and again, so the fold's step
   is such a merge. Its state is the cuts that are left, as bits of a long; the step takes the first edge, by score and then
   place, that lies between two cuts and has one inside. (For a unigram model the step would be Viterbi's; such a model is refused.)
4. The block's texts are put together from their words' ids. A character alone is its piece, or its bytes.

Words that are frequent in a sample (every SAMPLE-th text) go through the same lattice first and are broadcast, with
their ids, as at most FREQUENT words of at most LONG characters; this saves work and changes no result. A run of more
than LONG characters without a place that no piece crosses (one letter a thousand times) is merged by a heap in the first pass.

Decoding is a join by position in the piece table, with Arrow's kernels: pieces as bytes, put together, read as UTF-8.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import held, shuffle_partitions, small_batches, stored, tidy
from .textops import chunks, mix, span_hashes, string_buffers

MARK = "▁"
FREQUENT, SAMPLE, FREQUENT_TASKS = 400_000, 8, 64
LONG = 32
#: Text of a block. A task's edges are sorted in memory, about 120 bytes for each of some 15 edges of a word; a block has about 50,000 words.
BLOCK_BYTES, MOST_TASKS = 5 << 20, 20_000


class Model:
    """A model file: its pieces, and which characters they have side by side."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as proto

        spec = proto.ModelProto()
        with open(path, "rb") as f:
            spec.ParseFromString(f.read())
        norm, train = spec.normalizer_spec, spec.trainer_spec
        if train.model_type != 2 or not train.byte_fallback or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.add_dummy_prefix or not norm.escape_whitespaces:
            raise ValueError(f"{path}: only BPE models with byte fallback and without normalisation are supported")
        scores = sorted({p.score for p in spec.pieces if p.type == 1}, reverse=True)
        place = {x: k for k, x in enumerate(scores)}
        self.rows = [(p.piece, i, place[p.score]) for i, p in enumerate(spec.pieces) if p.type == 1]
        if len(spec.pieces) >= 1 << 20 or LONG >= 1 << 6:
            raise ValueError(f"{path}: too many pieces")
        self.table = {p: (rank, i) for p, i, rank in self.rows}
        self.longest = max(map(len, self.table))
        self.first_byte = next(i for i, p in enumerate(spec.pieces) if p.piece == "<0x00>")
        #: The bytes that each id stands for.
        self.raw = [{1: p.piece.encode(), 2: " ⁇ ".encode(), 6: bytes([max(0, i - self.first_byte) & 255])}.get(p.type, b"") for i, p in enumerate(spec.pieces)]
        side = {(a, b) for p in self.table for a, b in zip(p, p[1:])}
        chars = sorted({c for ab in side for c in ab})
        self.number = np.zeros(0x110000, np.int32)  # of a character that some piece has beside another; 0: none
        self.number[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        at = {c: i + 1 for i, c in enumerate(chars)}
        self.beside = np.zeros((len(chars) + 1, len(chars) + 1), bool)
        self.beside[[at[a] for a, _ in side], [at[b] for _, b in side]] = True
        self.value = mix(np.arange(1, 0x110001, dtype=np.uint64)) | np.uint64(1)

    def words(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, str, np.ndarray]:
        """(start of each word, one more at the end; for each text the place of its first word, one more at the end; the marked texts end to end; a hash of each word)."""
        marked = [MARK + t.replace(" ", MARK) if t else "" for t in texts]
        text = "".join(marked)
        cp = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        bounds = np.concatenate([[0], np.cumsum([len(t) for t in marked])]).astype(np.int64)
        n = self.number[cp]
        start = np.ones(len(cp) + 1, bool)
        start[1:-1] = ~self.beside[n[:-1], n[1:]]
        start[bounds] = True
        starts = np.flatnonzero(start)
        return starts, np.searchsorted(starts, bounds), text, span_hashes(self.value[cp], starts[:-1], starts[1:])

    def hashes(self, text: str, starts: np.ndarray) -> np.ndarray:
        return span_hashes(self.value[np.frombuffer(text.encode("utf-32-le"), np.uint32)], starts[:-1], starts[1:])

    def settle(self, offsets: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lists of ids as fold gives them -> (offsets, values) of plain ids: a single character becomes its piece, or its bytes."""
        single = np.flatnonzero(values < 0)
        code, uniq = pd.factorize(values[single])
        own = [[self.table[c][1]] if (c := chr(-1 - v)) in self.table else [b + self.first_byte for b in c.encode()] for v in uniq.tolist()]
        size = np.array([len(x) for x in own], np.int64)
        count = np.ones(len(values), np.int64)
        count[single] = size[code]
        ends = np.concatenate([[0], np.cumsum(count)])
        out = np.repeat(values, count)
        if len(single):
            flat = np.array([i for x in own for i in x], np.int32)
            begin = np.cumsum(size) - size
            step = np.arange(int(count[single].sum())) - np.repeat(np.cumsum(count[single]) - count[single], count[single])
            out[np.repeat(ends[:-1][single], count[single]) + step] = flat[np.repeat(begin[code], count[single]) + step]
        return ends[offsets], out

    def merged(self, w: str) -> list[int]:
        """The same merges as the fold's by a heap, for a word of any length."""
        n, pieces = len(w), self.table
        nxt, prv, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
        alive = [True] * n
        heap: list = []

        def offer(i: int) -> None:
            j = nxt[i]
            if j < n and end[j] - i <= self.longest and (p := pieces.get(w[i : end[j]])):
                heapq.heappush(heap, (p[0], i, end[i], end[j]))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, mid, e = heapq.heappop(heap)
            if not alive[i] or end[i] != mid or mid >= n or not alive[mid] or end[mid] != e:
                continue
            alive[mid] = False
            end[i], nxt[i] = e, nxt[mid]
            if nxt[i] < n:
                prv[nxt[i]] = i
            offer(i)
            if prv[i] >= 0:
                offer(prv[i])
        ids = []
        for i in range(n):
            if alive[i]:
                p = pieces.get(w[i : end[i]])
                ids += [p[1]] if p else [b + self.first_byte for b in w[i : end[i]].encode()]
        return ids


_models: dict[str, Model] = {}
held(_models.clear, "sentencepiece")


def model(path: str) -> Model:
    """One for each worker process and file."""
    if path not in _models:
        _models[path] = Model(path)
    return _models[path]


def piece_table(spark: SparkSession, path: str) -> DataFrame:
    """(piece, id, rank): the normal pieces of two characters and more, and an empty one of id -1; a smaller rank is a better score, equal scores have one rank. As large as the model, which is fixed."""
    return spark.createDataFrame([*(r for r in model(path).rows if len(r[0]) > 1), ("", -1, 0)], "piece string, id int, rank int")


def _packed() -> Column:
    """An edge as one long, in order of score and then place: a fourth of a struct's size in the sort that groups edges."""
    return F.shiftleft(F.col("rank").cast("long"), 32) + F.shiftleft(F.col("s").cast("long"), 26) + F.shiftleft(F.col("e").cast("long"), 20) + F.col("id")


def _bit(i: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), i)


def _unpacked(x: Column) -> Column:
    """id, ends (the bits of the edge's two places) and inner (those between)."""
    part = lambda by, bits: F.shiftright(x, by).bitwiseAND(F.lit((1 << bits) - 1)).cast("int")
    s, e = part(26, 6), part(20, 6)
    return F.struct(part(0, 20).alias("id"), _bit(s).bitwiseOR(_bit(e)).alias("ends"), (_bit(e) - _bit(s + 1)).alias("inner"))


def _bind(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def fold(word: Column, packed: Column) -> Column:
    """The ids of a word from its edges, as longs in order.

    All is one expression, in which each value is bound to a variable: a column that the optimiser may put in place of its name would be
    computed again in each step. A character that is left alone becomes -1 less its code point, for Model.settle.
    """
    n = F.length(word)

    def step(now: Column, _: Column) -> Column:
        """cuts: a bit for each place where the word is still cut. The first edge between two cuts that has one inside is taken."""
        cuts, edges = now["cuts"], now["edges"]
        fits = lambda x: (cuts.bitwiseAND(x["ends"]) == x["ends"]) & (F.bit_count(cuts.bitwiseAND(x["inner"])) == 1)
        taken = F.get(F.filter(edges, fits), F.lit(0))["inner"]
        return F.struct(cuts.bitwiseAND(F.bitwise_not(F.coalesce(taken, F.lit(0).cast("long")))).alias("cuts"), edges.alias("edges"))

    def ids(end: Column) -> Column:
        one = lambda s, e: F.get(F.filter(end["edges"], lambda x: x["ends"] == _bit(s).bitwiseOR(_bit(e))), F.lit(0))["id"]
        part = lambda s, e: F.when(e - s == 1, -1 - F.ascii(F.substring(word, s + 1, F.lit(1)))).otherwise(one(s, e))
        at = F.filter(F.sequence(F.lit(0), n), lambda i: end["cuts"].bitwiseAND(_bit(i)) != 0)
        return _bind(at, lambda x: F.zip_with(F.slice(x, F.lit(1), F.size(x) - 1), F.slice(x, F.lit(2), F.size(x) - 1), part))

    first = F.struct((F.call_function("shiftleft", F.lit(2).cast("long"), n) - 1).alias("cuts"), F.transform(packed, _unpacked).alias("edges"))
    return F.aggregate(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), first, step, ids)


def lattice(words: DataFrame, keys: list[str], pieces: DataFrame, longest: int) -> DataFrame:
    """words (keys, word, extra) -> (keys, ids, extra): one row for each of the keys; ids as fold gives them. A null word has no ids."""
    n = F.length("word")
    # Each place, then each length from there. What belongs to the key itself goes with the empty piece at place -1, which each key has once.
    last = F.when(F.col("word").isNull(), F.lit(-1)).otherwise(F.greatest(n - 2, F.lit(-1)))
    starts = words.select(*keys, "word", "extra", F.explode(F.sequence(F.lit(-1), last)).alias("s"))
    own = F.col("s") < 0
    starts = starts.select(*keys, "word", F.when(own, F.col("extra")).alias("extra"), "s")
    most = F.when(own, F.lit(2)).otherwise(F.least(n - F.col("s"), F.lit(longest)))
    parts = starts.select(*keys, "word", "extra", "s", F.explode(F.sequence(F.lit(2), most)).alias("k"))
    parts = parts.select(*keys, F.when(own, F.col("word")).alias("word"), "extra", "s", (F.col("s") + F.col("k")).alias("e"), F.when(own, F.lit("")).otherwise(F.substring(F.col("word"), F.col("s") + 1, F.col("k"))).alias("piece"))
    met = parts.join(F.broadcast(pieces), "piece").select(*keys, "word", "extra", F.when(F.col("id") >= 0, _packed()).alias("edge"))
    edges = met.groupBy(*keys).agg(F.max("word").alias("word"), F.max("extra").alias("extra"), F.sort_array(F.collect_list("edge")).alias("edges"))
    return edges.select(*keys, F.when(F.col("word").isNotNull(), fold(F.col("word"), F.col("edges"))).alias("ids"), "extra")


def frequent(docs: DataFrame, path: str, text: str, pieces: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes ascending, where each word's ids start and one more at the end, ids) of the words that most of every SAMPLE-th text have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, at = model(path), 0
        for batch in batches:
            own = [t for t in batch.column(0).take(pa.array(range(-at % SAMPLE, batch.num_rows, SAMPLE), pa.int64())).to_pylist() if t]
            at += batch.num_rows
            starts, _, joined, h = m.words(own)
            fine = np.diff(starts) <= LONG
            code, uniq = pd.factorize(h[fine])
            where = np.empty(len(uniq), np.int64)
            where[code[::-1]] = np.flatnonzero(fine)[::-1]
            a, b = starts[where].tolist(), starts[where + 1].tolist()
            yield pa.RecordBatch.from_arrays([pa.array([joined[x:y] for x, y in zip(a, b)], pa.string()), pa.array(np.bincount(code, minlength=len(uniq)), pa.int64())], names=["word", "n"])

    m, spark = model(path), docs.sparkSession
    often = docs.select(F.col(text).alias("text")).mapInArrow(tidy(run, ("sentencepiece",)), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter("n > 1").orderBy(F.desc("n"), "word").limit(FREQUENT)
    often = stored(often.select("word"), "pieces-frequent").repartition(FREQUENT_TASKS, "word").withColumn("extra", F.lit(None).cast("binary"))
    # At most FREQUENT words of at most LONG characters, which is also the bound of the broadcast.
    known = stored(lattice(often.withColumn("key", F.col("word")), ["key"], pieces, m.longest).select("key", "ids"), "pieces-known").toArrow()
    words = known.column("key").to_pylist()
    starts = np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int64)
    h = m.hashes("".join(words), starts) if words else np.zeros(0, np.uint64)
    order = np.argsort(h)
    if not words:
        return h, np.zeros(1, np.int64), np.zeros(0, np.int32)
    lists = known.column("ids").combine_chunks()
    begin, flat = m.settle(lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False))
    size = np.diff(begin)[order]
    ends = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
    return h[order], ends, flat[np.repeat(begin[:-1][order] - ends[:-1], size) + np.arange(ends[-1])].astype(np.int32)


BLOCK = pa.schema([("block", pa.int64()), ("place", pa.int32()), ("word", pa.string()), ("extra", pa.binary())])


class _Block:
    """Texts of a block: for each the places of its words among the block's distinct words."""

    def __init__(self):
        self.keys: list = []
        self.sizes: list[np.ndarray] = []
        self.codes: list[np.ndarray] = []
        self.hash: list[np.ndarray] = []
        self.words: list[list[str]] = []
        self.bytes = 0

    def add(self, m: Model, keys: list, texts: list[str], size: int) -> None:
        starts, first, joined, h = m.words(texts)
        code, uniq = pd.factorize(h)
        where = np.empty(len(uniq), np.int64)
        where[code[::-1]] = np.arange(len(code))[::-1]
        self.words.append([joined[a:b] for a, b in zip(starts[where].tolist(), starts[where + 1].tolist())])
        self.keys += keys
        self.sizes.append(np.diff(first))
        self.codes.append((code + sum(map(len, self.hash))).astype(np.int32))
        self.hash.append(uniq)
        self.bytes += size

    def close(self, m: Model, known: tuple, number: int) -> Iterator[pa.RecordBatch]:
        """The words that have no ids yet, and one row of all else: keys, sizes, places, and the known words' ids."""
        import pickle
        import zlib

        code, uniq = pd.factorize(np.concatenate(self.hash))
        where = np.empty(len(uniq), np.int64)
        where[code[::-1]] = np.arange(len(code))[::-1]
        words = [w for ws in self.words for w in ws]
        places = code[np.concatenate(self.codes)].astype("<u4")
        hashes, begin, flat = known
        at = np.minimum(np.searchsorted(hashes, uniq), max(0, len(hashes) - 1))
        hit = hashes[at] == uniq if len(hashes) else np.zeros(len(uniq), bool)
        long = {k: m.merged(words[where[k]]) for k in np.flatnonzero(~hit).tolist() if len(words[where[k]]) > LONG}
        want = [k for k in np.flatnonzero(~hit).tolist() if k not in long]
        # Planes of the places, as the upper bytes are mostly alike.
        planes = zlib.compress(np.ascontiguousarray(places.view(np.uint8).reshape(-1, 4).T).tobytes(), 1)
        body = pickle.dumps((self.keys, np.concatenate(self.sizes).astype("<i4").tobytes(), planes, np.flatnonzero(hit).astype("<i4").tobytes(), at[hit].astype("<i4").tobytes(), len(uniq), long), 5)
        # Named by the task and the content: a block's name stays when its task runs again, and blocks of equal content stay apart.
        name = (TaskContext.get().partitionId() << 33) + number
        block = int.from_bytes(hashlib.blake2b(body, digest_size=8, salt=name.to_bytes(8, "little")).digest(), "little", signed=True)
        for a in range(0, len(want), 1 << 16):
            part = want[a : a + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array([block] * len(part), pa.int64()), pa.array(part, pa.int32()), pa.array([words[where[k]] for k in part], pa.string()), pa.nulls(len(part), pa.binary())], schema=BLOCK)
        yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([-1], pa.int32()), pa.nulls(1, pa.string()), pa.array([body], pa.binary())], schema=BLOCK)


def encode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each row of docs: doc_id, n_pieces, ids, as the sentencepiece library gives them (without begin and end); ids as little-endian unsigned 32-bit integers.

    Null text is an empty one: no pieces. Rows of equal or null key stay rows of their own. A very long text is a block of its
    own. An empty table gives none. Other columns are not looked at.
    """
    spark, m = docs.sparkSession, model(path)
    small_batches(spark)
    pieces = piece_table(spark, path)
    known = spark.sparkContext.broadcast(frequent(docs, path, text, pieces))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, now, made = model(path), _Block(), 0
        for batch in batches:
            _, offsets = string_buffers(batch.column(1))
            for a, b in chunks(offsets):
                texts = ["" if t is None else t for t in batch.column(1).slice(a, b - a).to_pylist()]
                now.add(m, batch.column(0).slice(a, b - a).to_pylist(), texts, int(offsets[b] - offsets[a]))
                if now.bytes >= BLOCK_BYTES:
                    yield from now.close(m, known.value, made)
                    now, made = _Block(), made + 1
        if now.keys:
            yield from now.close(m, known.value, made)

    def put_together(t: pa.Table) -> pa.Table:
        import pickle
        import zlib

        t = t.combine_chunks()
        _, begin, flat = known.value
        place = t.column("place").to_numpy()
        got = t.column("ids").combine_chunks()
        bodies = [x for x in t.column("extra").to_pylist() if x is not None]
        if not bodies:
            raise RuntimeError("a block of words came without its texts")
        keys, sizes, planes, hit, at, n, long = pickle.loads(bodies[0])
        hit, at = np.frombuffer(hit, "<i4"), np.frombuffer(at, "<i4")
        offsets, values = model(path).settle(got.offsets.to_numpy(), got.values.to_numpy(zero_copy_only=False))
        extra = np.array([i for k in sorted(long) for i in long[k]], np.int32)
        # All ids of the block's words, wherever they come from, as one array: where each word's begin, and how many.
        source = np.concatenate([flat, values, extra])
        where, count = np.zeros(n, np.int64), np.zeros(n, np.int64)
        where[hit], count[hit] = begin[at], begin[at + 1] - begin[at]
        mine = place >= 0
        where[place[mine]], count[place[mine]] = len(flat) + offsets[:-1][mine], np.diff(offsets)[mine]
        sizes_long = np.array([len(long[k]) for k in sorted(long)], np.int64)
        if long:
            where[sorted(long)], count[sorted(long)] = len(flat) + len(values) + np.cumsum(sizes_long) - sizes_long, sizes_long
        raw = np.frombuffer(zlib.decompress(planes), np.uint8)
        places = np.ascontiguousarray(raw.reshape(4, -1).T).view("<u4").reshape(-1)
        c = count[places]
        ends = np.concatenate([[0], np.cumsum(c)]).astype(np.int64)
        ids = source[np.repeat(where[places] - ends[:-1], c) + np.arange(ends[-1])]
        bounds = ends[np.concatenate([[0], np.cumsum(np.frombuffer(sizes, "<i4"))])]
        packed = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(keys), [None, pa.py_buffer(4 * bounds), pa.py_buffer(ids.astype("<u4"))]).cast(pa.binary())
        return pa.table([pa.array(keys, pa.int64()), pa.array(np.diff(bounds), pa.int64()), packed], names=["doc_id", "n_pieces", "ids"])

    def in_group(t):
        from .shared import drop_held, give_back

        drop_held(("sentencepiece",))
        try:
            return put_together(t)
        finally:
            give_back()

    blocks = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(tidy(cut, ("sentencepiece",)), "block long, place int, word string, extra binary")
    size = docs.agg(F.sum(F.octet_length(text).cast("long"))).first()[0] or 0
    tasks = min(MOST_TASKS, 2 * (1 + size // BLOCK_BYTES))  # twice as many as blocks, so that few tasks get several
    rows = lattice(blocks.repartition(max(shuffle_partitions(spark), tasks), "block"), ["block", "place"], pieces, m.longest)
    return rows.groupBy("block").applyInArrow(in_group, "doc_id long, n_pieces long, ids binary")


def decode(rows: DataFrame, path: str, ids: str = "ids", name: str = "text") -> DataFrame:
    """rows with the text of their ids (little-endian unsigned 32-bit integers) added: pieces joined, bytes put together, marks read as spaces, the first one dropped.

    Null ids give null, no ids an empty text. Bytes that are no UTF-8 become U+FFFD, one for each maximal wrong run
    (the library: one for each wrong byte); encode() gives no such ids. An id outside the table counts for nothing. Other columns
    stay; one of that name is replaced.
    """
    small_batches(rows.sparkSession)
    keep = [c for c in rows.columns if c != name]
    place = keep.index(ids)
    kept = rows.select(*[rows[f"`{c}`"] for c in keep])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        table = pa.array([*m.raw, b""], pa.large_binary())
        for batch in batches:
            lists = batch.column(place)
            raw = lists.cast(pa.large_binary()).fill_null(b"")
            off = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1]
            data = raw.buffers()[2]
            flat = np.frombuffer(data, np.uint8)[off[0] : off[-1]].view("<u4") if data is not None and off[-1] > off[0] else np.zeros(0, "<u4")
            flat = np.minimum(flat, len(m.raw))
            ends = (off - off[0]) // 4
            joined = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(ends), table.take(pa.array(flat))), pa.scalar(b"", pa.large_binary()))
            high = np.concatenate([[0], np.cumsum((flat >= m.first_byte + 128) & (flat < m.first_byte + 256))])[ends]
            odd = np.flatnonzero(np.diff(high))  # with bytes above 127, which may be wrong
            if len(odd):
                texts = joined.to_pylist()
                for i in odd.tolist():
                    texts[i] = texts[i].decode("utf-8", "replace").encode()
                joined = pa.array(texts, pa.large_binary())
            text = pc.replace_substring(joined.cast(pa.large_string()), MARK, " ")
            text = pc.if_else(pc.starts_with(text, " "), pc.utf8_slice_codeunits(text, 1), text)
            text = pc.if_else(lists.is_null(), pa.scalar(None, pa.large_string()), text).cast(pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, text], names=[*keep, name])

    return kept.mapInArrow(tidy(run, ("sentencepiece",)), T.StructType([*kept.schema.fields, T.StructField(name, T.StringType())]))
