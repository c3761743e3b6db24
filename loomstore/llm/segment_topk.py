"""Exact top-k by inner product of integer vectors, with bounds from segment means and deviations.

A vector is cut into equal segments at several resolutions. With m and d a segment's mean and (population)
deviation and n its length, the squared distance of two segments is at least n ((m1-m2)^2 + (d1-d2)^2);
for inner products this says that a segment adds at most n (m1 m2 + d1 d2).

1. Vectors are sorted by their coarse means into blocks. A block's box (least and greatest mean, greatest deviation, for each
   segment) bounds what any query can score in it.
2. Each block of queries is beside the boxes of all blocks of candidates, which are a few numbers each. It is first searched in
   the PROBES blocks of highest bound, whole; that gives each query a floor, its k-th best score so far.
3. Blocks whose bound reaches no floor are not fetched. Those left are searched in order of bound, and floors rise as blocks
   are done: a query that a block's box excludes is left out; of the others, bounds go from coarse to fine, each computed for the pairs
   that the one before left; what survives all of them gets its exact score.

Where vectors point in all directions alike, no bound is below a floor, and what is left is a product of all pairs, in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import vectors as V
from .shared import stored

RESOLUTIONS = (1, 4, 16)
BOX = 16  # segments of a block's box
PROBES = 1
LANES = 8  # tasks, at most, that share one block of queries after the probes
DENSE = 0.25  # of the pairs: below it, bounds and scores are computed pair by pair


def _cuts(width: int, segments: int) -> np.ndarray:
    return np.unique(np.linspace(0, width, min(segments, max(1, width)) + 1).astype(int))


def statistics(x: np.ndarray, segments: int) -> np.ndarray:
    """(rows, 2 * segments): sqrt(n) times means, and sqrt(n) times deviations. The product of two rows bounds the inner product from above."""
    cuts = _cuts(x.shape[1], segments)
    f = x.astype(np.float64)
    parts = [f[:, a:b] for a, b in zip(cuts[:-1], cuts[1:])]
    root = np.sqrt(np.diff(cuts))
    return np.concatenate([np.stack([p.mean(1) for p in parts], 1) * root, np.stack([p.std(1) for p in parts], 1) * root], 1)


def lengths(x: np.ndarray) -> np.ndarray:
    f = x.astype(np.float64)
    return np.sqrt(np.einsum("ij,ij->i", f, f))


def exact(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products of all rows of q with all of x, as whole numbers; beyond 64 bits they are cut to the range of long."""
    top = float(np.abs(x.astype(np.float64)).max(initial=0)) * float(np.abs(q.astype(np.float64)).max(initial=0)) * x.shape[1]
    if top < 2**53:
        return (q.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64)
    if top < 2**62:
        return q @ x.T
    full = q.astype(object) @ x.T.astype(object)
    return np.clip(full, -(2**63), 2**63 - 1).astype(np.int64)


def exact_pairs(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The same for row after row of both."""
    top = float(np.abs(x.astype(np.float64)).max(initial=0)) * float(np.abs(q.astype(np.float64)).max(initial=0)) * x.shape[1]
    if top < 2**62:
        return np.einsum("ij,ij->i", q, x)
    return np.array([min(max(sum(a * b for a, b in zip(u, v)), -(2**63)), 2**63 - 1) for u, v in zip(q.tolist(), x.tolist())], np.int64).reshape(-1)


def box(x: np.ndarray) -> np.ndarray:
    """A block's bounds: for each segment the least and greatest mean and the greatest deviation (with their roots, see statistics), and the greatest length."""
    s = statistics(x, BOX)
    h = s.shape[1] // 2
    return np.concatenate([s[:, :h].min(0), s[:, :h].max(0), s[:, h:].max(0), [lengths(x).max()]])


def box_bounds(q: np.ndarray, boxes: np.ndarray) -> np.ndarray:
    """(queries, boxes): what each query can score at most in a block."""
    s = statistics(q, BOX)
    h = s.shape[1] // 2
    m, d = s[:, :h], s[:, h:]
    lo, hi, dev, far = boxes[:, :h], boxes[:, h : 2 * h], boxes[:, 2 * h : 3 * h], boxes[:, -1]
    up, down = np.maximum(m, 0), np.minimum(m, 0)
    return up @ hi.T + down @ lo.T + d @ dev.T + 1e-9 * lengths(q)[:, None] * far[None] + 1


def block_top(q_cls: np.ndarray, q: np.ndarray, cls: np.ndarray, x: np.ndarray, floor: np.ndarray, k: int) -> tuple[pd.DataFrame, list[int]]:
    """The k best of x for each query among those that may reach its floor; and how many pairs were left after each resolution (the last: those computed exactly)."""
    slack = 1e-9 * lengths(q)[:, None] * lengths(x)[None] + 1
    least = floor.astype(np.float64)
    alive, line, col, left = None, None, None, []
    for s in RESOLUTIONS:
        sq, sx = statistics(q, s), statistics(x, s)
        if line is None:
            ok = sq @ sx.T + slack >= least[:, None]
            alive = ok if alive is None else alive & ok
            if alive.mean() < DENSE:
                line, col = np.nonzero(alive)
        else:
            ok = np.einsum("ij,ij->i", sq[line], sx[col]) + slack[line, col] >= least[line]
            line, col = line[ok], col[ok]
        left.append(int(alive.sum()) if line is None else len(line))
        if not left[-1]:
            break
    if line is None:
        score = exact(x, q)
        line, col = np.nonzero(alive & (score >= floor[:, None]))
        score = score[line, col]
    else:
        score = exact_pairs(x[col], q[line])
        reach = score >= floor[line]
        line, col, score = line[reach], col[reach], score[reach]
    return V.best_rows(q_cls[line], cls[col], score, k), left


def search(rows: DataFrame, k: int = 10, every: int = 100, scale: int = 1024, key: str = "vec_id", vec: str = "embedding", block: int = V.BLOCK) -> DataFrame:
    """For each row whose key is divisible by `every`, the k rows of highest integer inner product: query_id, rank, vec_id, score.

    Components become floor(scale * x), at most the greatest long. Vectors that are null, empty or hold a null or non-finite component
    take no part, nor do rows with a null key; zero vectors do. Vectors of another length are no candidates for each
    other; each length is searched by itself. Ties go to smaller ids. Repeated rows count once. An empty table gives none. Other columns are not looked at.
    A score beyond 64 bits is cut to the range of long.
    """
    whole = F.transform("vec", lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long"))
    rows = rows.select(F.col(key).cast("long").alias("id"), F.col(vec).alias("vec")).filter(F.col("id").isNotNull() & V.usable("vec", True)).select("id", whole.alias("vec"))
    return V.by_length(rows, lambda own: _search(own, k, every, block))


def _search(rows: DataFrame, k: int, every: int, block: int) -> DataFrame:
    classes = stored(V.ids_by_class(rows, k + 1), "vector-classes")
    queries = V.query_rows(rows, classes, every)
    asked = classes.join(queries.select(F.col("qcls").alias("cls")).distinct(), "cls", "left_semi").select("cls", "vec")
    count = classes.count()
    width = (rows.select(F.size("vec")).first() or [0])[0]

    def packed(df: DataFrame, n: int, what: str) -> DataFrame:
        """Blocks of neighbours in the order of coarse means, with their boxes."""
        means = F.array().cast("array<double>") if not width else F.array(*[F.aggregate(F.slice("vec", int(a) + 1, int(b - a)), F.lit(0.0), lambda s, x: s + x) / float(b - a) for a, b in zip(_cuts(width, 4)[:-1], _cuts(width, 4)[1:])])
        return stored(V.sorted_blocks(df.withColumn("means", means), n, "<i8", box), what)

    q_blocks = packed(asked, V.n_blocks_for(max(1, count // every), 512), "queries")
    index = packed(classes.select("cls", "vec"), V.n_blocks_for(count, block), "blocks")

    def bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each block of queries and each box: the greatest of its queries' bounds."""
        for b in batches:
            got = []
            for qb, q_cls, data, blocks_, boxes in zip(*(c.to_pylist() for c in b.columns)):
                _, q = V.unpack(q_cls, data, "<i8")
                got += [(qb, x, float(v)) for x, v in zip(blocks_, box_bounds(q, np.stack([np.frombuffer(y, "<f8") for y in boxes])).max(0))]
            yield pa.RecordBatch.from_arrays([pa.array([g[i] for g in got], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.float64()))], names=["q_block", "block", "bound"])

    # Boxes are gathered in lists of a few hundred, each of which meets each block of queries.
    shelf = F.floor(F.col("block") / 256).cast("int")
    boxes = index.groupBy(shelf.alias("shelf")).agg(F.collect_list("block").alias("blocks"), F.collect_list("box").alias("boxes"))
    shelves = [r[0] for r in index.select(shelf).distinct().collect()]  # one number for 256 blocks
    beside = q_blocks.select(F.col("block").alias("q_block"), "cls_ids", "data", F.explode(F.array(*[F.lit(s) for s in shelves]) if shelves else F.array().cast("array<int>")).alias("shelf")).join(boxes, "shelf")
    pairs = stored(beside.select("q_block", "cls_ids", "data", "blocks", "boxes").mapInArrow(bounds, "q_block int, block int, bound double"), "bounds")
    first = pairs.withColumn("r", F.row_number().over(Window.partitionBy("q_block").orderBy(F.desc("bound"), "block"))).filter(F.col("r") <= PROBES).drop("r")

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of a block of queries come one after another, best bound first. Its queries' best so far are kept, and raise their floors."""
        now, best = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                r = batch.slice(i, 1).to_pylist()[0]
                if r["q_block"] != now:
                    if best is not None:
                        yield _answers(best)
                    now, best = r["q_block"], None
                    q_cls, q = V.unpack(r["q_cls"], r["q_data"], "<i8")
                    floor = np.full(len(q), -(2**63), np.int64) if r["floors"] is None else np.frombuffer(r["floors"], "<i8").copy()
                at = np.flatnonzero(box_bounds(q, np.frombuffer(r["box"], "<f8")[None])[:, 0] >= floor)
                if len(at):
                    cls, x = V.unpack(r["cls_ids"], r["data"], "<i8")
                    got, _ = block_top(q_cls[at], q[at], cls, x, floor[at], k + 1)
                    best = got if best is None else V.best_rows(*(np.concatenate([best[c], got[c]]) for c in ("qcls", "cls", "score")), k + 1)
                    kth = best.groupby("qcls").score.agg(["size", "min"])
                    kth = kth[kth["size"] == k + 1]["min"]
                    place = np.searchsorted(q_cls, kth.index.to_numpy())
                    floor[place] = np.maximum(floor[place], kth.to_numpy())
        if best is not None:
            yield _answers(best)

    schema = "qcls long, cls long, score long"
    q = q_blocks.select(F.col("block").alias("q_block"), F.col("cls_ids").alias("q_cls"), F.col("data").alias("q_data"))

    def asked_of(some: DataFrame, lanes: int, floors: DataFrame | None) -> DataFrame:
        with_q = some.join(q if floors is None else q.join(floors, "q_block"), "q_block").join(index, "block")
        if floors is None:
            with_q = with_q.withColumn("floors", F.lit(None).cast("binary"))
        lane = F.pmod(F.col("block"), F.lit(lanes))
        return with_q.repartition("q_block", lane).sortWithinPartitions("q_block", lane, F.desc("bound"), "block").mapInArrow(ask, schema)

    probed = stored(asked_of(first, 1, None), "first")
    # A query's floor: its (k + 1)-th best score in the probes, if there are so many.
    kth = probed.withColumn("r", F.row_number().over(Window.partitionBy("qcls").orderBy(F.desc("score"), "cls"))).filter(F.col("r") == k + 1).select("qcls", F.col("score").alias("floor"))
    owner = V.owners(q_blocks)

    def line_up(mine):
        mine = mine.sort_values("qcls")
        floors = mine.floor.to_numpy().astype("<i8")
        return pd.DataFrame({"q_block": [int(mine.block.iloc[0])], "floors": [floors.tobytes()], "least": [int(floors.min())]})

    floors = stored(owner.join(kth, "qcls", "left").fillna(-(2**63), "floor").groupBy("block").applyInPandas(line_up, "q_block int, floors binary, least long"), "floors")
    rest = pairs.join(first.select("q_block", "block"), ["q_block", "block"], "left_anti").join(floors.select("q_block", "least"), "q_block").filter(F.col("bound") >= F.col("least").cast("double")).drop("least")
    more = asked_of(rest, LANES, floors.select("q_block", "floors"))
    return V.expand(probed.unionByName(more), queries, classes, k)


def _answers(best: pd.DataFrame) -> pa.RecordBatch:
    return pa.RecordBatch.from_pandas(best, schema=pa.schema([("qcls", pa.int64()), ("cls", pa.int64()), ("score", pa.int64())]), preserve_index=False)
