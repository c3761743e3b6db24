"""Approximate nearest neighbours by inner product: a hierarchical navigable small-world graph for each shard.

Vectors are dealt to shards by a hash. In a shard one more component gives all vectors the same length,
so that the order by inner product is the order by angle. Each vector has a level (geometric, from a
hash of its class). On each level the graph is a flat array of neighbours (int32, -1 where there are
fewer). A level is built from the one above: each of its vectors looks for its nearest vectors there (its hubs) by
the same beam search that queries use, and vectors with a hub in common are candidates for each other. From the nearest
candidates those are linked that are nearer to a vector than to any link chosen before, and links are made mutual as far as
there is room. Levels of up to SMALL vectors are compared whole. So building costs about the same for each vector, whatever the
shard's size, and a shard is as large as a task's memory allows. A query goes down the levels by beam search, many queries at a
time. Shard results are merged, and scores are computed anew in double precision on the original vectors. Each row is indexed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vectors as V
from .shared import stored
from .textops import mix

SHARD = 65_536
LINKS, NEAR, BEAM = 24, 48, 256
SMALL, HUBS = 4096, 10
AT_ONCE = 16  # blocks of queries for which a shard is sent and read once
CUT = 4096  # vectors of a shard in one row
INDEX = pa.schema([("block", pa.int32()), ("cut", pa.int32()), ("cls_ids", pa.binary()), ("data", pa.binary()), ("near", pa.binary()), ("upper", pa.binary())])
NONE_FOUND = pa.schema([("qcls", pa.int64()), ("cls", pa.int64()), ("score", pa.float64())]).empty_table()


class Graph:
    """Flat neighbour arrays of one shard. levels[l] = (members, neighbours as places in the shard)."""

    def __init__(self, cls: np.ndarray, x: np.ndarray, links: int = LINKS):
        self.x = _equal_length(x)
        u = (mix(cls.astype(np.uint64)) >> np.uint64(11)).astype(np.float64) / 2**53
        level = np.floor(-np.log(1 - u) / np.log(links)).astype(int) if len(cls) else np.zeros(0, int)
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        for l in range(level.max(initial=0), -1, -1):
            members = np.flatnonzero(level >= l).astype(np.int32)
            m = 2 * links if l == 0 else links
            if len(members) <= SMALL:
                near = _nearest_of_all(self.x, members, m)
            else:
                near = _nearest_by_hubs(self.x, members, self._hubs(members), m)
            self.levels.insert(0, (members, _link(self.x, members, near, m)))

    def _hubs(self, members: np.ndarray) -> np.ndarray:
        """(members, HUBS): each one's nearest on the lowest level built so far, itself too if it is there."""
        top, _ = self.levels[0]
        if len(top) <= SMALL:  # one product
            out = np.empty((len(members), min(HUBS, len(top))), np.int32)
            for a in range(0, len(members), 512):
                sim = self.x[members[a : a + 512]] @ self.x[top].T
                out[a : a + 512] = top[np.argpartition(-sim, out.shape[1] - 1, 1)[:, : out.shape[1]]]
            return out
        return np.concatenate([self.descend(self.x[members[a : a + 256]], 0, 4 * HUBS)[:, :HUBS] for a in range(0, len(members), 256)])

    def descend(self, q: np.ndarray, last: int, width: int) -> np.ndarray:
        """(queries, width) places, best first, by beam search from the top level down to the one numbered last."""
        at = np.broadcast_to(self.levels[-1][0][:1], (len(q), 1)).copy()
        for l in range(len(self.levels) - 1, last - 1, -1):
            at = _beam(self.x, self.levels[l][1], q, at[:, : 8 if l == last else 16], width if l == last else 16)
        return at

    def upper(self) -> bytes:
        """The levels above the lowest, whose members are all; of neighbours only the members' rows."""
        import pickle

        return pickle.dumps([(m.astype("<i4"), n[m].astype("<i4")) for m, n in self.levels[1:]], 5)

    @staticmethod
    def whole(x: np.ndarray, near: np.ndarray, upper: bytes) -> Graph:
        """The graph with the vectors x of equal length, the lowest level's neighbours `near`, and upper()'s."""
        import pickle

        g = Graph.__new__(Graph)
        g.x, g.levels = x, [(np.arange(len(x), dtype=np.int32), near)]
        for members, own in pickle.loads(upper):
            n = np.full((len(x), own.shape[1]), -1, np.int32)
            n[members] = own
            g.levels.append((members, n))
        return g

    def search(self, q: np.ndarray, k: int, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
        """(places, found) of shape (queries, beam): the best found, -1 where there are fewer."""
        q = np.concatenate([q.astype(np.float32), np.zeros((len(q), 1), np.float32)], 1)
        return self.descend(q, 0, max(beam, k))


def _equal_length(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float32)
    sq = np.einsum("ij,ij->i", x, x, dtype=np.float64)
    return np.concatenate([x, np.sqrt(np.maximum(0, sq.max(initial=0) - sq))[:, None].astype(np.float32)], 1)


def _choose(x: np.ndarray, own: np.ndarray, cand: np.ndarray, m: int) -> np.ndarray:
    """Of each row's candidates (nearest first, -1 none): up to m that are nearer to the row's own vector than to a chosen one; then the nearest of the rest."""
    b, c = cand.shape
    v = x[np.maximum(cand, 0)]
    sim = np.einsum("bd,bcd->bc", x[own], v)
    mutual = v @ v.transpose(0, 2, 1)
    closest = np.full((b, c), -np.inf, np.float32)
    taken, count = np.zeros((b, c), bool), np.zeros(b, int)
    for j in range(c):
        ok = (cand[:, j] >= 0) & (count < m) & (sim[:, j] > closest[:, j])
        taken[:, j] = ok
        count += ok
        closest = np.where(ok[:, None], np.maximum(closest, mutual[:, j]), closest)
    order = np.argsort(np.where(cand < 0, 2, np.where(taken, 0, 1)), 1, kind="stable")[:, :m]
    return np.take_along_axis(cand, order, 1)


def _nearest_of_all(x: np.ndarray, members: np.ndarray, m: int, block: int = 256) -> np.ndarray:
    """(members, c): each one's nearest others, nearest first."""
    near = min(max(NEAR, m), len(members) - 1)
    out = np.full((len(members), max(0, near)), -1, np.int32)
    for a in range(0, len(members) if near > 0 else 0, block):
        own = members[a : a + block]
        sim = x[own] @ x[members].T
        sim[np.arange(len(own)), np.arange(a, a + len(own))] = -np.inf
        top = np.argpartition(-sim, near - 1, 1)[:, :near]
        out[a : a + block] = members[np.take_along_axis(top, np.argsort(-np.take_along_axis(sim, top, 1), 1, kind="stable"), 1)]
    return out


def _nearest_by_hubs(x: np.ndarray, members: np.ndarray, hubs: np.ndarray, m: int) -> np.ndarray:
    """(members, c): each one's nearest among those that have a hub in common with it. A hub's list is compared whole, in blocks; of each comparison the nearest few are kept."""
    near = max(NEAR, m)
    few = max(8, near // 2)
    owner = np.repeat(np.arange(len(members), dtype=np.int64), hubs.shape[1])
    hub = hubs.reshape(-1)
    owner, hub = owner[hub >= 0], hub[hub >= 0]
    order = np.argsort(hub, kind="stable")
    owner, hub = owner[order], hub[order]
    first = np.flatnonzero(np.concatenate([[True], hub[1:] != hub[:-1]]))
    slot = np.zeros(len(members), np.int64)
    cand = np.full((len(members), hubs.shape[1], few), -1, np.int32)
    sims = np.full(cand.shape, -np.inf, np.float32)
    for a, b in zip(first.tolist(), np.append(first[1:], len(hub)).tolist()):
        lot = owner[a:b]
        v = x[members[lot]]
        for c in range(0, len(lot), 1024):
            own = lot[c : c + 1024]
            sim = v[c : c + 1024] @ v.T
            sim[np.arange(len(own)), np.arange(c, c + len(own))] = -np.inf
            t = min(few, len(lot) - 1)
            if t <= 0:
                continue
            top = np.argpartition(-sim, t - 1, 1)[:, :t]
            cand[own, slot[own], :t] = members[lot[top]]
            sims[own, slot[own], :t] = np.take_along_axis(sim, top, 1)
        slot[lot] += 1
    cand, sims = cand.reshape(len(members), -1), sims.reshape(len(members), -1)
    out = np.full((len(members), near), -1, np.int32)
    for a in range(0, len(members), 4096):
        c, s = cand[a : a + 4096], sims[a : a + 4096]
        # Each candidate once: sorted by place, repeats are pushed to the end.
        order = np.argsort(c, 1, kind="stable")
        c, s = np.take_along_axis(c, order, 1), np.take_along_axis(s, order, 1)
        s[:, 1:][c[:, 1:] == c[:, :-1]] = -np.inf
        top = np.argsort(-s, 1, kind="stable")[:, :near]
        got = np.take_along_axis(c, top, 1)
        got[np.take_along_axis(s, top, 1) == -np.inf] = -1
        out[a : a + 4096, : got.shape[1]] = got
    return out


def _link(x: np.ndarray, members: np.ndarray, near: np.ndarray, m: int, block: int = 256) -> np.ndarray:
    """(len(x), m) neighbours of the members on a level, out of the nearest of each; rows of others are -1."""
    out = np.full((len(x), m), -1, np.int32)
    if not near.shape[1]:
        return out
    for a in range(0, len(members), block):
        own = members[a : a + block]
        got = _choose(x, own, near[a : a + block], m // 2)
        out[own, : got.shape[1]] = got
    # Mutual links: each link also from its other end, nearest first, as far as there is room.
    frm, to = np.repeat(np.arange(len(x), dtype=np.int32), m), out.reshape(-1)
    frm, to = frm[to >= 0], to[to >= 0]
    parts = [slice(a, a + 16384) for a in range(0, len(to), 16384)]
    new = np.concatenate([np.zeros(0, bool), *(~(out[to[p]] == frm[p, None]).any(1) for p in parts)])
    frm, to = frm[new], to[new]
    order = np.lexsort((-np.concatenate([np.zeros(0, x.dtype), *(np.einsum("ij,ij->i", x[frm[p]], x[to[p]]) for p in parts)]), to))
    frm, to = frm[order], to[order]
    first = np.searchsorted(to, to)
    slot = (out >= 0).sum(1)[to] + np.arange(len(to)) - first
    fits = slot < m
    out[to[fits], slot[fits]] = frm[fits]
    return out


def _beam(x: np.ndarray, near: np.ndarray, q: np.ndarray, entry: np.ndarray, width: int, fan: int = 4) -> np.ndarray:
    """Beam search for many queries at once, from places entry (-1 none); (queries, width) places, best first."""
    b, n = len(q), len(x)
    seen = np.zeros((b, n), bool)
    ids = np.full((b, width), -1, np.int32)
    sim = np.full((b, width), -np.inf, np.float32)
    open_ = np.zeros((b, width), bool)

    def put(rows: np.ndarray, cand: np.ndarray) -> None:
        """rows: which queries; cand: (rows, c) places, -1 none."""
        r = np.repeat(rows, cand.shape[1])
        c = cand.reshape(-1)
        r, c = r[c >= 0], c[c >= 0]
        key = np.unique(r.astype(np.int64) * n + c)
        r, c = key // n, (key % n).astype(np.int32)
        fresh = ~seen[r, c]
        r, c = r[fresh], c[fresh]
        seen[r, c] = True
        if not len(r):
            return
        s = np.einsum("ij,ij->i", x[c], q[r])
        hit, first, count = np.unique(r, return_index=True, return_counts=True)
        slot = np.arange(len(r)) - np.repeat(first, count)
        more = np.full((len(hit), count.max()), -1, np.int32)
        more_s = np.full(more.shape, -np.inf, np.float32)
        line = np.repeat(np.arange(len(hit)), count)
        more[line, slot], more_s[line, slot] = c, s
        all_i = np.concatenate([ids[hit], more], 1)
        all_s = np.concatenate([sim[hit], more_s], 1)
        all_o = np.concatenate([open_[hit], more >= 0], 1)
        order = np.argsort(-all_s, 1, kind="stable")[:, :width]
        ids[hit], sim[hit], open_[hit] = (np.take_along_axis(v, order, 1) for v in (all_i, all_s, all_o))

    put(np.arange(b), entry)
    while True:
        rows = np.flatnonzero(open_.any(1))
        if not len(rows):
            return ids
        o = open_[rows]
        pick = np.argsort(~o, 1, kind="stable")[:, :fan]
        chosen = np.take_along_axis(o, pick, 1)
        place = np.where(chosen, np.take_along_axis(ids[rows], pick, 1), -1)
        np.put_along_axis(o, pick, False, 1)
        open_[rows] = o
        cand = np.where(place[:, :, None] >= 0, near[np.maximum(place, 0)], -1)
        put(rows, cand.reshape(len(rows), -1))


def search(rows: DataFrame, k: int = 20, every: int = 20, key: str = "vec_id", vec: str = "embedding", shard: int = SHARD, beam: int = BEAM) -> DataFrame:
    """For each row whose key is divisible by `every`, the k rows of largest inner product found: query_id, rank, vec_id, score.

    Vectors that are null, empty, zero or hold a null or non-finite component take no part, nor do rows
    with a null key. Vectors of another length are no candidates for each other; each length is searched by itself. Ties go to
    smaller ids; equal vectors have equal scores. Repeated rows count once. An empty table gives none. Other columns are not looked at.
    """
    rows = rows.select(F.col(key).cast("long").alias("id"), F.col(vec).alias("vec")).filter(F.col("id").isNotNull() & V.usable("vec", False))
    return V.by_length(rows, lambda own: _search(own, k, every, shard, beam))


def _search(rows: DataFrame, k: int, every: int, shard: int, beam: int) -> DataFrame:
    classes = stored(V.ids_by_class(rows, k + 1), "vector-classes")
    n = V.n_blocks_for(classes.count(), shard)
    queries = V.query_rows(rows, classes, every)
    asked = classes.join(queries.select(F.col("qcls").alias("cls")).distinct(), "cls", "left_semi").select("cls", "vec")
    n_q = V.n_blocks_for(max(1, classes.count() // every), 1024)
    q_blocks = V.blocks(asked, n_q, "<f4")

    def build(pieces: pa.Table) -> pa.Table:
        block, ids, data = pieces["block"][0].as_py(), b"".join(pieces["cls_ids"].to_pylist()), b"".join(pieces["data"].to_pylist())
        del pieces
        cls, x = V.unpack(ids, data, "<f4")
        del ids, data
        g = Graph(cls, x)
        near, cuts = g.levels[0][1].astype("<i4"), range(0, len(cls), CUT)
        columns = [[block] * len(cuts), list(cuts), *([v[c : c + CUT].tobytes() for c in cuts] for v in (cls, g.x, near)), [b"" if c else g.upper() for c in cuts]]
        return pa.table([pa.array(c, f.type) for c, f in zip(columns, INDEX)], schema=INDEX)

    # Made once and sent to where it is asked: each shard's rows go out of the task that builds it.
    index = V.pieces(classes.select("cls", "vec"), n, "<f4").groupBy("block").applyInArrow(build, "block int, cut int, cls_ids binary, data binary, near binary, upper binary")

    def ask(asked: pa.Table, shard: pa.Table) -> pa.Table:
        out = [NONE_FOUND]
        if len(asked) and len(shard):
            cuts = np.argsort(shard["cut"].to_numpy())

            def column(name: str, kind: str) -> np.ndarray:
                """The column's parts as one array; the table itself is not copied."""
                parts = [np.frombuffer(shard[name][c].as_buffer(), kind) for c in cuts.tolist()]
                return np.concatenate(parts)

            cls = column("cls_ids", "<i8")
            g = Graph.whole(column("data", "<f4").reshape(len(cls), -1), column("near", "<i4").reshape(len(cls), -1), column("upper", "u1"))
            x = g.x[:, :-1]
            for q_ids, q_data in zip(asked["q_cls"], asked["q_data"]):
                q_cls, q = V.unpack(q_ids.as_buffer(), q_data.as_buffer(), "<f4")
                for a in range(0, len(q), 256):
                    at = g.search(q[a : a + 256], k + 1, beam)
                    line, slot = np.nonzero(at >= 0)
                    place = at[line, slot]
                    s = (x[place].astype(np.float64) * q[a + line].astype(np.float64)).sum(1)
                    out.append(pa.Table.from_pandas(V.best_rows(q_cls[a + line], cls[place], s, k + 1), NONE_FOUND.schema, preserve_index=False))
        return pa.concat_tables(out).combine_chunks()

    found = V.meet(q_blocks, index, n_q, n, AT_ONCE, ask, "qcls long, cls long, score double")
    return V.expand(found, queries, classes, k)
