"""Which tensor to store as a base and which as a delta: E1-E16. Sequential rules run once for each group of equal key, in a grouped function; the rest are joins."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.exprs import COEFFS, item_bytes, numel, predict_ratio

PLAN_SCHEMA = "group_key string, tensor_id long, role string, base_id long, distance double, predicted_ratio double"


def ratios(p: np.ndarray, coeffs=COEFFS) -> np.ndarray:
    """The predictor in numpy."""
    q = np.clip(p, 0, 0.5)
    with np.errstate(divide="ignore", invalid="ignore"):
        t = np.where(q > 1e-15, -8 * (q * np.log2(q) + (1 - q) * np.log2(1 - q)), 0.0)
    a, b, c, d = coeffs
    return np.clip(a * q + b * t + c * q * t + d, 0, 1)


def distance(a: str, b: str, n_bits: Column, d: int = 2) -> Column:
    """E1 on two sketch columns"""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y).cast("long") * (x - y).cast("long")), F.lit(0).cast("long"), lambda s, x: s + x) / F.lit(d) / F.greatest(n_bits, F.lit(1))


def attach_group(sketches: list, n_bits: np.ndarray, threshold: float = 0.70, coeffs=COEFFS, d: int = 2) -> list[tuple]:
    """E4 in order of arrival: (role, place of base, distance, ratio); the bases' sketches are held as one matrix that grows. A sketch of another width than the group's first is an error: sketches of one catalog have one width."""
    out, places, count = [], np.zeros(0, np.int64), 0
    width = next((len(s) for s in sketches if s is not None), 0)
    matrix = np.zeros((16, width), np.int64)
    for i, s in enumerate(sketches):
        if s is None:
            out.append(("skipped", None, None, None))
            continue
        if len(s) != width:
            raise ValueError(f"sketches of {width} and {len(s)} numbers in one group")
        if count:
            x = matrix[:count] - s
            dist = np.einsum("ij,ij->i", x, x) / d / max(int(n_bits[i]), 1)
            j = int(dist.argmin())  # the earliest of equals
            r = float(ratios(dist[j : j + 1], coeffs)[0])
            if r <= threshold:
                out.append(("delta", int(places[j]), float(dist[j]), r))
                continue
        if count == len(matrix):
            matrix = np.concatenate([matrix, np.zeros_like(matrix)])
        matrix[count], places, count = s, np.append(places, i), count + 1
        out.append(("base", None, None, None))
    return out


def _numbered(tensors: DataFrame) -> DataFrame:
    """(group_key, ord, tensor_id, sketch, n_bits), with a struct in ord replaced by the place in its order inside the group: pandas has no order of structs."""
    if isinstance(tensors.schema["ord"].dataType, StructType):
        tensors = tensors.withColumn("ord", F.row_number().over(Window.partitionBy("group_key").orderBy("ord", "tensor_id")))
    return tensors.select("group_key", "ord", "tensor_id", "sketch", "n_bits")


def attach(tensors: DataFrame, threshold: float = 0.70, coeffs=COEFFS, d: int = 2) -> DataFrame:
    """tensors (group_key, ord, tensor_id, sketch, n_bits) -> plan rows; ord is a number or a struct, as candidates() gives it. A tensor without a sketch is stored raw and attracts none."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["ord", "tensor_id"])
        ids = rows.tensor_id.to_numpy()
        plan = attach_group([None if s is None else np.asarray(s, np.int64) for s in rows.sketch], rows.n_bits.to_numpy(), threshold, coeffs, d)
        return pd.DataFrame([(k, int(t), role, None if b is None else int(ids[b]), dist, r) for k, t, (role, b, dist, r) in zip(rows.group_key, ids, plan)], columns=[c.split()[0] for c in PLAN_SCHEMA.split(", ")])

    run.__annotations__ = {}
    return _numbered(tensors).groupBy("group_key").applyInPandas(run, PLAN_SCHEMA)


def matrix(sketches: np.ndarray, n_bits: int, coeffs=COEFFS, d: int = 2) -> np.ndarray:
    """Predicted ratio of i against base j; zeros on the diagonal. Made by blocks of rows, so that no more than the result is as large as the result."""
    f = sketches.astype(np.int64)
    sq = np.einsum("ij,ij->i", f, f)
    if sq.max(initial=0) < 1 << 51:  # exact in doubles, whose product is many times as fast
        f, sq = f.astype(float), sq.astype(float)
    out = np.empty((len(f), len(f)))
    for i in range(0, len(f), 256):
        out[i : i + 256] = ratios((sq[i : i + 256, None] + sq[None] - 2 * (f[i : i + 256] @ f.T)) / (d * max(n_bits, 1)), coeffs)
    np.fill_diagonal(out, 0)
    return out


def open_bases(r: np.ndarray, min_ratio: float = 0.0) -> list[int]:
    """Bases opened by splitting off, again and again, the member that saves most. An explicit stack; all candidates' gains in numpy, by blocks."""
    bases, todo = [0], [(np.arange(1, len(r)), 0)]
    while todo:
        members, base = todo.pop(0)
        if not len(members):
            continue
        now = r[members, base]
        gain = np.empty(len(members))
        for i in range(0, len(members), 256):
            saved = np.maximum(now[:, None] - r[np.ix_(members, members[i : i + 256])], 0)
            saved[np.arange(i, i + saved.shape[1]), np.arange(saved.shape[1])] = 0
            gain[i : i + 256] = saved.sum(0)
        gain -= 1 - now
        j = int(gain.argmax())
        if gain[j] <= 0 or gain[j] / max(1 + now.sum(), 1e-9) < min_ratio:
            continue
        cand = int(members[j])
        bases.append(cand)
        others = np.delete(members, j)
        moves = r[others, cand] < r[others, base]
        todo += [(side, b) for side, b in ((others[~moves], base), (others[moves], cand)) if len(side) >= 2]
    return sorted(set(bases))


def nearest_of(r: np.ndarray, bases: list[int]) -> tuple[np.ndarray, np.ndarray]:
    cost = r[:, bases]
    return np.asarray(bases)[cost.argmin(1)], cost.min(1)


def flexsplit(tensors: DataFrame, min_ratio: float = 0.0, keep_raw_from: float | None = None, d: int = 2) -> DataFrame:
    """E6/E8 for each group in order; with keep_raw_from, a member of that ratio or above stays raw and counts as a base."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["ord", "tensor_id"])
        ids, out = rows.tensor_id.to_numpy(), []
        if len(rows) > 1:
            r = matrix(np.stack(rows.sketch.to_numpy()), int(rows.n_bits.iloc[0]), d=d)
            bases = open_bases(r, min_ratio)
            best, cost = nearest_of(r, bases)
        else:
            bases, best, cost = [0], np.zeros(1, int), np.zeros(1)
        for i in range(len(rows)):
            raw = i in set(bases) or keep_raw_from is not None and cost[i] >= keep_raw_from
            out.append((rows.group_key.iloc[0], int(ids[i]), "base" if raw else "delta", None if raw else int(ids[best[i]]), None, None if raw else float(cost[i])))
        return pd.DataFrame(out, columns=[c.split()[0] for c in PLAN_SCHEMA.split(", ")])

    run.__annotations__ = {}
    return _numbered(tensors.filter("sketch IS NOT NULL")).groupBy("group_key").applyInPandas(run, PLAN_SCHEMA)


def strategy_costs(r: np.ndarray, k: int = 4) -> dict[str, tuple[float, int]]:
    """Cost in tensors, and number of bases"""
    whole = np.eye(len(r), dtype=bool)

    def stored_against(bases) -> tuple[float, int]:
        """Each base as itself, each other at its least ratio."""
        return float(np.where(whole[:, bases].any(1), 1.0, r[:, bases].min(1)).sum()), len(bases)

    # k places from the first to the last tensor with gaps as equal as can be; fewer where the group is smaller.
    places = np.unique(np.rint(np.linspace(0, len(r) - 1, min(k, len(r)))).astype(int))
    sets = {"star-first": [0], "star-mid": [len(r) // 2], "k-center": places.tolist(), "split": open_bases(r)}
    return {"chain": (1.0 + float(np.diagonal(r, -1).sum()), 1)} | {name: stored_against(b) for name, b in sets.items()}


def strategies(tensors: DataFrame, k: int = 4) -> DataFrame:
    """E10 for each group: group_key, strategy, cost, n_bases."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["ord", "tensor_id"])
        r = matrix(np.stack(rows.sketch.to_numpy()), int(rows.n_bits.iloc[0]))
        return pd.DataFrame([(rows.group_key.iloc[0], s, round(c, 9), b) for s, (c, b) in strategy_costs(r, k).items()], columns=["group_key", "strategy", "cost", "n_bases"])

    run.__annotations__ = {}
    return _numbered(tensors.filter("sketch IS NOT NULL")).groupBy("group_key").applyInPandas(run, "group_key string, strategy string, cost double, n_bases int")


def _blocks(df: DataFrame, names: list[str], size: int) -> DataFrame:
    """(group_key, tensor_id, ord, sketch, n_bits) -> blocks of a group of bounded size: group_key, then as `names`, ids, ords, sketches and bits as binaries."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        s = np.stack(rows.sketch.to_numpy()).astype("<i4")
        return pd.DataFrame([(rows.group_key.iloc[0], *(rows[c].to_numpy().astype("<i8").tobytes() for c in ("tensor_id", "ord")), s.tobytes(), rows.n_bits.to_numpy().astype("<i8").tobytes())], columns=["group_key", *names])

    run.__annotations__ = {}
    # Dealt by hash to as many blocks as the largest group needs; a block has about `size` tensors at most.
    most = df.groupBy("group_key").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 1
    dealt = df.filter("sketch IS NOT NULL").select("group_key", "tensor_id", "ord", "sketch", "n_bits", F.pmod(F.xxhash64("tensor_id"), F.lit(-(-most // size))).alias("__block"))
    return dealt.groupBy("group_key", "__block").applyInPandas(run, "group_key string, " + ", ".join(f"{x} binary" for x in names))


def nearest_static(tensors: DataFrame, bases: DataFrame, d: int = 2, size: int = 1024) -> DataFrame:
    """C12 without a changing set of bases: each tensor's nearest base of its group, earliest of equals. Blocks of a group meet blocks of its bases, each pair one product; the best of each are then compared."""
    schema = "group_key string, tensor_id long, distance double, base_ord long, base_id long"

    def run(batches):
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                t, b, bo, n = (np.frombuffer(x, "<i8") for x in (r.t, r.b, r.bo, r.n))
                x, y = np.frombuffer(r.ts, "<i4").reshape(len(t), -1).astype(np.int64), np.frombuffer(r.bs, "<i4").reshape(len(b), -1).astype(np.int64)
                order = np.lexsort((b, bo))  # the earliest first, so that the first of equals is it
                b, bo, y = b[order], bo[order], y[order]
                f, g = (x.astype(float), y.astype(float)) if max(np.abs(x).max(initial=0), np.abs(y).max(initial=0)) < 1 << 20 else (x, y)  # whole numbers either way
                sq = np.einsum("ij,ij->i", f, f)[:, None] + np.einsum("ij,ij->i", g, g)[None] - 2 * (f @ g.T)
                dist = sq / d / np.maximum(n, 1)[:, None]
                dist[t[:, None] == b[None]] = np.inf
                j = dist.argmin(1)
                ok = np.isfinite(dist[np.arange(len(t)), j])
                yield pd.DataFrame({"group_key": r.group_key, "tensor_id": t[ok], "distance": dist[np.arange(len(t)), j][ok], "base_ord": bo[j][ok], "base_id": b[j][ok]})

    met = _blocks(tensors, ["t", "to", "ts", "n"], size).drop("to").join(_blocks(bases, ["b", "bo", "bs", "bn"], size).drop("bn"), "group_key")
    best = met.mapInPandas(run, schema).groupBy("group_key", "tensor_id").agg(F.min(F.struct("distance", "base_ord", "base_id")).alias("b"))
    return best.select("group_key", "tensor_id", F.col("b.base_id").alias("base_id"), F.col("b.distance").alias("distance"), predict_ratio(F.col("b.distance")).alias("predicted_ratio"))


def bundle(named: DataFrame) -> DataFrame:
    """Named (model, param, tensor_id, id, sketch, shape, dtype) -> rows for attach and flexsplit: a group for each parameter and shape, each content once, at its first place in the order of models; scalars are left out. n_bits is elements times bits of one."""
    first = named.filter(F.size("shape") > 0).withColumn("group_key", F.concat_ws("\x00", F.col("param").cast("string"), F.to_json("shape")))
    one = first.groupBy("group_key", "id").agg(F.min(F.struct("model", "tensor_id", "sketch", "shape", "dtype")).alias("f")).select("group_key", "f.*")
    w = Window.partitionBy("group_key").orderBy("model", "tensor_id")
    return one.select("group_key", F.row_number().over(w).cast("long").alias("ord"), "tensor_id", "sketch", (numel(F.col("shape")) * item_bytes(F.col("dtype")) * 8).cast("long").alias("n_bits"))


# -- around the greedy rule ---------------------------------------------------------------------------


def candidates(mappings: DataFrame, tensors: DataFrame, model: str, with_existing: bool = False) -> DataFrame:
    """(ord, tensor_id, own) in the order in which the greedy rule sees them: with_existing, first the other tensors by created_at and id; then the model's own by parameter. Each tensor once, at its first place; tensors without a shape (scalars) are left out.

    mappings (model, param, tensor_id), tensors (tensor_id, shape, created_at, ...). ord is a row's place among its kind, own ones after all others.
    """
    own = mappings.filter(F.col("model") == model).groupBy("tensor_id").agg(F.min("param").alias("param")).withColumn("own", F.lit(True))
    fine = tensors.filter(F.size("shape") > 0)
    both = fine.join(own, "tensor_id", "left").withColumn("own", F.coalesce("own", F.lit(False)))
    if not with_existing:
        both = both.filter("own")
    key = F.struct("own", F.when(~F.col("own"), F.col("created_at")).alias("at"), F.coalesce("param", F.lit("")).alias("param"), "tensor_id")
    return both.withColumn("ord", key)


def only_model(plan: DataFrame, mappings: DataFrame, model: str) -> tuple[DataFrame, DataFrame]:
    """E5: (the pairs whose target is the model's, one row of counts). n_pairs follows the filter, n_bases and n_skipped don't."""
    mine = mappings.filter(F.col("model") == model).select("tensor_id").distinct()
    pairs = plan.filter("role = 'delta'").join(mine, "tensor_id", "left_semi")
    count = lambda role: F.count(F.when(F.col("role") == role, 1))
    whole = plan.agg(count("base").alias("n_bases"), count("skipped").alias("n_skipped"), F.count_distinct("group_key").alias("n_groups"))
    return pairs, pairs.agg(F.count(F.lit(1)).alias("n_pairs")).crossJoin(whole)  # one row with one row


def buckets(sketch: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """A key for each table of hyperplanes: the signs of the sketch's products with them."""
    bits = (planes @ sketch.astype(float)) > 0
    return bits @ (1 << np.arange(planes.shape[1]))


def attach_group_indexed(sketches: list, n_bits: np.ndarray, threshold: float = 0.70, tables: int = 8, bits: int = 6, seed: int = 5, d: int = 2) -> list[tuple]:
    """The greedy rule with an approximate index of the bases: only bases that share a bucket of one table are looked at; the nearest of them is taken. None at hand opens a base."""
    width = next((len(s) for s in sketches if s is not None), 0)
    planes = np.random.Generator(np.random.PCG64(seed)).standard_normal((tables, bits, width))
    index: list[dict[int, list[int]]] = [{} for _ in range(tables)]
    out: list[tuple] = []
    for i, s in enumerate(sketches):
        if s is None:
            out.append(("skipped", None, None, None))
            continue
        keys = buckets(s, planes).tolist()
        near = sorted({j for t, k in enumerate(keys) for j in index[t].get(k, ())})
        if near:
            x = np.stack([sketches[j] for j in near]) - s
            dist = np.einsum("ij,ij->i", x, x) / d / max(int(n_bits[i]), 1)
            j = int(dist.argmin())
            r = float(ratios(dist[j : j + 1])[0])
            if r <= threshold:
                out.append(("delta", near[j], float(dist[j]), r))
                continue
        for t, k in enumerate(keys):
            index[t].setdefault(k, []).append(i)
        out.append(("base", None, None, None))
    return out


def recall_at_1(tensors: DataFrame, threshold: float = 0.70, tables: int = 8, bits: int = 6) -> DataFrame:
    """group_key, tensors, same: for how many tensors the rule with the index picks the same base (itself, where it opens one) as with all bases. Recall@1 is same / tensors."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["ord", "tensor_id"])
        s, n = [None if x is None else np.asarray(x, np.int64) for x in rows.sketch], rows.n_bits.to_numpy()
        a, b = attach_group(s, n, threshold), attach_group_indexed(s, n, threshold, tables, bits)
        same = sum(x[:2] == y[:2] for x, y in zip(a, b))
        return pd.DataFrame({"group_key": [rows.group_key.iloc[0]], "tensors": [len(rows)], "same": [same]})

    run.__annotations__ = {}
    return _numbered(tensors).groupBy("group_key").applyInPandas(run, "group_key string, tensors long, same long")


def against(named: DataFrame, reference: str, d: int = 2) -> DataFrame:
    """(model, shared, mean_ratio): each model's mean predicted ratio against the reference model over the parameters that both have with a sketch. named (model, param, sketch, n_bits)"""
    a = named.filter("sketch IS NOT NULL")
    base = a.filter(F.col("model") == reference).select("param", F.col("sketch").alias("base_sketch"), F.col("n_bits").alias("base_bits"))
    met = a.filter(F.col("model") != reference).join(base, "param").withColumn("cr", predict_ratio(distance("sketch", "base_sketch", F.col("base_bits"), d)))
    return met.groupBy("model").agg(F.count(F.lit(1)).alias("shared"), F.avg("cr").alias("mean_ratio"))


def prune_near(named: DataFrame, reference: str, threshold: float) -> DataFrame:
    """The models that stay: the reference, and those whose mean predicted reduction against it is at most the threshold (others are near copies). A model that shares no parameter with it goes; at 1 and above, all stay."""
    if threshold >= 1:
        return named.select("model").distinct()
    few = against(named, reference).filter(1 - F.col("mean_ratio") <= threshold).select("model")
    return few.unionByName(named.filter(F.col("model") == reference).select("model").distinct())


def heatmap(named: DataFrame, reference: str, top: int, d: int = 2) -> DataFrame:
    """(param, model, saved, place): predicted reduction of the `top` models that differ most from the reference, at each parameter; place orders the models by their saving at the last parameter, most first."""
    far = against(named, reference, d).orderBy(F.desc("mean_ratio"), "model").limit(top).select("model")
    a = named.filter("sketch IS NOT NULL")
    base = a.filter(F.col("model") == reference).select("param", F.col("sketch").alias("base_sketch"), F.col("n_bits").alias("base_bits"))
    cells = a.join(far, "model").join(base, "param").select("param", "model", (1 - predict_ratio(distance("sketch", "base_sketch", F.col("base_bits"), d))).alias("saved"))
    last = cells.agg(F.max("param").alias("param"))
    # As many rows as models asked for.
    order = far.join(cells.join(last, "param").select("model", F.col("saved").alias("at_last")), "model", "left").withColumn("place", F.row_number().over(Window.orderBy(F.desc_nulls_last("at_last"), "model"))).select("model", "place")
    return cells.join(order, "model").select("param", "model", "saved", "place")
