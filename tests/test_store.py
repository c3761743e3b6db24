"""Stored blobs, the catalog's life and plans around the greedy rule, against plain loops."""

import json
import os

import numpy as np
import pytest
import xxhash

from loomstore.functions import kernels as K
from loomstore.operators import catalog, facility, planner, store
from loomstore.plans import QUERIES
from loomstore.sources import safetensors

D = "/root/testdata/sf0.001"


def name(b: bytes) -> str:
    return xxhash.xxh3_128_hexdigest(b)


def payload(seed: int, n: int = 64, kind="<f4") -> bytes:
    return np.random.default_rng(seed).standard_normal(n).astype(kind).tobytes()


def blobs(spark, rows):
    """rows: (id, dtype, shape, codec, base_id, item, level, data)"""
    return spark.createDataFrame([(i, k, list(s), c, b, n, lv, bytearray(x)) for i, k, s, c, b, n, lv, x in rows], store.BLOB)


def raw(b, kind="float32", shape=(64,), i=None):
    return (i or name(b), kind, shape, None, None, None, None, b)


def delta(b, base, kind="float32", shape=(64,), base_id=None, i=None, data=None, item=4):
    return (i or name(b), kind, shape, store.CODEC, base_id or name(base), item, 3, data or K.encode_delta(b, base, item))


def test_a_shared_base_is_decoded_once(spark):
    a, x, y, z = (payload(i) for i in range(4))
    got = store.reconstruct(blobs(spark, [raw(a), delta(x, a), delta(y, a), delta(z, x)]))
    rows = {r["id"]: r for r in got.collect()}
    assert len(rows) == 4 and all(r["status"] == "ok" for r in rows.values())
    assert [bytes(rows[name(b)]["payload"]) for b in (a, x, y, z)] == [a, x, y, z]
    assert [rows[name(b)]["depth"] for b in (a, x, y, z)] == [0, 1, 1, 2]


def test_what_cannot_be_rebuilt_is_said(spark):
    a, x, y, z, lost = (payload(i) for i in range(5))
    rows = [raw(a), delta(x, a, data=b"not a frame"), delta(y, z), delta(z, y), delta(lost, a, base_id="0" * 32), delta(payload(9), lost), raw(payload(7), i="f" * 32)]
    df = blobs(spark, rows)
    got = {r["id"]: (r["status"], r["payload"]) for r in store.reconstruct(df).collect()}
    assert got[name(a)][0] == "ok"
    assert got[name(x)] == ("corrupt", None) and got["f" * 32] == ("corrupt", None)
    assert got[name(y)] == got[name(z)] == ("cycle", None)
    assert got[name(lost)][0] == got[name(payload(9))][0] == "missing base"
    want = spark.createDataFrame([(name(a),), (name(a),), ("e" * 32,)], "id string")
    assert {r["id"]: r["status"] for r in store.reconstruct(df, want).collect()} == {name(a): "ok", "e" * 32: "missing"}
    for bad in (name(x), name(y), "e" * 32):
        with pytest.raises(store.IntegrityError):
            store.reconstruct(df, spark.createDataFrame([(bad,)], "id string"), strict=True)
    assert store.reconstruct(df.limit(0)).count() == 0


def test_a_base_of_another_kind_is_cast(spark):
    half, whole = payload(1, kind="<f2"), payload(2)
    df = blobs(spark, [raw(half, "float16"), raw(whole)])
    report, new = store.compress_pairs(spark.createDataFrame([(0, name(whole), name(half))], "ord long, target string, base string"), df)
    assert report.first()["status"] == "ok" and new.count() == 2
    assert {bytes(r["payload"]) for r in store.reconstruct(new).collect()} == {half, whole}


def judged(pairs, state):
    """Pairs in order, one by one. state: id -> [shape, codec, base]"""
    state, out = {k: list(v) for k, v in state.items()}, []
    for o, t, b in sorted(pairs):
        if t == b:
            out.append((o, "error"))
        elif t not in state or b not in state:
            out.append((o, "error"))
        elif state[t][1] is not None:
            out.append((o, "skipped"))
        else:
            at = b
            while at is not None and at != t:
                at = state[at][2]
            if at == t:
                out.append((o, "skipped"))
            elif state[t][0] != state[b][0]:
                out.append((o, "error"))
            else:
                state[t][1:] = ["x", b]
                out.append((o, "ok"))
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_pairs_are_judged_in_their_turn(spark, seed):
    rng = np.random.default_rng(seed)
    ids = [str(i) for i in range(14)]
    rows = [(i, "float32", [64 if int(i) % 7 else 32], None, None, None, None, bytearray(b"")) for i in ids]
    rows[3] = ("3", "float32", [32 if 3 % 7 == 0 else 64], store.CODEC, "5", 4, 3, bytearray(b""))
    pairs = [(k, str(a), str(b)) for k, (a, b) in enumerate(rng.integers(0, 16, (60, 2)))]
    got = store.judge_pairs(spark.createDataFrame(pairs, "ord long, target string, base string"), spark.createDataFrame(rows, store.BLOB))
    want = judged(pairs, {r[0]: [tuple(r[2]), r[3], r[4]] for r in rows})
    have = sorted((r["ord"], r["status"]) for r in got.collect())
    # Of a pair that has two faults (other shapes, and a cycle) either may be named.
    shape = {r[0]: tuple(r[2]) for r in rows}
    both = {k for k, t, b in pairs if t in shape and b in shape and shape[t] != shape[b]}
    assert [x for x in have if x[0] not in both] == [x for x in want if x[0] not in both]
    assert all(s != "ok" for k, s in have if k in both)


def test_guards_query(spark):
    n = spark.read.parquet(f"{D}/embeddings.parquet").count()
    pairs = [(v, str(v), str((v * 7 + (0 if v % 5 == 0 else 3)) % (n + 3))) for v in range(n)] + [(v + n, str(v), str(v // 2)) for v in range(0, n, 3)]
    want = judged(pairs, {str(v): [v % 13 == 0, None, None] for v in range(n)})
    got = sorted((r["ord"], r["status"]) for r in QUERIES["k13_guards"](spark, D).collect())
    twofold = {k for k, t, b in pairs if int(t) < n and int(b) < n and (int(t) % 13 == 0) != (int(b) % 13 == 0)}
    assert [x for x in got if x[0] not in twofold] == [x for x in want if x[0] not in twofold]


def test_chains_too_long_are_refused_in_few_jobs(spark):
    """Every pair from the fifth of each run on would have too long a chain: each is refused, with no round of jobs for it."""
    n = 60
    df = blobs(spark, [raw(b"", i=f"{i:03d}") for i in range(n + 1)])
    pairs = [(i, f"{i + 1:03d}", f"{i:03d}") for i in range(n)]
    sc = spark.sparkContext
    sc.setJobGroup("judge", "")
    got = {r["ord"]: r["status"] for r in store.judge_pairs(spark.createDataFrame(pairs, "ord long, target string, base string"), df, max_hops=4).collect()}
    jobs = len(sc.statusTracker().getJobIdsForGroup("judge"))
    sc.setLocalProperty("spark.jobGroup.id", None)
    # A chain of four edges is too long: so the fifth pair is refused, and its target begins a new chain.
    assert got == {i: "skipped" if i % 5 == 4 else "ok" for i in range(n)} and jobs < 40


def test_casts():
    x = np.array([1.0, -2.5, 3.140625, 65504.0, 1e-3], "<f4")
    assert np.array_equal(np.frombuffer(K.cast_floats(x.tobytes(), "float32", "float16"), "<f2"), x.astype("<f2"))
    bf = K.cast_floats(x.tobytes(), "float32", "bfloat16")
    back = np.frombuffer(K.cast_floats(bf, "bfloat16", "float32"), "<f4")
    assert np.allclose(back, x, rtol=2**-8) and K.cast_floats(back.tobytes(), "float32", "bfloat16") == bf
    with pytest.raises(ValueError):
        K.cast_floats(b"", "int8", "float32")


def test_xor_dictionary(spark):
    got = QUERIES["k17_dictionary"](spark, D)
    assert got.filter("bytes < 0 OR bytes IS NULL").isEmpty()
    with pytest.raises(ValueError):
        K.train_xor_dictionary([])


def test_delete_of_an_unknown_model(spark):
    models = spark.createDataFrame([("m", "ready", 1, None, None, None)], catalog.MODELS)
    maps = spark.createDataFrame([("m", "p", 1)], "model string, param string, tensor_id long")
    with pytest.raises(KeyError):
        catalog.delete_models(models, maps, spark.createDataFrame([("x",)], "model string"))
    a, b = catalog.delete_models(models, maps, spark.createDataFrame([("m",)], "model string"))
    assert a.count() == b.count() == 0


def test_headers_and_paths(tmp_path):
    root = str(tmp_path)
    i = name(b"12345678")
    row = {"id": i, "dtype": "float32", "shape": [2], "codec": None, "base_id": None, "item_size": None, "level": None, "data": b"12345678"}
    size = safetensors.save_blob(root, row)
    path = safetensors.find_blob(root, i)
    assert size == os.path.getsize(path) and safetensors.probe(path) == (None, None)
    assert safetensors.load_blob(path) == row
    packed = row | {"codec": store.CODEC, "base_id": "b" * 32, "item_size": 4, "level": 3, "data": b"zz"}
    safetensors.save_blob(root, packed)
    assert safetensors.probe(path) == (store.CODEC, "b" * 32) and safetensors.load_blob(path) == packed
    safetensors.write_file(path, {"other": ("uint8", [2], b"zz")}, {"codec": "unheard of", "base_tensor_id": ""})
    assert safetensors.probe(path) == (None, None) and safetensors.load_blob(path)["codec"] is None
    old = f"{root}/blobs/{i[:2]}/{i}.safetensors"
    os.rename(path, old)
    assert safetensors.find_blob(root, i) == old
    with pytest.raises(FileNotFoundError):
        safetensors.find_blob(root, "a" * 32)
    for bad in ("", "a/b", "..", "a\\b"):
        with pytest.raises(ValueError):
            safetensors.blob_path(root, bad)
    safetensors.write_file(old, {"t": ("float32", [3], b"12345678")})
    with pytest.raises(ValueError):
        list(safetensors.slots(old))
    assert safetensors.root_of("file:///a%20b/") == "/a b" and safetensors.root_of("/x/") == "/x"
    with pytest.raises(ValueError):
        safetensors.root_of("s3a://bucket/x")


def test_payload_keys():
    assert safetensors.pick_key(["a", "tensor"], {}) == "tensor"
    assert safetensors.pick_key(["_fp", "a", "b"], {"_fp": [9], "a": [1], "b": [2]}, [2]) == "b"
    assert safetensors.pick_key(["_fp", "fingerprint", "z"], {}) == "z"


def test_files_by_the_readers_of_spark(spark, tmp_path):
    safetensors.write_file(f"{tmp_path}/m/a.safetensors", {"x": ("float32", [2], b"12345678"), "y": ("uint8", [3], b"abc")})
    one = sorted(map(tuple, safetensors.read(spark, str(tmp_path)).select("name", "dtype", "payload").collect()))
    two = sorted(map(tuple, safetensors.read_binary(spark, str(tmp_path)).select("name", "dtype", "payload").collect()))
    assert one == two and len(one) == 2


def test_index_of_a_model_in_several_files(spark, tmp_path):
    rows = [("m", p, "uint8", [4], bytearray(b"abcd"), f"model-0000{i}-of-00002.safetensors") for i, p in ((1, "a"), (1, "b"), (2, "c"))]
    safetensors.write_models(spark.createDataFrame(rows, "model string, param string, dtype string, shape array<long>, payload binary, file string"), str(tmp_path))
    body = json.load(open(f"{tmp_path}/m/model.safetensors.index.json"))
    assert body == {"metadata": {"total_size": 12}, "weight_map": {r[1]: r[5] for r in rows}}


def grouped(spark):
    from loomstore.plans.tensors import tensors

    t = tensors(spark, D).toPandas().sort_values("ord")
    return {k: x for k, x in t.groupby("group_key")}


def test_recall_of_the_index(spark):
    got = {r["group_key"]: (r["tensors"], r["same"]) for r in QUERIES["e12_recall"](spark, D).collect()}
    for k, x in grouped(spark).items():
        s, n = [np.asarray(v, np.int64) for v in x.sketch], x.n_bits.to_numpy()
        a, b = planner.attach_group(s, n), planner.attach_group_indexed(s, n)
        assert got[k] == (len(x), sum(u[:2] == v[:2] for u, v in zip(a, b)))
    near = np.random.default_rng(3).integers(-50, 50, (40, 64))
    copies = [near[i % 40] + (0 if i < 40 else np.random.default_rng(i).integers(-1, 2, 64)) for i in range(160)]
    a, b = planner.attach_group(copies, np.full(160, 180_000), 0.3), planner.attach_group_indexed(copies, np.full(160, 180_000), 0.3)
    assert sum(u[:2] == v[:2] for u, v in zip(a, b)) >= 0.9 * 160


def test_only_the_models_pairs(spark):
    row = QUERIES["e05_only_model"](spark, D).first()
    whole = spark.read.parquet(f"{D}/embeddings.parquet")
    own, n = whole.filter("label = 3").count(), whole.count()
    assert 0 <= row["n_pairs"] <= own and row["n_bases"] <= n and row["n_skipped"] == 0 and row["n_groups"] == 10


def test_a_plan_in_the_order_of_structs(spark):
    """Hub tensors by time (none first) and id, then own ones by parameter: as the same rows with that order as a number."""
    from pyspark.sql import functions as F

    rng = np.random.default_rng(4)
    rows = [("g" if i % 3 else None, (i * 7) % 40, bool(i % 2), None if i % 2 or i == 4 else i % 5, f"p{i:02d}" if i % 2 else "", rng.integers(-60, 60, 8).tolist()) for i in range(40)]
    t = spark.createDataFrame(rows, "group_key string, tensor_id long, own boolean, at long, param string, sketch array<int>").withColumn("n_bits", F.lit(9000).cast("long"))
    got = planner.attach(t.withColumn("ord", F.struct("own", "at", "param", "tensor_id")), 0.6).collect()
    place = {r[1]: k for k, r in enumerate(sorted(rows, key=lambda r: (r[2], r[3] is not None, r[3] or 0, r[4], r[1])))}
    number = spark.createDataFrame(sorted(place.items()), "tensor_id long, ord long")
    want = planner.attach(t.join(number, "tensor_id"), 0.6).collect()
    assert sorted(map(str, got)) == sorted(map(str, want)) and {r["role"] for r in got} == {"base", "delta"}


def test_only_the_models_pairs_by_a_plain_loop(spark):
    from loomstore.plans.tensors import tensors

    t = sorted(tensors(spark, D).collect(), key=lambda r: (r["group_key"] == "3", str(r["tensor_id"]) if r["group_key"] == "3" else "", r["ord"], r["tensor_id"]))
    pairs = bases = 0
    for g in range(10):
        mine = [r for r in t if r["tensor_id"] % 10 == g]
        plan = planner.attach_group([np.asarray(r["sketch"], np.int64) for r in mine], np.array([r["n_bits"] for r in mine]))
        pairs += sum(p[0] == "delta" and r["group_key"] == "3" for r, p in zip(mine, plan))
        bases += sum(p[0] == "base" for p in plan)
    assert QUERIES["e05_only_model"](spark, D).first().asDict() == {"n_pairs": pairs, "n_bases": bases, "n_skipped": 0, "n_groups": 10}


def test_means_against_a_reference(spark):
    g = grouped(spark)
    s = {k: np.stack(x.sketch.to_numpy()).astype(int) for k, x in g.items()}
    bits = int(next(iter(g.values())).n_bits.iloc[0])

    def mean(k):
        n = min(len(s["0"]), len(s[k]))
        return planner.ratios(((s["0"][:n] - s[k][:n]) ** 2).sum(1) / 2 / bits)

    means = {k: mean(k).mean() for k in s if k != "0"}
    assert {r["model"] for r in QUERIES["e14_prune"](spark, D).collect()} == {"0", *(k for k, v in means.items() if 1 - v <= 0.05)}
    top = [k for k, _ in sorted(means.items(), key=lambda kv: (-kv[1], kv[0]))[:5]]
    cells = QUERIES["e16_heatmap"](spark, D).collect()
    assert {c["model"] for c in cells} == set(top) and {c["place"] for c in cells} == {1, 2, 3, 4, 5}
    for c in cells:
        assert abs(c["saved"] - (1 - mean(c["model"])[c["param"] - 1])) < 1e-9


def test_strategies_and_splits():
    r = np.array([[0, 0.2, 0.9, 0.8], [0.3, 0, 0.9, 0.7], [0.9, 0.9, 0, 0.1], [0.8, 0.7, 0.2, 0]])
    got = planner.strategy_costs(r, 3)
    assert got["chain"] == (pytest.approx(1 + 0.3 + 0.9 + 0.2), 1)
    assert got["star-first"] == (pytest.approx(1 + 0.3 + 0.9 + 0.8), 1) and got["star-mid"] == (pytest.approx(1 + 0.9 + 0.9 + 0.2), 1)
    assert got["k-center"] == (pytest.approx(3 + 0.3), 3)
    assert facility.one_more(np.array([[0.0]])) == [0]
    for seed in range(20):
        x = np.random.default_rng(seed).random((12, 12))
        np.fill_diagonal(x, 0)
        b = facility.one_more(x)
        first = int(x.sum(0).argmin())
        now = x[:, first].copy()
        worse = [i for i in range(12) if i != first and now[i] > np.delete(now, first).mean()]
        now[first] = 1
        gains = [(sum(max(0, now[i] - x[i, c]) for i in range(12) if i != c) - (1 - now[c])) for c in worse]
        want = [first] + ([worse[int(np.argmax(gains))]] if max(gains) > 0 else [])
        assert b == sorted(want)


def test_sweep_is_the_solvers_on_first_tensors(spark):
    got = QUERIES["g16_sweep"](spark, D)
    g = grouped(spark)
    for row in got.filter("method = 'greedy'").collect():
        x = g[row["group_key"]]
        n = min(row["size"], len(x))
        r = planner.matrix(np.stack(x.sketch.to_numpy())[:n], int(x.n_bits.iloc[0]))
        assert row["cost"] == round(facility.cost(r, facility.greedy(r)), 9) and row["ratio"] == pytest.approx(row["cost"] / row["size"])


def test_batch_kernels_are_the_single_ones():
    rng = np.random.default_rng(7)
    datas = [None, b"", b"abc", *(rng.integers(0, 256, 2 * n).astype(np.uint8).tobytes() for n in (1, 5, 64, 4000)), bytes(64)]
    for x, y in zip(datas, K.sketch_many(datas, 2, 64)):
        one = None if x is None else K.sketch(x, 2, 64)
        assert (one is None) == (y is None) and (one is None or np.array_equal(one, y))
    whole = K.sketch(datas[6], 2, 64)
    parts = K.sketch_many([datas[6][c : c + 100] for c in range(0, 8000, 100)], 2, 64, np.arange(0, 8000, 100) // 2)
    assert np.array_equal(np.sum(parts, 0), whole)
    for x, y in zip(datas, K.entropy_many(datas)):
        assert (x is None) == (y is None) and (x is None or abs(K.byte_entropy(x) - y) < 1e-12)
    a, b = datas[3:], [bytes(len(x)) for x in datas[3:]]
    assert K.hamming_many([None, *a], [b"", *b]) == [None, *(K.hamming(x, y) for x, y in zip(a, b))]
    with pytest.raises(ValueError):
        K.hamming_many([b"a"], [b"ab"])


def test_nearest_static_base(spark):
    rng = np.random.default_rng(9)
    rows = [(f"g{i % 3}", i % 50, i, [int(v) for v in rng.integers(-9, 9, 8)], 4096) for i in range(300)] + [("lone", 1, 900, [1] * 8, 64), ("g0", 3, 901, None, 64)]
    t = spark.createDataFrame(rows, "group_key string, ord long, tensor_id long, sketch array<int>, n_bits long")
    got = {r["tensor_id"]: (r["base_id"], r["distance"]) for r in planner.nearest_static(t, t.filter("tensor_id % 4 = 0"), size=32).collect()}
    want = {}
    for g, _, i, s, n in rows:
        near = [(sum((x - y) ** 2 for x, y in zip(s, z)) / 2 / n, o, j) for h, o, j, z, _ in rows if h == g and j % 4 == 0 and j != i and z] if s else []
        if near:
            want[i] = (min(near)[2], min(near)[0])
    assert got == want


def test_places_and_quantiles(spark):
    from pyspark.sql import functions as F

    from loomstore.operators import ranks

    rng = np.random.default_rng(2)
    rows = [("hot" if i % 3 else f"k{i % 7}", float(v), i) for i, v in enumerate(rng.integers(0, 40, 900))] + [(None, 1.0, 1000), ("null", None, 1001)]
    df = spark.createDataFrame(rows, "g string, v double, i long")
    got = ranks.places(df, [F.desc("v"), F.asc("i")], ["g"]).collect()
    assert len(got) == len(rows)
    for g in {r[0] for r in rows}:
        own = sorted((r for r in got if r["g"] == g), key=lambda r: (r["v"] is None, -(r["v"] or 0), r["i"]))
        assert [r["place"] for r in own] == list(range(len(own))) and {r["rows"] for r in own} == {len(own)}
    q = {r["g"]: r for r in ranks.quantiles(df, "v", {"a": 0.5, "b": 0.9}, ["g"]).collect()}
    n = {r["g"]: r for r in ranks.quantiles(df, "v", {"a": 0.5, "b": 0.99}, ["g"], nearest=True).collect()}
    for g in {r[0] for r in rows} - {"null"}:
        v = sorted(r[1] for r in rows if r[0] == g)
        assert q[g]["a"] == pytest.approx(np.quantile(v, 0.5)) and q[g]["b"] == pytest.approx(np.quantile(v, 0.9))
        assert (n[g]["a"], n[g]["b"]) == (v[min(len(v) - 1, int(0.5 * len(v)))], v[min(len(v) - 1, int(0.99 * len(v)))])
    assert ranks.places(df.limit(0), [F.col("v")]).count() == 0


def test_estimates_of_distance():
    a, b = np.arange(8, dtype=np.int32), np.zeros(8, np.int32)
    assert K.hamming_estimate(a, b, 2) == np.median([0 + 1 + 4 + 9, 16 + 25 + 36 + 49]) and K.hamming_estimate(a, b, 4) == np.median([1, 13, 41, 85])


def test_distance_solvers(spark):
    from pyspark.sql import functions as F

    from loomstore.functions import exprs as X

    grid = np.array([0.0, 1e-5, 1e-4, 8.75e-4, 9e-4, 1e-2, 1.0])
    df = spark.createDataFrame([(float(v),) for v in grid], "d double")
    assert np.allclose(facility.curve(grid), [r[0] for r in df.select(X.curve_ratio(F.col("d"))).collect()])
    assert facility.curve(np.array([0.5]), 0.1)[0] == np.inf
    got = {(r["group_key"], r["method"]): r for r in QUERIES["g11_distances"](spark, D).collect()}
    for k, x in grouped(spark).items():
        r = facility.curve(facility.euclidean(np.stack(x.sketch.to_numpy()), x.n_bits.to_numpy().astype(float)))
        np.fill_diagonal(r, 0)
        b = facility.primal_dual(r)
        assert got[k, "primal-dual"]["n_bases"] == len(b) and got[k, "primal-dual"]["cost"] == pytest.approx(facility.cost(r, b))
        assert got[k, "seeded"]["cost"] <= got[k, "seeds"]["cost"] + 1e-9
    t = spark.createDataFrame([("g", i, i, [i * 1000] * 4, 64) for i in range(3)], "group_key string, ord long, tensor_id long, sketch array<int>, n_bits long")
    known = spark.createDataFrame([("g", 0, 1, 0.01), ("g", 2, 1, 0.01)], "group_key string, i long, j long, ratio double")
    best = facility.compare_distances(t, override=known).filter("method = 'greedy'").first()
    assert (best["n_bases"], best["cost"]) == (1, pytest.approx(1.02))


@pytest.mark.parametrize("most,cap", [(4, 100), (4, None), (1, 10), (7, 40)])
def test_batches_go_on_from_stretch_to_stretch(spark, most, cap):
    rng = np.random.default_rng(most)
    n = 64 * most * 5 + 3
    rows = [(int(o), None if b < 2 else 500 if b > 58 else int(b)) for o, b in zip(rng.permutation(n) * 3 - 50, rng.integers(0, 60, n))]
    want, number, used, count = {}, 0, 0, 0
    for o, b in sorted(rows):
        b = b or 0
        if count and (count == most or cap is not None and used + b > cap):
            number, used, count = number + 1, 0, 0
        used, count = used + b, count + 1
        want[o] = (b, number)
    got = store.batches(spark.createDataFrame(rows, "ord long, bytes long"), most, cap).collect()
    assert len(got) == n and {r["ord"]: (r["bytes"], r["batch"]) for r in got} == want
    none = spark.createDataFrame([], "ord long, bytes long")
    assert store.batches(none, most, cap).count() == 0


def test_distances_by_blocks_are_the_matrix():
    rng = np.random.default_rng(6)
    x, bits = rng.integers(-90, 90, (300, 8)), rng.integers(1, 3, 300) * 4e6
    whole = facility.curve(facility.euclidean(x, bits), 5e-2)
    np.fill_diagonal(whole, 0)
    whole[3, 9] = whole[9, 3] = 0.01
    r = facility.Distances(x, bits, 5e-2, {(3, 9): 0.01, (9, 3): 0.01})
    mask = rng.random(300) < 0.5
    for at in ((slice(None), slice(5, 40)), (mask, 9), (slice(None), [1, 9]), (np.arange(20)[::-1], slice(0, 30)), np.ix_(np.arange(5), [9, 2])):
        assert np.allclose(r[at], whole[at]) and r[at].shape == whole[at].shape
    for solve in (facility.primal_dual, facility.greedy, lambda m: facility.greedy(m, [0, 7])):
        b = solve(r)
        assert b == solve(whole) and facility.cost(r, b) == pytest.approx(facility.cost(whole, b))


def some_tensors(seed, n=70):
    """Copies, near copies and others, of two sizes; some pairs known."""
    rng = np.random.default_rng(seed)
    x = rng.integers(-60, 60, (n // 2, 6))[rng.integers(0, n // 2, n)] + rng.integers(-1, 2, (n, 6)) * (rng.random((n, 1)) < 0.5)
    bits = rng.choice([2048.0, 4096.0, 1e5], n)
    known = {(int(i), int(j)): float(v) for i, j, v in zip(rng.integers(0, 30, 4), rng.integers(30, 60, 4), rng.random(4) * 0.8)}
    return x, bits, known | {(j, i): v for (i, j), v in known.items()} if seed % 2 else {}


@pytest.mark.parametrize("step", [7, 1024])
def test_near_ratios_are_the_matrix(step):
    for seed in range(12):
        r = facility.Distances(*some_tensors(seed)[:2], np.inf, some_tensors(seed)[2])
        m, whole = r.near(step=step), r[:, :]
        told = np.full((len(m), len(m)), m.far)
        for j in range(len(m)):
            told[m.of(j)[0], j] = m.of(j)[1]
        assert np.array_equal(told[np.ix_(m.row, m.row)], whole) and len(m) < len(r)
        b = facility.near_primal_dual(m)
        assert m.first[b].tolist() == facility.primal_dual(whole) and m.cost(b) == pytest.approx(facility.cost(whole, m.first[b]))
        for start in (None, [0, 3, 9, 20]):
            b = facility.near_greedy(m, start)
            total = lambda z: len(z) + whole[:, m.first[sorted(z)]].min(1).sum()
            rest = set(range(len(m))) - set(b)
            moves = [{*b, c} for c in rest] + [set(b) - {x} for x in b if len(b) > 1] + [set(b) - {x} | {c} for x in b for c in rest]
            assert min(total(z) for z in moves) > total(b) - 2e-9
            assert total(b) == pytest.approx(total(np.searchsorted(m.first, facility.greedy(whole, start and m.first[start].tolist()))))


def test_what_near_ratios_do_not_tell_is_asked_of_blocks():
    x, bits, known = some_tensors(1)
    assert facility.Distances(x, bits, 0.01).near() is None  # far pairs have no ratio
    assert facility.Distances(x, bits, np.inf, {(0, 1): 5.0, (1, 0): 5.0}).near() is None
    r = facility.Distances(x, bits, np.inf, known)
    assert r.near(limit=3) is None and r.near(limit=len(x) ** 2) is not None
    want = facility.solved(r, [0, 3, 9])
    r.near = lambda: None
    got = facility.solved(r, [0, 3, 9])
    assert {k: n for k, (n, _) in got.items()} == {k: n for k, (n, _) in want.items()} and all(got[k][1] == pytest.approx(want[k][1]) for k in got)
    alone = facility.solved(facility.Distances(x[:1], bits[:1]), [0])
    assert set(alone.values()) == {(1, 1.0)}


def test_blocks_stay_small_with_many_bases(monkeypatch):
    made, block = [], facility.Distances._block
    x = np.random.default_rng(5).integers(-60, 60, (40, 4))
    r = facility.Distances(np.concatenate([x, x, x + 1]), np.full(120, 2e4), 0.09)
    start = list(range(50))
    whole = r[:, :]
    want = [facility.greedy(whole, start), facility.greedy(whole), facility.cost(whole, start)]
    monkeypatch.setattr(facility, "BLOCK", 1200, raising=False)
    monkeypatch.setattr(facility.Distances, "_block", lambda self, i, j: made.append(len(i) * len(j)) or block(self, i, j))
    assert [facility.greedy(r, start), facility.greedy(r), facility.cost(r, start)] == want
    assert max(made) <= 1200


def test_solvers_meet_pairs_once(monkeypatch):
    asked, curve = [], facility.curve
    monkeypatch.setattr(facility, "curve", lambda d, *a: asked.append(np.size(d)) or curve(d, *a))
    x = np.random.default_rng(2).integers(-20, 20, (300, 16))
    got = facility.solved(facility.Distances(np.concatenate([x, x]), np.full(600, 2048.0)), [0, 1, 2, 3])
    assert {got[k] for k in ("primal-dual", "greedy", "seeded")} == {(300, 300.0)} and got["seeds"][0] == 4
    assert sum(asked) <= 600**2


def test_bundle(spark):
    rows = [("m1", "p", 1, "a", [1, 2], [4, 2], "float16"), ("m0", "p", 9, "a", [1, 2], [4, 2], "float16"), ("m2", "p", 3, "b", [1, 3], [4, 2], "float16"), ("m2", "p", 4, "b", [1, 3], [8], "float16"), ("m2", "s", 5, "c", [0, 0], [], "float16"), ("m2", "q", 6, "a", [1, 2], [4, 2], "float32")]
    df = spark.createDataFrame(rows, "model string, param string, tensor_id long, id string, sketch array<int>, shape array<long>, dtype string")
    got = sorted(((r["group_key"].split("\x00")[0], r["ord"], r["tensor_id"], r["n_bits"]) for r in planner.bundle(df).collect()))
    assert got == [("p", 1, 4, 128), ("p", 1, 9, 128), ("p", 2, 3, 128), ("q", 1, 6, 256)]
    plan = QUERIES["e07_bundle"](spark, D)
    assert plan.filter("role = 'delta' AND predicted_ratio >= 0.70").isEmpty() and plan.count() > 0


def test_answers_to_requests(spark):
    from pyspark.sql import functions as F

    from loomstore.functions import exprs as X

    rows = [
        ("ab", 10, None, None, (200, 0, 9)), ("ab", 10, "bytes=2-4", None, (206, 2, 4)), ("ab", 10, "bytes=2-", None, (206, 2, 9)), ("ab", 10, "bytes=-3", None, (206, 7, 9)),
        ("ab", 10, "bytes=-30", None, (206, 0, 9)), ("ab", 10, "bytes=2-400", None, (206, 2, 9)), ("ab", 10, "bytes=10-", None, (416, None, None)), ("ab", 10, "bytes=4-2", None, (416, None, None)),
        ("ab", 10, "bytes=1-2,4-5", None, (416, None, None)), ("ab", 10, "lines=1-2", None, (416, None, None)), ("ab", 10, "bytes=-0", None, (416, None, None)), ("ab", 10, "bytes=-", None, (416, None, None)),
        ("ab", 10, "bytes=1-2", '"x", "ab"', (304, None, None)), ("ab", 10, None, '"x"', (200, 0, 9)), ("ab", None, None, None, (404, None, None)), ("a/b", 10, None, None, (400, None, None)), ("ab", 10, "bytes=99999999999999999999-", None, (416, None, None)),
    ]
    df = spark.createDataFrame([(i, *r[:4]) for i, r in enumerate(rows)], "i int, id string, size long, ranges string, known string")
    got = df.select("i", X.blob_answer(F.col("id"), F.col("size"), F.col("ranges"), F.col("known")).alias("a")).orderBy("i").collect()
    assert [tuple(r["a"]) for r in got] == [r[4] for r in rows]
