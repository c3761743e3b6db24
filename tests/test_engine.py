import glob
import math
import os

import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry
from loomstore.plans import ORACLES, QUERIES

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{D}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    return str(pd.Timestamp(v)) if hasattr(v, "isoformat") else v


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_duckdb(spark, duck, name):
    df = QUERIES[name](spark, D)
    rel = duck.execute(ORACLES[name])
    cols = [c[0] for c in rel.description]
    assert sorted(cols) == sorted(df.columns)
    key = lambda r: [(x is None, str(x)) for x in r]
    want = sorted(([plain(r[cols.index(c)]) for c in df.columns] for r in rel.fetchall()), key=key)
    got = sorted(([plain(x) for x in r] for r in df.collect()), key=key)
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert all(x == y or isinstance(x, float) and abs(x - float(y)) <= 1e-6 * max(1, abs(x)) for x, y in zip(a, b))


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() == spark.read.parquet(f"{D}/embeddings.parquet").count()


def test_roundtrips(spark):
    assert QUERIES["k09_roundtrip"](spark, D).filter("NOT same").isEmpty()
    assert QUERIES["a01_safetensors"](spark, D).filter("NOT intact").isEmpty()


def test_sketch_by_parts_is_the_sketch(spark):
    whole = QUERIES["k03_sketch"](spark, D).filter("v <> 0").selectExpr("tensor_id", "slot", "CAST(v AS BIGINT) AS v")
    assert whole.exceptAll(QUERIES["k04_sketch_by_parts"](spark, D)).isEmpty()


def test_stream_is_the_batch_plan(spark):
    a, b = QUERIES["s01_stream_attach"](spark, D), QUERIES["e04_attach"](spark, D)
    assert a.count() == b.count() and a.select("tensor_id", "role", "base_id").exceptAll(b.select("tensor_id", "role", "base_id")).isEmpty()


def test_shards(spark):
    got = QUERIES["a16_shards"](spark, D)
    assert got.groupBy("model", "shard").sum("size_bytes").filter("`sum(size_bytes)` > 100000").join(got.groupBy("model", "shard").count().filter("count > 1"), ["model", "shard"]).isEmpty()


def test_no_tensor_is_left_out(spark):
    from loomstore.plans.tensors import tensors

    e = spark.read.parquet(f"{D}/embeddings.parquet")
    assert QUERIES["a01_safetensors"](spark, D).count() == e.select("embedding").distinct().count()
    size = {r["label"]: r["count"] for r in e.withColumn("label", e.label.cast("string")).groupBy("label").count().collect()}
    t = tensors(spark, D).toPandas().sort_values("ord")
    from loomstore.operators import facility, planner

    r = {k: planner.matrix(np.stack(x.sketch.to_numpy()), int(x.n_bits.iloc[0])) for k, x in t.groupby("group_key")}
    assert {k: len(x) for k, x in r.items()} == size
    for row in QUERIES["g06_facility"](spark, D).filter("method = 'greedy'").collect():
        assert row["cost"] == round(facility.cost(r[row["group_key"]], facility.greedy(r[row["group_key"]])), 9)
    s = {k: np.stack(x.sketch.to_numpy()) for k, x in t.groupby("group_key")}
    for row in QUERIES["e13_ratio_by_param"](spark, D).filter("m <> '0'").collect():
        n = min(size["0"], size[row["m"]])  # every parameter that both have
        want = planner.ratios(((s["0"][:n].astype(int) - s[row["m"]][:n]) ** 2).sum(1) / 2 / t.n_bits.iloc[0]).mean()
        assert abs(row["vs_first"] - want) < 1e-9


@pytest.mark.parametrize("budget, max_pairs", [(0, None), (400, None), (3000, None), (10**6, None), (3000, 150)])
def test_budget_looks_at_every_pair(spark, budget, max_pairs):
    from pyspark.sql import functions as F

    from loomstore.operators import facility

    rng = np.random.default_rng(5)
    size = {i: int(n) for i, n in enumerate(rng.integers(1, 60, 300))}
    size[7] = 0
    pairs = [tuple(map(int, p)) for p in rng.integers(0, 310, (4000, 2))]
    df = spark.createDataFrame(pairs, "target long, base long")
    order = df.withColumn("o", F.xxhash64("target", "base")).orderBy("o", "target", "base").collect()
    have, used, want = set(), 0, []
    for t, b, _ in order:
        if t in size and b in size:
            new = {t, b} - have
            if used + sum(size[i] for i in new) <= budget and (max_pairs is None or len(want) < max_pairs):
                have, used = have | new, used + sum(size[i] for i in new)
                want.append((t, b))
    got = facility.within_budget(df, spark.createDataFrame(list(size.items()), "id long, size long"), budget, max_pairs, block=50)
    assert sorted(map(tuple, got.collect())) == sorted(want)
