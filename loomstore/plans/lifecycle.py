"""Queries of the catalog's life, of stored blobs and of plans around the greedy rule, with DuckDB twins where SQL can say it.

Stand-ins: customers are models, orders their parameters; a document is a tensor whose base is the document of half its id; an
embedding's bytes are a tensor, its label the model, vec_id the order of arrival and the parameter.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import kernels as K
from ..operators import catalog, facility, planner, store
from ..operators.lineage import settle
from .relational import query, r, table
from .tensors import tensors

ORDERS_OF = "SELECT c_custkey AS k, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1"


def _models(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(customers, models that are there already, mappings)"""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("model"))
    day = F.lit("1990-01-01").cast("timestamp")
    old = c.filter("model % 3 = 0").select("model", F.lit("ready").alias("status"), F.lit(5).cast("long").alias("total_tensors"), F.lit(None).cast("string").alias("metadata"), day.alias("created_at"), day.alias("updated_at"))
    return c, old, table(spark, d, "orders").select(F.col("o_custkey").alias("model"), F.col("o_orderkey").alias("param"), F.col("o_totalprice").alias("tensor_id"))


def _lifecycle(spark, d) -> tuple[DataFrame, DataFrame]:
    c, models, mappings = _models(spark, d)
    at = lambda day: F.lit(day).cast("timestamp").alias("at")
    models, mappings = catalog.begin(models, mappings, c.filter("model % 4 = 0").select("model", F.lit(None).cast("string").alias("metadata"), at("2000-01-01")))
    models = catalog.commit(models, mappings, c.filter("model % 8 = 0 OR model % 5 = 0").select("model", at("2000-01-02")))
    return catalog.fail(models, c.filter("model % 7 = 0").select("model", at("2000-01-03"))), mappings


LIFE = f"""SELECT k AS model, CASE WHEN k % 7 = 0 THEN 'failed' WHEN k % 8 = 0 OR k % 5 = 0 THEN 'ready' WHEN k % 4 = 0 THEN 'ingesting' ELSE 'ready' END AS status,
CAST(CASE WHEN k % 8 = 0 OR k % 5 = 0 THEN CASE WHEN k % 4 = 0 THEN 0 ELSE n END WHEN k % 4 = 0 THEN 0 WHEN k % 3 = 0 THEN 5 ELSE 0 END AS BIGINT) AS total,
CASE WHEN k % 4 = 0 THEN '2000-01-01' WHEN k % 3 = 0 THEN '1990-01-01' WHEN k % 5 = 0 THEN '2000-01-02' ELSE '2000-01-03' END AS created,
CASE WHEN k % 7 = 0 THEN '2000-01-03' WHEN k % 8 = 0 OR k % 5 = 0 THEN '2000-01-02' WHEN k % 4 = 0 THEN '2000-01-01' ELSE '1990-01-01' END AS updated
FROM ({ORDERS_OF}) WHERE k % 3 = 0 OR k % 4 = 0 OR k % 5 = 0 OR k % 7 = 0"""


def _shown(models: DataFrame) -> DataFrame:
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    return models.select("model", "status", F.col("total_tensors").alias("total"), day("created_at").alias("created"), day("updated_at").alias("updated"))


@query("d02_lifecycle", LIFE)
def d02(spark, d):
    """Begin, commit and fail, one after the other, each for many models"""
    return _shown(_lifecycle(spark, d)[0])


@query("d03_listing", f"SELECT * FROM ({LIFE}) WHERE status = 'ready' ORDER BY created, model")
def d03(spark, d):
    """D3, I1"""
    return _shown(catalog.listing(_lifecycle(spark, d)[0], "ready"))


@query("d04_delete", f"SELECT k AS model, n AS params FROM ({ORDERS_OF}) WHERE k % 3 = 0 AND k % 9 <> 0")
def d04(spark, d):
    """Models go with their mappings; tensors stay"""
    c, models, mappings = _models(spark, d)
    models, mappings = catalog.delete_models(models, mappings, c.filter("model % 9 = 0"))
    return models.select("model").join(mappings, "model", "left").groupBy("model").agg(F.count("param").alias("params"))


EDGES = "SELECT doc_id AS tensor_id, doc_id // 2 AS base_id, 'old' AS codec FROM documents WHERE doc_id % 5 = 1"


def _edges(spark, d) -> DataFrame:
    return table(spark, d, "documents").filter("doc_id % 5 = 1").selectExpr("doc_id AS tensor_id", "doc_id DIV 2 AS base_id", "'old' AS codec")


@query("d07_backfill", f"WITH h AS (SELECT doc_id AS tensor_id, doc_id // 3 AS base_id, 'new' AS codec FROM documents WHERE doc_id % 3 = 0 AND doc_id % 2 = 0) SELECT * FROM h UNION ALL SELECT * FROM ({EDGES}) WHERE tensor_id NOT IN (SELECT tensor_id FROM h)")
def d07(spark, d):
    """Edges from headers; done twice it is the same"""
    h = table(spark, d, "documents").filter("doc_id % 3 = 0").selectExpr("doc_id AS tensor_id", "doc_id DIV 3 AS base_id", "CASE WHEN doc_id % 2 = 0 THEN 'new' END AS codec")
    once = catalog.backfill(_edges(spark, d), h)
    return catalog.backfill(once, h)


@query("d06_gc_counts", "WITH t AS (SELECT doc_id AS id FROM documents), k AS (SELECT id FROM t WHERE id % 3 = 0 UNION SELECT id // 2 FROM t WHERE id % 5 = 1), g AS (SELECT id FROM t WHERE id NOT IN (SELECT id FROM k)) SELECT count(*) AS tensors_deleted, count(*) FILTER (id % 11 <> 0) AS blobs_deleted, count(*) FILTER (id % 11 = 0) AS blob_errors, (SELECT count(DISTINCT id // 2) FROM t WHERE id % 5 = 1) AS bases_protected FROM g")
def d06(spark, d):
    """What gc reports, with files that are not there"""
    t = table(spark, d, "documents").select(F.col("doc_id").alias("tensor_id"))
    return catalog.sweep(t, t.filter("tensor_id % 3 = 0"), _edges(spark, d).select("tensor_id", "base_id"), t.filter("tensor_id % 11 <> 0"))[2]


@query("d08_manifest", "WITH RECURSIVE e AS (SELECT doc_id AS id, doc_id // 2 AS base FROM documents WHERE doc_id > 0), c(id, hop) AS (SELECT doc_id, 0 FROM documents WHERE doc_id % 97 = 5 UNION SELECT base, hop + 1 FROM c JOIN e ON c.id = e.id), m AS (SELECT id, min(hop) AS hop FROM c GROUP BY 1) SELECT m.id AS tensor_id, hop, n_chars AS size_bytes, lang AS dtype, CASE WHEN m.id > 0 THEN 'planes' ELSE '' END AS codec, coalesce(e.base, -1) AS base_id FROM m JOIN documents ON doc_id = m.id LEFT JOIN e ON e.id = m.id")
def d08(spark, d):
    """The closure over base edges, each tensor described"""
    t = table(spark, d, "documents").select(F.col("doc_id").alias("tensor_id"), F.col("n_chars").alias("size_bytes"), F.array(F.lit(1).cast("long")).alias("shape"), F.col("lang").alias("dtype"))
    e = t.filter("tensor_id > 0").selectExpr("tensor_id", "tensor_id DIV 2 AS base_id", "'planes' AS codec")
    m = t.selectExpr("tensor_id % 97 AS model", "tensor_id AS param", "tensor_id")
    return catalog.manifest(t, m, e, t.sparkSession.createDataFrame([(5,)], "model long")).drop("shape").fillna({"codec": "", "base_id": -1})


@query("d12_register", "SELECT 'tensor' AS kind, doc_id AS a, CASE WHEN doc_id % 4 = 0 THEN n_chars ELSE -n_chars END AS b FROM documents UNION ALL SELECT 'param', doc_id, CASE WHEN doc_id % 3 = 0 THEN doc_id ELSE doc_id + 1 END FROM documents WHERE doc_id % 3 = 0 OR doc_id % 4 = 0 UNION ALL SELECT 'edge', doc_id, doc_id // 2 FROM documents WHERE doc_id % 5 = 1")
def d12(spark, d):
    """A manifest registered: known tensors stay, mappings are replaced, and edges are kept"""
    docs = table(spark, d, "documents")
    t = docs.filter("doc_id % 4 = 0").select(F.col("doc_id").alias("tensor_id"), F.col("n_chars").alias("size_bytes"))
    m = docs.filter("doc_id % 4 = 0").selectExpr("'m' AS model", "doc_id AS param", "doc_id + 1 AS tensor_id")
    none = spark.createDataFrame([], "tensor_id long, base_id long, codec string")
    remote = docs.selectExpr("doc_id AS tensor_id", "-n_chars AS size_bytes", "CASE WHEN doc_id % 5 = 1 THEN doc_id DIV 2 END AS base_id", "CASE WHEN doc_id % 5 = 1 THEN 'planes' END AS codec")
    params = docs.filter("doc_id % 3 = 0").selectExpr("'m' AS model", "doc_id AS param", "doc_id AS tensor_id")
    t, m, e = catalog.register((t, m, none), remote, params)
    out = t.selectExpr("'tensor' AS kind", "tensor_id AS a", "size_bytes AS b").unionByName(m.selectExpr("'param' AS kind", "param AS a", "tensor_id AS b"))
    return out.unionByName(e.selectExpr("'edge' AS kind", "tensor_id AS a", "base_id AS b"))


@query("a22_to_fetch", f"WITH e AS ({EDGES}) SELECT doc_id AS tensor_id FROM documents LEFT JOIN e ON doc_id = tensor_id WHERE doc_id % 2 = 1 OR n_chars % 3 = 0 OR (doc_id % 7 = 0 AND base_id IS NOT NULL)")
def a22(spark, d):
    """What of a manifest is not at hand in the same size, codec and base"""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("tensor_id"), F.col("n_chars").alias("size_bytes"))
    e = _edges(spark, d)
    remote = docs.join(e, "tensor_id", "left")
    local = docs.filter("tensor_id % 2 = 0").selectExpr("tensor_id", "CASE WHEN size_bytes % 3 = 0 THEN -1 ELSE size_bytes END AS size_bytes")
    known = e.selectExpr("tensor_id", "CASE WHEN tensor_id % 7 = 0 THEN base_id + 1 ELSE base_id END AS base_id", "codec")
    return catalog.to_fetch(remote, local, known).select("tensor_id")


@query("a24_slim", "SELECT vec_id, label FROM embeddings")
def a24(spark, d):
    """The catalog without its sketches, and the sketches on their own: both written and read back"""
    settle(spark.range(1))
    base = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/slim-{uuid.uuid4().hex}"
    t = tensors(spark, d)
    t.select("tensor_id", "group_key").write.parquet(f"{base}/catalog")
    t.select("tensor_id", "sketch").write.parquet(f"{base}/sketches")
    slim, sketches = spark.read.parquet(f"{base}/catalog"), spark.read.parquet(f"{base}/sketches")
    return slim.join(sketches.filter("sketch IS NOT NULL").select("tensor_id"), "tensor_id", "left_semi").select(F.col("tensor_id").alias("vec_id"), F.col("group_key").cast(table(spark, d, "embeddings").schema["label"].dataType).alias("label"))


# -- blobs ------------------------------------------------------------------------------------------------

REPS = "SELECT embedding, min(vec_id) AS v FROM embeddings GROUP BY embedding"


def _stored(spark, d) -> tuple[DataFrame, DataFrame]:
    """(blobs, names): each distinct embedding a tensor, named by its content, encoded against that of half its least vec_id; names (id, v)"""
    e = table(spark, d, "embeddings").select("vec_id", K.floats_to_bytes()("embedding").alias("payload"))
    names = settle(e.groupBy("payload").agg(F.min("vec_id").alias("v")).withColumn("id", K.content_hash_udf()("payload")))
    raw = settle(store.raw_blobs(names.select(F.lit("float32").alias("dtype"), F.array(F.lit(64).cast("long")).alias("shape"), "payload")))
    of = e.join(names.select("payload", "id"), "payload").select("vec_id", F.col("id").alias("base"))
    pairs = names.filter("v > 0").select(F.col("v").alias("ord"), F.col("id").alias("target"), F.expr("v DIV 2").alias("vec_id")).join(of, "vec_id")
    return store.compress_pairs(pairs.select("ord", "target", "base"), raw)[1], names.select("id", "v")


@query("k12_reconstruct", f"WITH RECURSIVE n AS ({REPS}), m AS (SELECT vec_id, v FROM embeddings JOIN n USING (embedding)), e AS (SELECT n.v, m.v AS base FROM n JOIN m ON m.vec_id = n.v // 2 WHERE n.v > 0 AND m.v <> n.v), c(v, depth) AS (SELECT v, 0 FROM n WHERE v NOT IN (SELECT v FROM e) UNION ALL SELECT e.v, depth + 1 FROM e JOIN c ON e.base = c.v) SELECT v, depth, 'ok' AS status FROM c")
def k12(spark, d):
    """Tensors encoded in chains, decoded level by level, each base once, and checked against their ids"""
    blobs, names = _stored(spark, d)
    return store.reconstruct(settle(blobs)).join(names, "id").select("v", "depth", "status")


@query("k13_guards")
def k13(spark, d):
    """Pairs with repeats, cycles, unknown ids and other shapes, judged in their turn"""
    e = table(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("id"), F.array(F.when(F.col("vec_id") % 13 == 0, F.lit(32)).otherwise(F.lit(64)).cast("long")).alias("shape"))
    none = lambda kind: F.lit(None).cast(kind)
    blobs = e.select("id", F.lit("float32").alias("dtype"), "shape", none("string").alias("codec"), none("string").alias("base_id"), none("int").alias("item_size"), none("int").alias("level"), none("binary").alias("data"))
    v = table(spark, d, "embeddings").select("vec_id")
    n = F.lit(v.count())
    one = v.select(F.col("vec_id").alias("ord"), F.col("vec_id").cast("string").alias("target"), ((F.col("vec_id") * 7 + F.when(F.col("vec_id") % 5 == 0, 0).otherwise(3)) % (n + 3)).cast("string").alias("base"))
    two = v.filter("vec_id % 3 = 0").select((F.col("vec_id") + n).alias("ord"), F.col("vec_id").cast("string").alias("target"), F.expr("vec_id DIV 2").cast("string").alias("base"))
    return store.judge_pairs(one.unionByName(two), blobs)


@query("e11_auto_totals")
def e11(spark, d):
    """Plan, guarded encoding, totals by status with the realised ratio"""
    t = settle(tensors(spark, d).withColumn("id", K.content_hash_udf()("payload")))
    plan = planner.attach(t).filter("role = 'delta'")
    name = lambda c: t.select(F.col("tensor_id").alias(c), F.col("id").alias(f"{c}_content"))
    pairs = plan.join(name("tensor_id"), "tensor_id").join(name("base_id"), "base_id").select(F.col("tensor_id").alias("ord"), F.col("tensor_id_content").alias("target"), F.col("base_id_content").alias("base"))
    blobs = store.raw_blobs(t.select(F.lit("float32").alias("dtype"), F.array(F.lit(64).cast("long")).alias("shape"), "payload"))
    return store.totals(store.compress_pairs(pairs, settle(blobs))[0])


@query("k18_batches", "WITH RECURSIVE t AS (SELECT doc_id AS ord, coalesce(n_chars, 0) AS n, row_number() OVER (ORDER BY doc_id) AS rn FROM documents), c(ord, n, rn, number, used, k) AS (SELECT ord, n, rn, 0, n, 1 FROM t WHERE rn = 1 UNION ALL SELECT t.ord, t.n, t.rn, CASE WHEN k = 512 OR used + t.n > 50000 THEN number + 1 ELSE number END, CASE WHEN k = 512 OR used + t.n > 50000 THEN t.n ELSE used + t.n END, CASE WHEN k = 512 OR used + t.n > 50000 THEN 1 ELSE k + 1 END FROM c JOIN t ON t.rn = c.rn + 1) SELECT ord, CAST(number AS BIGINT) AS batch FROM c")
def k18(spark, d):
    """Batches of at most 512 pairs and a cap of bytes"""
    return store.batches(table(spark, d, "documents").select(F.col("doc_id").alias("ord"), F.coalesce("n_chars", F.lit(0)).alias("bytes")), 512, 50_000).select("ord", "batch")


@query("k17_dictionary")
def k17(spark, d):
    """A dictionary from every 16th pair's XOR (1000 at most, 4096 bytes of each), then all pairs under it and back"""
    from .tensors import pairs

    some = pairs(spark, d).filter("x % 16 = 0").orderBy("x").limit(1000).select("pa", "pb").collect()
    words = K.train_xor_dictionary([K.xor_bytes(a, b)[:4096] for a, b in some], 4096)
    f = K._udf("int", lambda a, b: len(z) if K.decode_with(z := K.encode_with(a, b, words), b, words) == a else -1)
    return pairs(spark, d).select("x", "y", f("pa", "pb").alias("bytes"))


# -- plans ------------------------------------------------------------------------------------------------


@query("e03_candidates", "SELECT vec_id AS tensor_id, label = 3 AS own, CASE WHEN label <> 3 THEN vec_id % 10 ELSE -1 END AS at, CASE WHEN label = 3 THEN 'p' || vec_id ELSE '' END AS param FROM embeddings WHERE vec_id % 17 <> 0")
def e03(spark, d):
    """The order in which the greedy rule sees a model's tensors, after the hub's; scalars are left out"""
    e = table(spark, d, "embeddings")
    m = e.select(F.col("label").cast("string").alias("model"), F.concat(F.lit("p"), F.col("vec_id")).alias("param"), F.col("vec_id").alias("tensor_id"))
    t = e.select(F.col("vec_id").alias("tensor_id"), F.when(F.col("vec_id") % 17 == 0, F.array().cast("array<bigint>")).otherwise(F.array(F.lit(64).cast("long"))).alias("shape"), (F.col("vec_id") % 10).alias("created_at"))
    return planner.candidates(m, t, "3", with_existing=True).select("tensor_id", "own", F.coalesce("ord.at", F.lit(-1)).alias("at"), "ord.param")


@query("e05_only_model")
def e05(spark, d):
    """Plan a model behind the hub's tensors, keep the pairs of its own; one row of counts"""
    t = settle(tensors(spark, d))
    m = t.select(F.col("group_key").alias("model"), F.col("tensor_id").cast("string").alias("param"), "tensor_id")
    seen = planner.candidates(m, t.select("tensor_id", F.array(F.lit(64).cast("long")).alias("shape"), F.col("ord").alias("created_at")), "3", True)
    plan = planner.attach(t.drop("ord").join(seen.select("tensor_id", "ord"), "tensor_id").withColumn("group_key", F.concat(F.lit("s"), F.col("tensor_id") % 10)))
    return planner.only_model(settle(plan), m, "3")[1]


@query("e12_recall")
def e12(spark, d):
    """E12"""
    return planner.recall_at_1(tensors(spark, d))


def _named(spark, d) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("group_key").orderBy("ord", "tensor_id"))
    return settle(tensors(spark, d).select(F.col("group_key").alias("model"), place.alias("param"), "sketch", "n_bits"))


@query("e14_prune")
def e14(spark, d):
    """Models that are not near copies of the reference"""
    return planner.prune_near(_named(spark, d), "0", 0.05)


@query("e16_heatmap")
def e16(spark, d):
    """Predicted savings of the five models that differ most from the reference, at each parameter"""
    return planner.heatmap(_named(spark, d), "0", 5)


FIT = "SELECT event_type AS g, value AS y, value * 0.9 + 1 + (event_id % 7) * 0.1 AS x FROM events WHERE value IS NOT NULL"


@query("f15_cluster_fit", f"SELECT g, count(*) AS n, round(avg(abs(x - y)), 6) AS mae, round(sqrt(avg(power(x - y, 2))), 6) AS rmse, round(avg(x - y), 6) AS bias, round(CASE WHEN count(*) > 2 THEN coalesce(corr(x, y), 0) ELSE 0 END, 5) AS pearson, round(CASE WHEN count(*) > 5 THEN regr_slope(y, x) END, 5) AS slope FROM ({FIT}) GROUP BY g")
def f15b(spark, d):
    """predicted against real; no correlation for two and fewer, no fit for five and fewer"""
    e = F.col("x") - F.col("y")
    n = F.count(F.lit(1))
    return _fit(spark, d).groupBy("g").agg(n.alias("n"), r(F.avg(F.abs(e))).alias("mae"), r(F.sqrt(F.avg(e * e))).alias("rmse"), r(F.avg(e)).alias("bias"), r(F.when(n > 2, F.coalesce(F.corr("x", "y"), F.lit(0.0))).otherwise(0.0), 5).alias("pearson"), r(F.when(n > 5, F.regr_slope("y", "x")), 5).alias("slope"))


def _fit(spark, d) -> DataFrame:
    return table(spark, d, "events").filter("value IS NOT NULL").selectExpr("event_type AS g", "value AS y", "value * 0.9D + 1 + (event_id % 7) * 0.1D AS x")


@query("f16_fit_quality", f"SELECT g, round(CASE WHEN count(*) < 3 THEN NULL WHEN var_pop(y) * count(*) <= 1e-15 THEN 0 ELSE 1 - sum(power(x - y, 2)) / (var_pop(y) * count(*)) END, 6) AS r2, round(CASE WHEN count(*) >= 3 THEN avg(abs(x - y)) END, 6) AS mae, round(CASE WHEN count(*) >= 3 THEN avg(CASE WHEN y > 0.1 THEN abs(x - y) / y END) END, 6) AS mape FROM ({FIT}) GROUP BY g")
def f16b(spark, d):
    """F16: R2, MAE, MAPE where the actual value is above 0.1; null below three rows (the correlation of ranks is f16_spearman)"""
    e, n = F.col("x") - F.col("y"), F.count(F.lit(1))
    total = F.var_pop("y") * n
    r2 = F.when(n < 3, None).when(total <= 1e-15, F.lit(0.0)).otherwise(1 - F.sum(e * e) / total)
    return _fit(spark, d).groupBy("g").agg(r(r2).alias("r2"), r(F.when(n >= 3, F.avg(F.abs(e)))).alias("mae"), r(F.when(n >= 3, F.avg(F.when(F.col("y") > 0.1, F.abs(e) / F.col("y"))))).alias("mape"))


@query("g01_reduction_trace", "WITH p AS (SELECT l_partkey AS tensor, 1 + max(l_suppkey) % 37 AS base, max(l_discount) AS gain FROM lineitem WHERE l_partkey % 3 = 0 GROUP BY 1), ok AS (SELECT * FROM p WHERE base % 3 <> 0), o AS (SELECT l_partkey AS tensor, min(o_orderdate) AS t FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1), b AS (SELECT base AS tensor, min(t) AS t FROM ok JOIN o USING (tensor) GROUP BY 1), a AS (SELECT tensor, min(t) AS t FROM (SELECT * FROM o UNION ALL SELECT * FROM b) GROUP BY 1), s AS (SELECT a.t, p_retailprice AS size, CASE WHEN ok.tensor IS NULL THEN p_retailprice ELSE p_retailprice * (1 - gain) END AS stored FROM a JOIN part ON p_partkey = a.tensor LEFT JOIN ok ON ok.tensor = a.tensor), g AS (SELECT date_trunc('month', t) AS month, sum(size) AS size, sum(stored) AS stored FROM s GROUP BY 1) SELECT strftime(month, '%Y-%m') AS month, round(sum(size) OVER w, 2) AS original, round(sum(stored) OVER w, 2) AS stored, round(1 - sum(stored) OVER w / sum(size) OVER w, 6) AS reduction FROM g WINDOW w AS (ORDER BY month)")
def g01(spark, d):
    """A base counts raw at the moment its first target needs it, or its first model holds it. As no base is a target once roles are resolved, both moments are minima, and the trace is a running sum."""
    li = table(spark, d, "lineitem")
    plan = li.filter("l_partkey % 3 = 0").groupBy(F.col("l_partkey").alias("tensor")).agg((1 + F.max("l_suppkey") % 37).alias("base"), F.max("l_discount").alias("gain")).filter("base % 3 <> 0")
    own = table(spark, d, "orders").join(li.select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_partkey").alias("tensor")), "o_orderkey").groupBy("tensor").agg(F.min("o_orderdate").alias("t"))
    needed = plan.join(own, "tensor").groupBy(F.col("base").alias("tensor")).agg(F.min("t").alias("t"))
    first = own.unionByName(needed).groupBy("tensor").agg(F.min("t").alias("t"))
    part = table(spark, d, "part").select(F.col("p_partkey").alias("tensor"), F.col("p_retailprice").alias("size"))
    each = first.join(part, "tensor").join(plan.select("tensor", "gain"), "tensor", "left").withColumn("stored", F.col("size") * (1 - F.coalesce("gain", F.lit(0.0))))
    g = each.groupBy(F.date_trunc("month", "t").alias("m")).agg(F.sum("size").alias("size"), F.sum("stored").alias("kept"))
    w = Window.orderBy("m").rowsBetween(Window.unboundedPreceding, 0)  # a row for each month
    a, b = F.sum("size").over(w), F.sum("kept").over(w)
    return g.select(F.date_format("m", "yyyy-MM").alias("month"), r(a, 2).alias("original"), r(b, 2).alias("stored"), r(1 - b / a).alias("reduction"))


@query("g04_degraded", "WITH o AS (SELECT DISTINCT o_custkey AS model, l_partkey AS tensor FROM orders JOIN lineitem ON o_orderkey = l_orderkey), m AS (SELECT DISTINCT model FROM o), k AS (SELECT model FROM m ORDER BY sha256(CAST(model AS VARCHAR)), model LIMIT greatest(1, CAST(floor((SELECT count(*) FROM m) * 0.258) AS BIGINT))), kept AS (SELECT DISTINCT tensor FROM o WHERE model IN (SELECT model FROM k)), p AS (SELECT tensor, min(l_discount) AS gain FROM o JOIN lineitem ON l_partkey = tensor GROUP BY 1) SELECT p.tensor, round(CASE WHEN kept.tensor IS NOT NULL THEN p_retailprice * (1 - gain) ELSE floor(p_retailprice * (1 - 0.333)) END, 4) AS stored, kept.tensor IS NOT NULL AS kept FROM p JOIN part ON p_partkey = p.tensor LEFT JOIN kept ON kept.tensor = p.tensor")
def g04(spark, d):
    """25.8 % of the models, the first by hash, keep their plans; tensors that only others have are saved a third"""
    li = table(spark, d, "lineitem")
    o = settle(table(spark, d, "orders").join(li, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_custkey").alias("model"), F.col("l_partkey").alias("tensor")).distinct())
    plan = li.groupBy(F.col("l_partkey").alias("tensor")).agg(F.min("l_discount").alias("gain")).join(o.select("tensor"), "tensor", "left_semi")
    sizes = table(spark, d, "part").select(F.col("p_partkey").alias("tensor"), F.col("p_retailprice").alias("size"))
    out = facility.degraded(plan.join(sizes, "tensor"), o, 0.258, 0.333)
    return out.select("tensor", r("stored", 4).alias("stored"), "kept")


META = "SELECT p_partkey AS id, p_brand AS model, p_size % 4 AS shape, CASE WHEN p_partkey % 5 = 0 THEN 'language.layers.0.q_proj' WHEN p_partkey % 5 = 1 THEN 'layers.0.q_proj' WHEN p_partkey % 5 = 2 THEN 'layers.1.q_proj' WHEN p_partkey % 5 = 3 THEN 'layers.0.norm' ELSE 'layers.0.q_proj.bias' END AS param FROM part"


@query("g09_cache_filter", f"WITH m AS ({META}), p AS (SELECT DISTINCT l_partkey AS target, 1 + l_suppkey % 50 AS base FROM lineitem), b AS (SELECT max(model) AS top FROM m) SELECT CASE WHEN t.param LIKE '%layers.0.q_proj' THEN 'layers.0.q_proj' ELSE t.param END || '|' || t.shape AS key, count(*) AS pairs FROM p JOIN m t ON t.id = target JOIN m s ON s.id = base WHERE t.param LIKE '%layers.0.%' AND t.param LIKE '%layers.0.q_proj%' AND t.shape = s.shape AND t.model <> (SELECT top FROM b) AND s.model <> (SELECT top FROM b) GROUP BY 1")
def g09(spark, d):
    """Cached pairs of layer 0, of allowed models and one parameter under any prefix, both of one shape; regrouped by parameter and shape"""
    m = table(spark, d, "part").selectExpr(*[x for x in ("p_partkey AS id", "p_brand AS model", "p_size % 4 AS shape", "CASE WHEN p_partkey % 5 = 0 THEN 'language.layers.0.q_proj' WHEN p_partkey % 5 = 1 THEN 'layers.0.q_proj' WHEN p_partkey % 5 = 2 THEN 'layers.1.q_proj' WHEN p_partkey % 5 = 3 THEN 'layers.0.norm' ELSE 'layers.0.q_proj.bias' END AS param")])
    pairs = table(spark, d, "lineitem").select(F.col("l_partkey").alias("target"), (1 + F.col("l_suppkey") % 50).alias("base")).distinct()
    top = m.agg(F.max("model")).first()[0]
    got = facility.cached_pairs(pairs, m, "layers.0.q_proj", m.filter(F.col("model") != top).select("model").distinct())
    return got.groupBy("key").agg(F.count(F.lit(1)).alias("pairs"))


@query("g16_sweep")
def g16(spark, d):
    """The solvers over groups of growing size"""
    return facility.sweep(tensors(spark, d), (25, 50, 100, 200))
