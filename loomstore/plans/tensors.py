"""Queries of the tensor families. Stand-ins: an embedding's float32 bytes are a tensor, its label the group, vec_id the order of arrival; a document's text is a second payload."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import kernels as K
from ..operators import facility, planner, store
from .relational import query, table

W = 64
STREAM_FILES = 4


def tensors(spark: SparkSession, d: str, w: int = W) -> DataFrame:
    e = table(spark, d, "embeddings").select("vec_id", "label", K.floats_to_bytes()("embedding").alias("payload"))
    return e.select(F.col("label").cast("string").alias("group_key"), F.col("vec_id").alias("ord"), F.col("vec_id").alias("tensor_id"), "payload", K.sketch_udf(2, w)("payload").alias("sketch"), (F.octet_length("payload") * 8).cast("long").alias("n_bits"))


@query("k01_content_id")
def k01(spark, d):
    """K1, K2"""
    t = table(spark, d, "documents").select("doc_id", F.col("text").cast("binary").alias("b"))
    return t.select("doc_id", K.content_hash_udf()("b").alias("id"))


@query("k03_sketch")
def k03(spark, d):
    """K3-K5, K7"""
    return tensors(spark, d).select("tensor_id", F.posexplode("sketch").alias("slot", "v"))


@query("k04_sketch_by_parts")
def k04(spark, d):
    """K4: partial sketches of chunks, added up; the same as k03"""
    import numpy as np
    import pandas as pd

    def parts(it):
        for pdf in it:
            cut = [(i, c, p[c : c + 128]) for i, p in zip(pdf.tensor_id, pdf.payload) for c in range(0, len(p), 128)]
            some = K.sketch_many([b for _, _, b in cut], 2, W, np.array([c // 2 for _, c, _ in cut], np.int64))
            # The parts of a batch are added up before they leave it, and slots of 0 stay behind.
            ids, at = np.unique([i for i, _, _ in cut], return_inverse=True)
            whole = np.zeros((len(ids), 2 * W), np.int64)
            np.add.at(whole, at, np.stack(some) if some else np.zeros((0, 2 * W), np.int64))
            row, slot = np.nonzero(whole)
            yield pd.DataFrame({"tensor_id": ids[row].astype(np.int64), "slot": slot.astype(np.int32), "v": whole[row, slot]})

    return tensors(spark, d).select("tensor_id", "payload").mapInPandas(parts, "tensor_id long, slot int, v long").groupBy("tensor_id", "slot").agg(F.sum("v").alias("v")).filter("v <> 0")


PAIRS = "SELECT a.vec_id AS x, b.vec_id AS y, a.embedding AS ea, b.embedding AS eb FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1"


def pairs(spark, d):
    a = table(spark, d, "embeddings").select(F.col("vec_id").alias("x"), K.floats_to_bytes()("embedding").alias("pa"))
    return a.join(a.select((F.col("x") - 1).alias("x"), F.col("x").alias("y"), F.col("pa").alias("pb")), "x")


@query("k08_hamming")
def k08(spark, d):
    """K8, B21, B22"""
    return pairs(spark, d).select("x", "y", K.hamming_udf()("pa", "pb").alias("bits"))


@query("k09_roundtrip")
def k09(spark, d):
    """Encode against the neighbour, decode, compare"""
    e = pairs(spark, d).withColumn("delta", K.delta_udf(4)("pa", "pb"))
    return e.select("x", "y", (F.octet_length("delta") / F.octet_length("pa")).alias("stored_fraction"), (K.undelta_udf(4)("delta", "pb") == F.col("pa")).alias("same"))


@query("k14_plane_codec")
def k14(spark, d):
    """Any item size, base or none"""

    def f(a, b):
        z = [(K.encode_planes(a, x, item, bf), x, item, bf) for x in (None, b) for item, bf in ((1, False), (2, True), (4, False))]
        assert all(K.decode_planes(blob, x, item, len(a), bf) == a for blob, x, item, bf in z)
        return min(len(blob) for blob, *_ in z)

    return pairs(spark, d).select("x", "y", K._udf("int", f)("pa", "pb").alias("best_bytes"))


@query("f19_byte_entropy", "WITH t AS (SELECT doc_id, unnest(regexp_extract_all(hex(encode(text)), '..')) AS b FROM documents WHERE doc_id % 1 = 0), c AS (SELECT doc_id, b, count(*) AS n FROM t GROUP BY 1, 2), s AS (SELECT doc_id, n, sum(n) OVER (PARTITION BY doc_id) AS m FROM c) SELECT doc_id, round(-sum(n / m * log2(n / m)), 6) AS h FROM s GROUP BY 1")
def f19(spark, d):
    return table(spark, d, "documents").select("doc_id", F.round(K.entropy_udf()(F.col("text").cast("binary")), 6).alias("h"))


@query("f20_delta_entropy")
def f20(spark, d):
    """entropy of the XOR and of the wrapping difference"""
    return pairs(spark, d).select("x", "y", K._udf("double", lambda a, b: round(K.byte_entropy(K.xor_bytes(a, b)), 6))("pa", "pb").alias("xor_h"), K._udf("double", lambda a, b: round(K.byte_entropy(K.sub_u16(a, b)), 6))("pa", "pb").alias("sub_h"))


@query("e01_nearest_static")
def e01(spark, d):
    """E1, E2, C12"""
    t = tensors(spark, d)
    return planner.nearest_static(t, t.filter("ord % 10 = 0"))


@query("e04_attach")
def e04(spark, d):
    """E3-E5"""
    return planner.attach(tensors(spark, d))


@query("e06_flexsplit")
def e06(spark, d):
    return planner.flexsplit(tensors(spark, d))


@query("e08_flexsplit_raw")
def e08(spark, d):
    """E7, E8"""
    return planner.flexsplit(tensors(spark, d), keep_raw_from=0.70)


@query("e09_star")
def e09(spark, d):
    """The greedy rule with the whole table as one series for each kind of shape"""
    return planner.attach(tensors(spark, d).withColumn("group_key", F.concat(F.lit("p"), F.col("ord") % 16)))


@query("e10_strategies")
def e10(spark, d):
    return planner.strategies(tensors(spark, d))


@query("e11_batch_totals")
def e11(spark, d):
    """Plan, encode, totals by status"""
    t = tensors(spark, d)
    plan = planner.attach(t).filter("role = 'delta'")
    a, b = t.select("tensor_id", "payload"), t.select(F.col("tensor_id").alias("base_id"), F.col("payload").alias("base"))
    e = plan.join(a, "tensor_id").join(b, "base_id").withColumn("n", F.octet_length(K.delta_udf(4)("payload", "base")))
    status = F.when(F.col("tensor_id") == F.col("base_id"), "failed").when(F.col("n") >= F.octet_length("payload"), "skipped").otherwise("ok")
    return e.groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("pairs"), F.sum(F.octet_length("payload")).alias("bytes_in"), F.sum("n").alias("bytes_out"), (F.sum(F.octet_length("payload")) / F.sum("n")).alias("factor"))


@query("e13_ratio_by_param")
def e13(spark, d):
    """Predicted ratios between models that share a parameter; each model's mean against model 0. The n-th tensor of a model in order is its n-th parameter, so all of them count."""
    place = F.row_number().over(Window.partitionBy("group_key").orderBy("ord", "tensor_id"))
    t = tensors(spark, d).select(F.col("group_key").alias("model"), place.alias("param"), "sketch", "n_bits")
    a, b = t.select("param", F.col("model").alias("m"), F.col("sketch").alias("sa"), "n_bits"), t.select("param", F.col("model").alias("o"), F.col("sketch").alias("sb"))
    from ..functions.exprs import predict_ratio

    met = a.join(b, "param").filter("m <> o").withColumn("cr", predict_ratio(planner.distance("sa", "sb", F.col("n_bits"))))
    sources = met.groupBy("m", "param").agg(F.min_by("o", F.struct("cr", "o")).alias("src")).groupBy("m").agg(F.count_distinct("src").alias("sources"))
    return met.filter("o = '0'").groupBy("m").agg(F.avg("cr").alias("vs_first")).join(sources, "m", "full_outer")


@query("g06_facility")
def g06(spark, d):
    """Solvers on the groups' predicted ratios, with the cost of each recomputed by one objective"""
    return facility.compare(tensors(spark, d))


@query("a16_shards", "WITH RECURSIVE t AS (SELECT source AS model, CAST(doc_id AS VARCHAR) AS param, CAST(coalesce(octet_length(encode(text)), 0) AS BIGINT) AS n, row_number() OVER (PARTITION BY source ORDER BY CAST(doc_id AS VARCHAR)) AS rn FROM documents), c(model, param, n, rn, shard, used) AS (SELECT model, param, n, rn, 1, n FROM t WHERE rn = 1 UNION ALL SELECT t.model, t.param, t.n, t.rn, CASE WHEN used > 0 AND used + t.n > 100000 THEN shard + 1 ELSE shard END, CASE WHEN used > 0 AND used + t.n > 100000 THEN t.n ELSE used + t.n END FROM c JOIN t ON t.model = c.model AND t.rn = c.rn + 1) SELECT model, param, n AS size_bytes, shard, printf('model-%05d-of-%05d.safetensors', shard, max(shard) OVER (PARTITION BY model)) AS file FROM c")
def a16(spark, d):
    """The sequential rule of shards, by groups"""
    return facility.shards(table(spark, d, "documents").select(F.col("source").alias("model"), F.col("doc_id").cast("string").alias("param"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("size_bytes")), 100_000)


@query("g17_budget")
def g17(spark, d):
    """Pairs in hashed order, as long as the distinct payloads stay within a budget"""
    return facility.within_budget(table(spark, d, "lineitem").select(F.col("l_partkey").alias("target"), F.col("l_suppkey").alias("base")).distinct(), table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_retailprice").cast("long").alias("size")), 200_000)


@query("s01_stream_attach")
def s01(spark, d):
    """E4 over a file stream, run to its end in several micro-batches: the bases opened in one are the state that the next begins with; the same plan as e04"""
    from ..operators.lineage import settle
    from ..streaming.attach import attach_stream

    settle(spark.range(1))
    rows = tensors(spark, d).select("group_key", "ord", "tensor_id", "sketch", "n_bits")
    base = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/stream-{uuid.uuid4().hex}"
    rows = settle(rows)
    top = rows.agg(F.max("ord")).first()[0] or 0
    for i in range(STREAM_FILES):  # each arrives after the one before, and is a micro-batch of its own
        rows.filter(f"ord * {STREAM_FILES} DIV {top + 1} = {i}").repartition(1).write.mode("append").parquet(f"{base}/in")
    stream = attach_stream(spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in"))
    run = stream.writeStream.format("parquet").option("checkpointLocation", f"{base}/check").outputMode("append").trigger(availableNow=True).start(f"{base}/out")
    run.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


@query("l01_windows", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS v FROM events GROUP BY 1, 2")
def l01(spark, d):
    """Tumbling windows of a table"""
    return _hourly(table(spark, d, "events"))


def _hourly(e: DataFrame) -> DataFrame:
    return e.groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("v")).select(F.col("window.start").alias("start"), "event_type", "n", "v")


@query("s02_stream_windows", "WITH m AS (SELECT max(ts) - INTERVAL 1 HOUR AS mark FROM events) SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS v FROM events, m GROUP BY 1, 2, mark HAVING time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR <= mark")
def s02(spark, d):
    """The same windows over a file stream in several micro-batches with a watermark of an hour: a window is written once, when the watermark has passed its end; those still open at the end are not"""
    from ..operators.lineage import settle
    from ..operators.ranks import places

    base = file_root(spark, "windows")
    e = settle(places(table(spark, d, "events").select("ts", "event_type", "value"), [F.asc("ts")]))
    for i in range(STREAM_FILES):
        e.filter(f"place * {STREAM_FILES} DIV rows = {i}").select("ts", "event_type", "value").repartition(1).write.mode("append").parquet(f"{base}/in")
    rows = spark.readStream.schema(e.select("ts", "event_type", "value").schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
    stream = _hourly(rows.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "1 hour"))
    stream.writeStream.format("parquet").option("checkpointLocation", f"{base}/check").outputMode("append").trigger(availableNow=True).start(f"{base}/out").awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out").withColumn("start", F.col("start").cast(e.schema["ts"].dataType))


@query("e07_bundle")
def e07(spark, d):
    """Models as one bundle, grouped by parameter and shape, each tensor once in the order of models; bits from shape and kind of element"""
    t = tensors(spark, d).withColumn("id", K.content_hash_udf()("payload"))
    place = F.row_number().over(Window.partitionBy("group_key").orderBy("ord", "tensor_id"))
    named = t.select("id", "sketch", F.col("group_key").alias("model"), (place % 8).alias("param"), "tensor_id", F.array((F.octet_length("payload") / 4).cast("long")).alias("shape"), F.lit("float32").alias("dtype"))
    return planner.flexsplit(planner.bundle(named), keep_raw_from=0.70)


@query("g11_distances")
def g11(spark, d):
    """Solvers on distances of the sketches over the root of their bits, with ratios by the distance curve and none beyond a limit"""
    return facility.compare_distances(tensors(spark, d))


def file_root(spark: SparkSession, what: str) -> str:
    """A new folder in the shared one."""
    from ..operators.lineage import settle

    settle(spark.range(1))
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{what}-{uuid.uuid4().hex}"


def as_blobs(t: DataFrame) -> DataFrame:
    return store.raw_blobs(t.select(F.lit("float32").alias("dtype"), F.array(F.lit(64).cast("long")).alias("shape"), "payload"))


@query("a01_safetensors", "SELECT min(vec_id) AS v, 'float32' AS dtype, CAST(256 AS BIGINT) AS data_len, true AS intact FROM embeddings GROUP BY embedding")
def a01(spark, d):
    """Content-addressed files written, and scanned with a filter on names"""
    from ..sources import safetensors

    root = file_root(spark, "store")
    t = table(spark, d, "embeddings").select("vec_id", K.floats_to_bytes()("embedding").alias("payload"))
    safetensors.write_blobs(as_blobs(t), root)
    name = F.regexp_extract("file", r"([0-9a-f]{32})\.safetensors", 1)
    got = safetensors.read(spark, root).filter("name = 'tensor'").select(name.alias("id"), "dtype", "data_len", (K.content_hash_udf()("payload") == name).alias("intact"))
    names = t.groupBy("payload").agg(F.min("vec_id").alias("v")).select("v", K.content_hash_udf()("payload").alias("id"))
    return got.join(names, "id").join(safetensors.inventory(spark, root).select("id"), "id", "left_semi").drop("id")


@query("a11_headers", "SELECT label AS model, count(*) AS blobs, count(*) FILTER (v > 0) AS deltas, count(*) AS intact FROM (SELECT label, embedding, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS v FROM (SELECT min(label) AS label, embedding, min(vec_id) AS vec_id FROM embeddings GROUP BY embedding)) GROUP BY 1")
def a11(spark, d):
    """A model's tensors written as deltas against its first, found again by their headers, loaded, rebuilt"""
    from ..operators.lineage import settle
    from ..sources import safetensors

    root = file_root(spark, "blobs")
    t = table(spark, d, "embeddings").select("label", "vec_id", K.floats_to_bytes()("embedding").alias("payload"))
    one = settle(t.groupBy("payload").agg(F.min("label").alias("label"), F.min("vec_id").alias("vec_id")).withColumn("id", K.content_hash_udf()("payload")))
    first = one.groupBy("label").agg(F.min_by("id", "vec_id").alias("base"))
    pairs = one.join(first, "label").filter("id <> base").select(F.col("vec_id").alias("ord"), F.col("id").alias("target"), "base")
    safetensors.write_blobs(store.compress_pairs(pairs, settle(as_blobs(one)))[1], root)
    ids = safetensors.inventory(spark, root).select("id")
    heads = settle(safetensors.headers(spark, ids, root))
    back = store.reconstruct(settle(safetensors.load(spark, ids, root)))
    out = one.select("label", "id").join(heads.withColumnRenamed("tensor_id", "id"), "id").join(back.select("id", "status"), "id")
    return out.groupBy(F.col("label").alias("model")).agg(F.count(F.lit(1)).alias("blobs"), F.count("base_id").alias("deltas"), F.count(F.when(F.col("status") == "ok", 1)).alias("intact"))


SHARDED = "WITH RECURSIVE t AS (SELECT label AS model, lpad(CAST(vec_id AS VARCHAR), 9, '0') AS param, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS rn FROM embeddings), c AS (SELECT model, param, 1 + (rn - 1) // 16 AS shard FROM t)"


@query("a15_pull", f"{SHARDED} SELECT CAST(model AS VARCHAR) AS model, count(*) AS params, CAST(count(*) * 256 AS BIGINT) AS bytes, count(DISTINCT shard) AS files, count(*) AS same FROM c GROUP BY 1")
def a15(spark, d):
    """Models written to files of 4096 bytes of tensors at most, in order of parameter, with an index; read back by the index"""
    from ..sources import safetensors

    root = file_root(spark, "models")
    t = table(spark, d, "embeddings").select(F.col("label").cast("string").alias("model"), F.lpad(F.col("vec_id").cast("string"), 9, "0").alias("param"), K.floats_to_bytes()("embedding").alias("payload"))
    places = facility.shards(t.select("model", "param", F.octet_length("payload").cast("long").alias("size_bytes")), 4096)
    whole = t.join(places.select("model", "param", "file"), ["model", "param"]).select("model", "param", F.lit("float32").alias("dtype"), F.array(F.lit(64).cast("long")).alias("shape"), "payload", "file")
    safetensors.write_models(whole, root)
    got = safetensors.read(spark, root).select(F.element_at(F.split("file", "/"), -2).alias("model"), F.element_at(F.split("file", "/"), -1).alias("file"), F.col("name").alias("param"), F.col("payload").alias("back"))
    index = spark.read.option("wholetext", True).option("pathGlobFilter", "*.index.json").option("recursiveFileLookup", "true").text(root)
    body = F.from_json("value", "metadata struct<total_size: long>, weight_map map<string, string>")
    listed = index.select(body.alias("b")).select(F.explode("b.weight_map").alias("param", "listed"))
    met = t.join(got, ["model", "param"]).join(listed, "param", "left")
    ok = (F.col("payload") == F.col("back")) & (F.coalesce("listed", "file") == F.col("file"))
    return met.groupBy("model").agg(F.count(F.lit(1)).alias("params"), F.sum(F.octet_length("back")).cast("long").alias("bytes"), F.count_distinct("file").alias("files"), F.count(F.when(ok, 1)).alias("same"))
