"""Queries of the catalog and evaluation families on the stand-in tables, each with the same query in DuckDB SQL.

There are no tensor tables among the inputs. ``lineitem`` stands in for compression results (order = target, part =
base, extended price = bytes in, discount = ratio, tax = second ratio), ``part`` names stand in for parameter
names, ``orders`` for the trace of models, ``customer`` for the hub's models.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..functions import kernels as K
from ..operators import graph, ranks
from ..operators.lineage import settle

QUERIES, ORACLES = {}, {}


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return put


def r(c, digits: int = 6):
    return F.round(c, digits)


LAYER = "CASE WHEN l_linenumber = 1 THEN 'model.layers.3.self_attn.Q_proj.weight' WHEN l_linenumber = 2 THEN 'layers.7.k_proj' WHEN l_linenumber = 3 THEN 'mlp.gate_up.bias' WHEN l_linenumber = 4 THEN 'final_NORM' WHEN l_linenumber = 5 THEN 'embed_out' WHEN l_linenumber = 6 THEN 'mlp.fc1' ELSE 'model.layers.12.input_layernorm.weight' END"
KIND = " ".join(["CASE", *(f"WHEN {' OR '.join(f'name ILIKE {chr(39)}{p}{chr(39)}' for p in ps)} THEN '{k}'" for k, ps in X.LAYER_PATTERNS), "ELSE 'other' END"])
RESULTS = f"SELECT l_orderkey AS target, l_partkey AS base, {LAYER} AS name, l_extendedprice AS bytes_in, CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE l_discount END AS ratio, CASE WHEN l_linenumber % 2 = 0 THEN NULL ELSE l_tax END AS zratio, l_discount * 0.5 AS aratio, l_quantity AS q FROM lineitem"


def results(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").selectExpr("l_orderkey AS target", "l_partkey AS base", f"{LAYER} AS name", "l_extendedprice AS bytes_in", "CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE l_discount END AS ratio", "CASE WHEN l_linenumber % 2 = 0 THEN NULL ELSE l_tax END AS zratio", "l_discount * 0.5D AS aratio", "l_quantity AS q")


# -- B: expressions ---------------------------------------------------------------------------------


@query("b01_layer_type", f"SELECT kind, count(*) AS n FROM (SELECT {KIND} AS kind FROM ({RESULTS})) GROUP BY kind")
def b01(spark, d):
    """B1: counted by name, then by kind"""
    names = results(spark, d).groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    return names.groupBy(X.layer_type(F.col("name")).alias("kind")).agg(F.sum("n").alias("n"))


@query("b02_null_filter", f"SELECT count(*) AS n, round(sum(ratio), 4) AS s FROM ({RESULTS}) WHERE zratio IS NOT NULL AND ratio IS NOT NULL")
def b02(spark, d):
    return results(spark, d).filter("zratio IS NOT NULL AND ratio IS NOT NULL").agg(F.count(F.lit(1)).alias("n"), r(F.sum("ratio"), 4).alias("s"))


@query("b03_systematic_sample", "WITH t AS (SELECT greatest(1, count(*) // 500) AS step FROM events) SELECT event_id, value FROM events, t WHERE event_id % step = 0")
def b03(spark, d):
    e = table(spark, d, "events")
    step = max(1, e.count() // 500)
    return e.filter(F.col("event_id") % step == 0).select("event_id", "value")


@query("b04_name_filters", "SELECT p_partkey, p_name, ends_with(p_name, 'n') AS suffix FROM part WHERE p_name ILIKE '%A%' OR p_type ILIKE '%steel'")
def b04(spark, d):
    return table(spark, d, "part").filter(X.like_any_case(F.col("p_name"), "%A%") | X.like_any_case(F.col("p_type"), "%steel")).select("p_partkey", "p_name", F.col("p_name").endswith("n").alias("suffix"))


@query("b05_first_layer", f"SELECT target, name FROM ({RESULTS}) WHERE contains(name, 'layers.3.') OR starts_with(name, 'layers.7')")
def b05(spark, d):
    return results(spark, d).filter(F.col("name").contains("layers.3.") | F.col("name").startswith("layers.7")).select("target", "name")


@query("b06_glob", "SELECT p_partkey, p_brand FROM part WHERE p_brand GLOB 'Brand#[1-3]?'")
def b06(spark, d):
    return table(spark, d, "part").filter(X.glob(F.col("p_brand"), "Brand#[1-3]?")).select("p_partkey", "p_brand")


SIZE = "CASE p_size % 5 WHEN 0 THEN concat(p_size, 'GiB') WHEN 1 THEN concat(p_size, 'MB') WHEN 2 THEN CAST(p_size AS VARCHAR) WHEN 3 THEN concat(p_size, 'kib') ELSE concat(p_size, ' GB') END"


@query("b07_size_parse", f"WITH t AS (SELECT p_partkey, {SIZE} AS s, p_size FROM part) SELECT p_partkey, s, CAST(CASE p_size % 5 WHEN 0 THEN p_size * 1073741824::BIGINT WHEN 1 THEN p_size * 1000000::BIGINT WHEN 2 THEN p_size WHEN 3 THEN p_size * 1024::BIGINT ELSE p_size * 1000000000::BIGINT END AS BIGINT) AS bytes FROM t")
def b07(spark, d):
    return table(spark, d, "part").selectExpr("p_partkey", SIZE.replace("VARCHAR", "STRING") + " AS s").withColumn("bytes", X.parse_size(F.col("s")))


@query("b08_size_format", "WITH t AS (SELECT p_partkey, 2 * CAST(floor(p_retailprice * power(1000, p_size % 4)) AS BIGINT) + 1 AS n FROM part) SELECT p_partkey, CASE WHEN n < 1024 THEN printf('%d B', n) WHEN n < 1048576 THEN printf('%.1f KiB', n / 1024.0) WHEN n < 1073741824 THEN printf('%.1f MiB', n / 1048576.0) WHEN n < 1099511627776 THEN printf('%.1f GiB', n / 1073741824.0) ELSE printf('%.1f TiB', n / 1099511627776.0) END AS s FROM t")
def b08(spark, d):
    return table(spark, d, "part").selectExpr("p_partkey", "2 * CAST(floor(p_retailprice * power(1000, p_size % 4)) AS BIGINT) + 1 AS n").select("p_partkey", X.format_size(F.col("n")).alias("s"))


DTYPE = "CASE p_size % 4 WHEN 0 THEN 'torch.float32' WHEN 1 THEN 'bfloat16' WHEN 2 THEN 'int64' ELSE 'torch.strange' END"


@query("b09_logical_bytes", "SELECT p_partkey, CAST(p_size * (p_size % 7 + 1) AS BIGINT) AS n, CAST(p_size * (p_size % 7 + 1) * CASE p_size % 4 WHEN 0 THEN 4 WHEN 1 THEN 2 WHEN 2 THEN 8 ELSE 0 END AS BIGINT) AS bytes FROM part")
def b09(spark, d):
    """B9-B11"""
    p = table(spark, d, "part").selectExpr("p_partkey", f"{DTYPE} AS dtype", "array(CAST(p_size AS BIGINT), CAST(p_size % 7 + 1 AS BIGINT)) AS shape")
    return p.select("p_partkey", X.numel(F.col("shape")).alias("n"), X.logical_bytes(F.col("shape"), F.col("dtype")).alias("bytes"))


@query("b12_split_ref", "SELECT p_partkey, split_part(x, ':', 1) AS model, substr(x, instr(x, ':') + 1) AS param FROM (SELECT p_partkey, concat(p_brand, ':', p_name, ':', p_size) AS x FROM part)")
def b12(spark, d):
    model, param = X.split_ref(F.col("x"))
    return table(spark, d, "part").selectExpr("p_partkey", "concat(p_brand, ':', p_name, ':', p_size) AS x").select("p_partkey", model.alias("model"), param.alias("param"))


SHAPES = "CASE p_size % 4 WHEN 0 THEN concat('[', p_size, ',4]') WHEN 1 THEN concat('(', p_size, ', 4)') WHEN 2 THEN concat('[', p_size, ', ', p_partkey, ', 2]') ELSE 'bad' END"


@query("b13_shapes", f"WITH t AS (SELECT p_partkey, CAST(regexp_extract_all({SHAPES}, '[0-9]+') AS BIGINT[]) AS shape FROM part) SELECT p_partkey, len(shape) AS dims, CAST(list_aggregate(list_concat([1], shape), 'product') AS BIGINT) AS n, CAST(to_json(shape) AS VARCHAR) AS text FROM t")
def b13(spark, d):
    """Shapes read from two notations (others have no dimensions), their elements, and written again without spaces"""
    p = table(spark, d, "part").selectExpr("p_partkey", f"{SHAPES} AS s").withColumn("shape", X.parse_shape(F.col("s")))
    return p.select("p_partkey", F.size("shape").alias("dims"), X.numel(F.col("shape")).alias("n"), F.to_json("shape").alias("text"))


P_GRID = "WITH g AS (SELECT l_orderkey AS k, l_linenumber AS i, l_quantity / 100.0 AS p FROM lineitem)"
H = "(CASE WHEN {p} > 1e-15 AND {p} < 1 - 1e-15 THEN -{p} * log2({p}) - (1 - {p}) * log2(1 - {p}) ELSE 0 END)"


@query("b14_binary_entropy", f"{P_GRID} SELECT k, i, round({H.format(p='p')}, 9) AS h FROM g")
def b14(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("i"), (F.col("l_quantity") / 100).alias("p")).select("k", "i", r(X.binary_entropy(F.col("p")), 9).alias("h"))


@query("b15_predict_ratio", f"{P_GRID}, c AS (SELECT k, i, least(p, 0.5) AS p FROM g), t AS (SELECT k, i, p, 8 * {H.format(p='p')} AS t FROM c) SELECT k, i, round(greatest(0, least(1, -23.727944 * p + 0.522466 * t + 1.966862 * p * t - 0.043132)), 9) AS cr, round(greatest(0, least(1, -6.0383 * p + 0.1553 * t + 0.6240 * p * t + 0.0135)), 9) AS refit FROM t")
def b15(spark, d):
    g = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("i"), (F.col("l_quantity") / 100).alias("p"))
    return g.select("k", "i", r(X.predict_ratio(F.col("p")), 9).alias("cr"), r(X.predict_ratio(F.col("p"), X.REFIT), 9).alias("refit"))


@query("b16_poly2", f"{P_GRID}, t AS (SELECT k, i, 8 * {H.format(p='p')} AS t FROM g) SELECT k, i, round(0.1 + 0.2 * t - 0.01 * t * t, 9) AS y FROM t")
def b16(spark, d):
    g = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("i"), (F.col("l_quantity") / 100).alias("p"))
    return g.select("k", "i", r(X.poly2(F.col("p"), (0.1, 0.2, -0.01)), 9).alias("y"))


@query("b17_curve", "WITH g AS (SELECT l_orderkey AS k, l_linenumber AS i, l_quantity / 10000.0 AS x FROM lineitem), c AS (SELECT *, 0.653618 * (1 - exp(-power(8.75e-4 / 1.34e-4, 0.496238))) AS knee, 0.742603 + (1.037701 - 0.742603) * (1 - exp(-8.75e-4 / 2.942e-3)) AS hk FROM g), y AS (SELECT *, CASE WHEN x <= 8.75e-4 THEN 0.653618 * (1 - exp(-power(x / 1.34e-4, 0.496238))) ELSE 0.742603 + (1.037701 - 0.742603) * (1 - exp(-x / 2.942e-3)) - hk + knee END AS y FROM c) SELECT k, i, round(greatest(least(0, knee, 0.742603 - hk + knee), least(greatest(0.653618, (1.037701 - 0.742603) * exp(-8.75e-4 / 2.942e-3) + knee), y)), 9) AS ratio FROM y")
def b17(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("i"), r(X.curve_ratio(F.col("l_quantity") / 10000), 9).alias("ratio"))


@query("b20_zigzag", "SELECT o_orderkey, CAST(CASE WHEN v >= 0 THEN 2 * v ELSE -2 * v - 1 END AS INT) AS z, CAST(v AS INT) AS back FROM (SELECT o_orderkey, o_custkey % 65536 - 32768 AS v FROM orders)")
def b20(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", (F.col("o_custkey") % 65536 - 32768).cast("int").alias("v"))
    return o.withColumn("z", X.zigzag(F.col("v"))).select("o_orderkey", "z", X.unzigzag(F.col("z")).alias("back"))


@query("b22_zero_bits", "SELECT o_orderkey, round(1 - bit_count(xor(o_custkey, o_orderkey)) / 64.0, 9) AS zeros FROM orders")
def b22(spark, d):
    return table(spark, d, "orders").select("o_orderkey", r(1 - F.bit_count(F.col("o_custkey").bitwiseXOR(F.col("o_orderkey"))) / 64, 9).alias("zeros"))


@query("b23_short_names", f"SELECT DISTINCT name, CASE name WHEN 'model.layers.3.self_attn.Q_proj.weight' THEN 'layer3.attn.Q_proj' WHEN 'layers.7.k_proj' THEN 'layer7.k' WHEN 'mlp.gate_up.bias' THEN 'mlp.gate_up.b' WHEN 'model.layers.12.input_layernorm.weight' THEN 'layer12.in_ln' ELSE name END AS short, regexp_replace(name, '[^A-Za-z0-9._-]', '_', 'g') AS file FROM ({RESULTS})")
def b23(spark, d):
    """B23, B24"""
    return results(spark, d).select("name").distinct().select("name", X.short_name(F.col("name")).alias("short"), X.safe_file_name(F.col("name")).alias("file"))


@query("b25_year_fraction", "SELECT o_orderkey, round(year(o_orderdate) + (month(o_orderdate) - 1) / 12.0, 6) AS y FROM orders")
def b25(spark, d):
    return table(spark, d, "orders").select("o_orderkey", r(X.year_fraction(F.col("o_orderdate"))).alias("y"))


@query("b26_family_filter", "SELECT lower(c_mktsegment) AS family, count(*) AS n FROM customer WHERE lower(c_mktsegment) <> 'building' GROUP BY 1 HAVING count(*) >= 10")
def b26(spark, d):
    """B26, F28"""
    c = table(spark, d, "customer").filter(F.lower("c_mktsegment") != "building")
    return c.groupBy(F.lower("c_mktsegment").alias("family")).agg(F.count(F.lit(1)).alias("n")).filter("n >= 10")


@query("b27_theoretical", f"SELECT target, base, round(coalesce(zratio, 0) / 8, 9) AS a, round((coalesce(zratio, 0) + coalesce(ratio, 0)) / 16, 9) AS b FROM ({RESULTS})")
def b27(spark, d):
    return results(spark, d).select("target", "base", r(X.bits_to_ratio(F.col("zratio")), 9).alias("a"), r((X.bits_to_ratio(F.col("zratio")) + X.bits_to_ratio(F.col("ratio"))) / 2, 9).alias("b"))


@query("b28_blob_ids", "SELECT page_id, url NOT LIKE '%/%' AS ok, substr(url, 9, 6) NOT LIKE '%/%' AND substr(url, 9, 6) NOT LIKE '%..%' AND length(substr(url, 9, 6)) > 0 AS part_ok FROM pages")
def b28(spark, d):
    return table(spark, d, "pages").select("page_id", X.valid_blob_id(F.col("url")).alias("ok"), X.valid_blob_id(F.substring("url", 9, 6)).alias("part_ok"))


# -- C: joins -----------------------------------------------------------------------------------------


@query("c01_inner", "SELECT l_orderkey, l_linenumber, p_name FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size < 10")
def c01(spark, d):
    return table(spark, d, "lineitem").join(table(spark, d, "part").filter("p_size < 10"), F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", "l_linenumber", "p_name")


@query("c02_left", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus = 'P') ON c_custkey = o_custkey")
def c02(spark, d):
    return table(spark, d, "customer").join(table(spark, d, "orders").filter("o_orderstatus = 'P'"), F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "o_orderkey")


@query("c03_left_first", "SELECT c_custkey, o_orderkey FROM (SELECT c_custkey, o_orderkey, row_number() OVER (PARTITION BY c_custkey ORDER BY o_orderdate, o_orderkey) AS r FROM customer LEFT JOIN orders ON c_custkey = o_custkey) WHERE r = 1")
def c03(spark, d):
    """C3, H7"""
    first = table(spark, d, "orders").groupBy("o_custkey").agg(F.min_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("o_orderkey"))
    return table(spark, d, "customer").join(first, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "o_orderkey")


@query("c04_semi", "SELECT p_partkey, p_size FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 48)")
def c04(spark, d):
    return table(spark, d, "part").join(table(spark, d, "lineitem").filter("l_quantity > 48").select(F.col("l_partkey").alias("p_partkey")), "p_partkey", "left_semi").select("p_partkey", "p_size")


@query("c05_orphans_anti", "SELECT p_partkey AS tensor_id FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)")
def c05(spark, d):
    return graph.orphans(table(spark, d, "part").select(F.col("p_partkey").alias("tensor_id")), table(spark, d, "lineitem").filter("l_quantity > 45").select(F.col("l_partkey").alias("tensor_id")))


@query("c06_double_semi", "WITH s AS (SELECT p_partkey AS id FROM part WHERE p_size <= 25) SELECT l_orderkey, l_partkey, l_suppkey FROM lineitem WHERE l_partkey IN (SELECT id FROM s) AND l_suppkey IN (SELECT id FROM s)")
def c06(spark, d):
    s = table(spark, d, "part").filter("p_size <= 25").select(F.col("p_partkey").alias("id"))
    li = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey")
    return li.join(s, F.col("l_partkey") == F.col("id"), "left_semi").join(s, F.col("l_suppkey") == F.col("id"), "left_semi")


@query("c07_double_inner", "SELECT l_orderkey, a.p_size AS target_size, b.p_size AS base_size FROM lineitem JOIN part a ON l_partkey = a.p_partkey JOIN part b ON l_suppkey = b.p_partkey WHERE a.p_size > 40 AND b.p_size > 40")
def c07(spark, d):
    p = table(spark, d, "part").filter("p_size > 40")
    a, b = (p.select(F.col("p_partkey").alias(k), F.col("p_size").alias(s)) for k, s in (("l_partkey", "target_size"), ("l_suppkey", "base_size")))
    return table(spark, d, "lineitem").join(a, "l_partkey").join(b, "l_suppkey").select("l_orderkey", "target_size", "base_size")


@query("c09_dedup_first", "SELECT sha256(text) AS id, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY 1")
def c09(spark, d):
    """C9, D1, I9"""
    return table(spark, d, "documents").groupBy(F.sha2("text", 256).alias("id")).agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"))


@query("c10_two_key_lookup", "WITH s AS (SELECT l_orderkey, l_partkey, max(l_quantity) AS q FROM lineitem GROUP BY 1, 2) SELECT l.l_orderkey, l.l_linenumber, s.q FROM lineitem l JOIN s ON l.l_orderkey = s.l_orderkey AND l.l_partkey = s.l_partkey")
def c10(spark, d):
    li = table(spark, d, "lineitem")
    return li.join(li.groupBy("l_orderkey", "l_partkey").agg(F.max("l_quantity").alias("q")), ["l_orderkey", "l_partkey"]).select("l_orderkey", "l_linenumber", "q")


@query("c11_pairs_in_group", "SELECT a.n_regionkey AS g, a.n_nationkey AS i, b.n_nationkey AS j FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey <> b.n_nationkey")
def c11(spark, d):
    n = table(spark, d, "nation")
    a, b = (n.select(F.col("n_regionkey").alias("g"), F.col("n_nationkey").alias(k)) for k in "ij")
    return a.join(b, "g").filter("i <> j")


MONTHS = "WITH o AS (SELECT (year(o_orderdate) - 1992) * 12 + month(o_orderdate) AS m, sum(o_totalprice) AS v FROM orders GROUP BY 1), k AS (SELECT m, v FROM o WHERE m % 3 = 0), a AS (SELECT m FROM o)"


@query("c13_interp", MONTHS + ", x AS (SELECT a.m, (SELECT max(m) FROM k WHERE k.m <= a.m) AS lo, (SELECT min(m) FROM k WHERE k.m >= a.m) AS hi FROM a), e AS (SELECT min(m) AS first, max(m) AS last FROM k), y AS (SELECT x.m, coalesce(lo, first) AS lo, coalesce(hi, last) AS hi FROM x, e) SELECT CAST(y.m AS INT) AS m, round(l.v + CASE WHEN h.m = l.m THEN 0 ELSE (h.v - l.v) * (y.m - l.m) / (h.m - l.m) END, 2) AS v FROM y JOIN k l ON l.m = y.lo JOIN k h ON h.m = y.hi")
def c13(spark, d):
    """Linear interpolation of one series at another's steps, ends held: the last known before and the first after, by windows."""
    o = table(spark, d, "orders").groupBy(((F.year("o_orderdate") - 1992) * 12 + F.month("o_orderdate")).alias("m")).agg(F.sum("o_totalprice").alias("v"))
    known = F.when(F.col("m") % 3 == 0, F.struct("m", "v"))
    back, ahead = Window.orderBy("m").rowsBetween(Window.unboundedPreceding, 0), Window.orderBy("m").rowsBetween(0, Window.unboundedFollowing)
    x = o.withColumn("lo", F.last(known, True).over(back)).withColumn("hi", F.first(known, True).over(ahead))  # as many rows as months
    lo, hi = F.coalesce("lo", "hi"), F.coalesce("hi", "lo")
    y = F.when(lo["m"] == hi["m"], lo["v"]).otherwise(lo["v"] + (hi["v"] - lo["v"]) * (F.col("m") - lo["m"]) / (hi["m"] - lo["m"]))
    return x.select("m", r(y, 2).alias("v"))


@query("c14_fill_align", "WITH a AS (SELECT day(ts) AS t, count(*) AS x FROM events WHERE event_id % 7 = 0 AND day(ts) % 2 = 0 GROUP BY 1), b AS (SELECT day(ts) AS t, count(*) AS y FROM events WHERE day(ts) % 3 = 0 GROUP BY 1), u AS (SELECT coalesce(a.t, b.t) AS t, x, y FROM a FULL JOIN b ON a.t = b.t) SELECT CAST(t AS INT) AS t, coalesce(last_value(x IGNORE NULLS) OVER w, 0) AS x, coalesce(last_value(y IGNORE NULLS) OVER w, 0) AS y FROM u WINDOW w AS (ORDER BY t ROWS UNBOUNDED PRECEDING)")
def c14(spark, d):
    """C14, H4, I8"""
    e = table(spark, d, "events").withColumn("t", F.dayofmonth("ts"))
    a = e.filter("event_id % 7 = 0 AND t % 2 = 0").groupBy("t").agg(F.count(F.lit(1)).alias("x"))
    b = e.filter("t % 3 = 0").groupBy("t").agg(F.count(F.lit(1)).alias("y"))
    w = Window.orderBy("t").rowsBetween(Window.unboundedPreceding, 0)  # a row for each step of the grid
    zero = F.lit(0).cast("long")
    return a.join(b, "t", "full_outer").select("t", F.coalesce(F.last("x", True).over(w), zero).alias("x"), F.coalesce(F.last("y", True).over(w), zero).alias("y"))


@query("c15_fallback_lookup", "WITH a AS (SELECT l_orderkey AS k, min(l_tax) AS v FROM lineitem WHERE l_quantity > 40 GROUP BY 1), b AS (SELECT l_orderkey AS k, max(l_discount) AS v FROM lineitem WHERE l_quantity > 20 GROUP BY 1) SELECT o_orderkey, round(coalesce(a.v, b.v, o_totalprice / 1000000), 9) AS v FROM orders LEFT JOIN a ON o_orderkey = a.k LEFT JOIN b ON o_orderkey = b.k")
def c15(spark, d):
    li = table(spark, d, "lineitem")
    a = li.filter("l_quantity > 40").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min("l_tax").alias("a"))
    b = li.filter("l_quantity > 20").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_discount").alias("b"))
    return table(spark, d, "orders").join(a, "o_orderkey", "left").join(b, "o_orderkey", "left").select("o_orderkey", r(F.coalesce("a", "b", F.col("o_totalprice") / 1000000), 9).alias("v"))


@query("c16_set_overlap", "SELECT DISTINCT l_partkey FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def c16(spark, d):
    keep = table(spark, d, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("l_orderkey"))
    return table(spark, d, "lineitem").join(keep, "l_orderkey", "left_semi").select("l_partkey").distinct()


# -- D: catalog -----------------------------------------------------------------------------------------


@query("d01_upsert", "SELECT s_suppkey AS id, CASE WHEN s_suppkey % 5 = 0 THEN s_acctbal + 1 ELSE s_acctbal END AS v FROM supplier UNION ALL SELECT s_suppkey + 1000000, s_acctbal + 1 FROM supplier WHERE s_suppkey % 5 = 1")
def d01(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("v"))
    new = s.filter("id % 5 < 2").select(F.when(F.col("id") % 5 == 1, F.col("id") + 1000000).otherwise(F.col("id")).alias("id"), (F.col("v") + 1).alias("v"))
    return graph.latest(s, new, ["id"])


@query("d05_gc_once", "WITH t AS (SELECT doc_id AS id FROM documents), m AS (SELECT id FROM t WHERE id % 3 = 0), e AS (SELECT id, id // 2 AS base FROM t WHERE id % 5 = 1) SELECT id AS tensor_id FROM t WHERE id IN (SELECT id FROM m) OR id IN (SELECT base FROM e)")
def d05(spark, d):
    t = table(spark, d, "documents").select(F.col("doc_id").alias("tensor_id"))
    return graph.gc_once(t, t.filter("tensor_id % 3 = 0"), t.filter("tensor_id % 5 = 1").selectExpr("tensor_id", "tensor_id DIV 2 AS base_id"))


@query("d06_gc_stats", "WITH t AS (SELECT doc_id AS id, n_chars FROM documents), e AS (SELECT id // 2 AS base FROM t WHERE id % 5 = 1), k AS (SELECT id FROM t WHERE id % 3 = 0 UNION SELECT base FROM e) SELECT count(*) AS deleted, CAST(sum(n_chars) AS BIGINT) AS freed, (SELECT count(DISTINCT base) FROM e) AS protected FROM t WHERE id NOT IN (SELECT id FROM k)")
def d06(spark, d):
    """D6, F5"""
    t = table(spark, d, "documents").select(F.col("doc_id").alias("tensor_id"), "n_chars")
    e = t.filter("tensor_id % 5 = 1").selectExpr("tensor_id", "tensor_id DIV 2 AS base_id")
    gone = t.join(graph.gc_once(t, t.filter("tensor_id % 3 = 0"), e).select("tensor_id"), "tensor_id", "left_anti")
    return gone.agg(F.count(F.lit(1)).alias("deleted"), F.sum("n_chars").alias("freed")).crossJoin(e.agg(F.count_distinct("base_id").alias("protected")))  # one row with one row


@query("d08_closure", "WITH RECURSIVE c(id, hop) AS (SELECT doc_id, 0 FROM documents WHERE doc_id % 97 = 5 UNION SELECT id // 2, hop + 1 FROM c WHERE id > 0) SELECT id AS tensor_id, min(hop) AS hop FROM c GROUP BY 1")
def d08(spark, d):
    """D8, D11"""
    t = table(spark, d, "documents").select(F.col("doc_id").alias("tensor_id"))
    edges = t.filter("tensor_id > 0").selectExpr("tensor_id", "tensor_id DIV 2 AS base_id")
    return graph.closure(edges, t.filter("tensor_id % 97 = 5"))


@query("d12_manifest_sync", "SELECT doc_id, n_chars FROM documents WHERE NOT (doc_id % 2 = 0 AND n_chars % 3 > 0)")
def d12(spark, d):
    """Rows of a manifest that the local catalog lacks or has otherwise"""
    m = table(spark, d, "documents").select("doc_id", "n_chars")
    local = m.filter("doc_id % 2 = 0").select("doc_id", F.when(F.col("n_chars") % 3 == 0, -1).otherwise(F.col("n_chars")).alias("n_chars"))
    return m.join(local, ["doc_id", "n_chars"], "left_anti")


# -- F: aggregates ----------------------------------------------------------------------------------------


@query("f01_counts", "SELECT count(*) AS tensors, count(DISTINCT source) AS models FROM documents")
def f01(spark, d):
    return table(spark, d, "documents").agg(F.count(F.lit(1)).alias("tensors"), F.count_distinct("source").alias("models"))


@query("f02_group_histogram", "SELECT label, count(*) AS n FROM embeddings GROUP BY label")
def f02(spark, d):
    return table(spark, d, "embeddings").groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query("f03_footprint", "WITH m AS (SELECT DISTINCT source AS model, sha256(text) AS id, octet_length(encode(text)) AS b FROM documents) SELECT model, CAST(sum(b) AS BIGINT) AS bytes, count(*) AS tensors FROM m GROUP BY model")
def f03(spark, d):
    """F3, C4"""
    x = table(spark, d, "documents").select(F.col("source").alias("model"), F.sha2("text", 256).alias("tensor_id"), F.octet_length("text").cast("long").alias("size_bytes"))
    return graph.footprint(x.select("tensor_id", "size_bytes").distinct(), x.select("model", "tensor_id"))


@query("f04_unique_params", "SELECT source, count(DISTINCT text) AS uniq, count(*) AS mapped FROM documents GROUP BY source")
def f04(spark, d):
    return table(spark, d, "documents").groupBy("source", F.xxhash64("text").alias("t"), F.sha2("text", 256)).agg(F.count(F.lit(1)).alias("n")).groupBy("source").agg(F.count(F.lit(1)).alias("uniq"), F.sum("n").alias("mapped"))


@query("f06_avg_by_layer", f"WITH t AS (SELECT {KIND} AS kind, * FROM ({RESULTS})) SELECT kind, count(*) AS n, round(avg(ratio), 6) AS ratio, round(avg(zratio), 6) AS zratio, round(avg(aratio), 6) AS aratio, row_number() OVER (ORDER BY kind = 'other', kind = 'norm', count(*) DESC, kind) AS place FROM t GROUP BY kind")
def f06(spark, d):
    """Others last, norms before them"""
    cols = ("ratio", "zratio", "aratio")
    names = results(spark, d).groupBy("name").agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(f"s_{c}") for c in cols], *[F.count(c).alias(f"n_{c}") for c in cols])
    g = names.groupBy(X.layer_type(F.col("name")).alias("kind")).agg(F.sum("n").alias("n"), *[r(F.sum(f"s_{c}") / F.nullif(F.sum(f"n_{c}"), F.lit(0))).alias(c) for c in cols])
    w = Window.orderBy(F.col("kind") == "other", F.col("kind") == "norm", F.desc("n"), "kind")  # a row for each kind
    return g.withColumn("place", F.row_number().over(w).cast("long"))


# Fixed rule: which ratio counts, by the size of the input.
PICK = "coalesce(CASE WHEN bytes_in < 10240 THEN zratio ELSE aratio END, aratio, zratio)"


@query("f07_weighted_null", f"WITH t AS (SELECT {KIND} AS kind, * FROM ({RESULTS})) SELECT kind, round(sum(ratio * bytes_in) / sum(bytes_in), 6) AS ratio, round(sum({PICK} * bytes_in) / sum(bytes_in), 6) AS best FROM t GROUP BY kind")
def f07(spark, d):
    """The weight of a row counts even where its value is null"""
    names = results(spark, d).groupBy("name").agg(F.sum("bytes_in").alias("w"), F.sum(F.col("ratio") * F.col("bytes_in")).alias("ratio"), F.sum(F.expr(PICK) * F.col("bytes_in")).alias("best"))
    w = F.sum("w")
    return names.groupBy(X.layer_type(F.col("name")).alias("kind")).agg(r(F.sum("ratio") / w).alias("ratio"), r(F.sum("best") / w).alias("best"))


@query("f08_merge", f"WITH t AS (SELECT {KIND} AS kind, * FROM ({RESULTS})), a AS (SELECT kind, sum(aratio * bytes_in) / sum(bytes_in) AS v FROM t GROUP BY 1), b AS (SELECT kind, sum(aratio * bytes_in) / sum(bytes_in) AS v FROM t WHERE zratio IS NOT NULL GROUP BY 1) SELECT a.kind, round(CASE WHEN a.kind IN ('norm', 'other') THEN coalesce(b.v, a.v) ELSE a.v END, 6) AS v FROM a LEFT JOIN b ON a.kind = b.kind")
def f08(spark, d):
    """Both variants in one pass"""
    t = X.layer_types(results(spark, d))
    some = F.col("zratio").isNotNull()
    g = t.groupBy("kind").agg((F.sum(F.expr("aratio * bytes_in")) / F.sum("bytes_in")).alias("a"), (F.sum(F.when(some, F.expr("aratio * bytes_in"))) / F.sum(F.when(some, F.col("bytes_in")))).alias("b"))
    return g.select("kind", r(F.when(F.col("kind").isin("norm", "other"), F.coalesce("b", "a")).otherwise(F.col("a"))).alias("v"))


@query("f09_ablation_row", f"SELECT round(avg(ratio), 6) AS ratio, round(avg(zratio), 6) AS zratio, round(avg(aratio), 6) AS aratio, round(avg(bytes_in), 4) AS bytes_in, count(*) AS n, count(zratio) AS with_z FROM ({RESULTS})")
def f09(spark, d):
    return results(spark, d).agg(*[r(F.avg(c)).alias(c) for c in ("ratio", "zratio", "aratio")], r(F.avg("bytes_in"), 4).alias("bytes_in"), F.count(F.lit(1)).alias("n"), F.count("zratio").alias("with_z"))


@query("f10_hist2d", "WITH m AS (SELECT min(l_quantity) AS x0, max(l_quantity) AS x1, min(l_extendedprice) AS y0, max(l_extendedprice) AS y1 FROM lineitem) SELECT CAST(least(119, floor((l_quantity - x0) / (x1 - x0) * 120)) AS INT) AS bx, CAST(least(119, floor((l_extendedprice - y0) / (y1 - y0) * 120)) AS INT) AS b_y, count(*) AS n FROM lineitem, m GROUP BY 1, 2")
def f10(spark, d):
    """The last bin holds its right edge; empty bins have no row"""
    li = table(spark, d, "lineitem")
    m = li.agg(F.min("l_quantity"), F.max("l_quantity"), F.min("l_extendedprice"), F.max("l_extendedprice")).first()
    b = lambda c, lo, hi: F.least(F.lit(119), F.floor((F.col(c) - lo) / (hi - lo) * 120)).cast("int")
    return li.groupBy(b("l_quantity", m[0], m[1]).alias("bx"), b("l_extendedprice", m[2], m[3]).alias("b_y")).agg(F.count(F.lit(1)).alias("n"))


@query("f11_log_histogram", "WITH m AS (SELECT min(log10(o_totalprice)) AS lo, max(log10(o_totalprice)) AS hi FROM orders) SELECT CAST(least(49, floor((log10(o_totalprice) - lo) / (hi - lo) * 50)) AS INT) AS bin, count(*) AS n FROM orders, m GROUP BY 1")
def f11(spark, d):
    o = table(spark, d, "orders").select(F.log10("o_totalprice").alias("v"))
    lo, hi = o.agg(F.min("v"), F.max("v")).first()
    return o.groupBy(F.least(F.lit(49), F.floor((F.col("v") - lo) / (hi - lo) * 50)).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@query("f12_percentiles", "SELECT event_type, round(avg(value), 6) AS mean, round(median(value), 6) AS med, round(quantile_cont(value, 0.9), 6) AS p90, round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY event_type")
def f12(spark, d):
    """exact, by places in ranges of values; no group's values are held together"""
    e = table(spark, d, "events").select("event_type", "value")
    q = ranks.quantiles(e, "value", {"med": 0.5, "p90": 0.9, "p99": 0.99}, ["event_type"])
    mean = e.groupBy("event_type").agg(r(F.avg("value")).alias("mean"))
    return mean.join(q, "event_type", "left").select("event_type", "mean", *[r(F.col(c)).alias(c) for c in ("med", "p90", "p99")])


@query("f13_nearest_rank", "WITH t AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events) SELECT event_type, max(CASE WHEN i = least(n - 1, floor(0.5 * n)) THEN value END) AS p50, max(CASE WHEN i = least(n - 1, floor(0.99 * n)) THEN value END) AS p99 FROM t GROUP BY event_type")
def f13(spark, d):
    """the value at place min(n - 1, floor(q n))"""
    return ranks.quantiles(table(spark, d, "events"), "value", {"p50": 0.5, "p99": 0.99}, ["event_type"], nearest=True)


PRICES = "SELECT l_extendedprice / l_quantity / 1000 AS y, p_retailprice / 1000 AS x FROM lineitem JOIN part ON l_partkey = p_partkey"


def prices(spark, d):
    j = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return j.select((F.col("l_extendedprice") / F.col("l_quantity") / 1000).alias("y"), (F.col("p_retailprice") / 1000).alias("x"))


@query("f14_error_stats", f"SELECT round(avg(abs(y - x)), 6) AS mae, round(median(abs(y - x)), 6) AS medae, round(corr(x, y), 6) AS pearson FROM ({PRICES})")
def f14(spark, d):
    """the median by places in ranges"""
    t = prices(spark, d).withColumn("e", F.abs(F.col("y") - F.col("x")))
    middle = ranks.quantiles(t, "e", {"medae": 0.5})
    return t.agg(r(F.avg("e")).alias("mae"), r(F.corr("x", "y")).alias("pearson")).crossJoin(middle.select(r(F.col("medae")).alias("medae")))  # one row with one row


@query("f15_linear_fit", f"SELECT round(avg(power(y - x, 2)), 6) AS mse, round(sqrt(avg(power(y - x, 2))), 6) AS rmse, round(avg(y - x), 6) AS bias, round(regr_slope(y, x), 5) AS slope, round(regr_intercept(y, x), 5) AS intercept FROM ({PRICES})")
def f15(spark, d):
    e = F.col("y") - F.col("x")
    return prices(spark, d).agg(r(F.avg(e * e)).alias("mse"), r(F.sqrt(F.avg(e * e))).alias("rmse"), r(F.avg(e)).alias("bias"), r(F.regr_slope("y", "x"), 5).alias("slope"), r(F.regr_intercept("y", "x"), 5).alias("intercept"))


RANKS = "SELECT rank() OVER (ORDER BY s_acctbal) + (count(*) OVER (PARTITION BY s_acctbal) - 1) / 2.0 AS a, rank() OVER (ORDER BY s_nationkey) + (count(*) OVER (PARTITION BY s_nationkey) - 1) / 2.0 AS b FROM supplier"


def average_ranks(df: DataFrame, col: str) -> DataFrame:
    """H6 without one task for all rows: ranks inside ranges of values, shifted by the sizes of the ranges before."""
    counts = df.groupBy(col).agg(F.count(F.lit(1)).alias("__n"))
    ranged = counts.repartitionByRange(col).withColumn("__p", F.spark_partition_id())
    sizes = ranged.groupBy("__p").agg(F.sum("__n").alias("__all")).withColumn("__before", F.coalesce(F.sum("__all").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inside = F.coalesce(F.sum("__n").over(Window.partitionBy("__p").orderBy(col).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranks = ranged.withColumn("__i", inside).join(F.broadcast(sizes.select("__p", "__before")), "__p")
    return df.join(ranks.select(col, (F.col("__before") + F.col("__i") + (F.col("__n") + 1) / 2).alias(f"{col}_rank")), col)


@query("f16_spearman", f"SELECT round(corr(a, b), 6) AS spearman FROM ({RANKS})")
def f16(spark, d):
    """F16, H6"""
    s = average_ranks(average_ranks(table(spark, d, "supplier").select("s_acctbal", "s_nationkey"), "s_acctbal"), "s_nationkey")
    return s.agg(r(F.corr("s_acctbal_rank", "s_nationkey_rank")).alias("spearman"))


FEATURES = f"SELECT p, t, p * t AS pt, y FROM (SELECT l_quantity / 100.0 AS p, 8 * {H.format(p='(l_quantity / 100.0)')} AS t, l_discount AS y FROM lineitem)"


def gram(spark, d):
    x = table(spark, d, "lineitem").select((F.col("l_quantity") / 100).alias("p"), F.col("l_discount").alias("y")).withColumn("t", 8 * X.binary_entropy(F.col("p"))).withColumn("pt", F.col("p") * F.col("t"))
    f = {"p": F.col("p"), "t": F.col("t"), "pt": F.col("pt"), "o": F.lit(1.0)}
    names = list(f)
    sums = {f"{a}_{b}": F.sum(f[a] * f[b]) for i, a in enumerate(names) for b in names[i:]} | {f"{a}_y": F.sum(f[a] * F.col("y")) for a in names}
    return x.agg(*[v.alias(k) for k, v in sums.items()]), names


@query("f17_gram", f"SELECT round(sum(p * p), 3) AS p_p, round(sum(p * t), 3) AS p_t, round(sum(pt * pt), 2) AS pt_pt, round(sum(t * y), 3) AS t_y, round(CAST(sum(1.0) AS DOUBLE), 1) AS o_o FROM ({FEATURES})")
def f17(spark, d):
    g, _ = gram(spark, d)
    return g.select(r(F.col("p_p"), 3).alias("p_p"), r(F.col("p_t"), 3).alias("p_t"), r(F.col("pt_pt"), 2).alias("pt_pt"), r(F.col("t_y"), 3).alias("t_y"), r(F.col("o_o"), 1).alias("o_o"))


@query("f17_ols")
def f17_ols(spark, d):
    """One pass of sums; the 4 x 4 system is solved on the driver by least squares of minimum norm."""
    import numpy as np

    g, names = gram(spark, d)
    row = g.first().asDict()
    a = np.array([[row.get(f"{x}_{y}", row.get(f"{y}_{x}")) for y in names] for x in names])
    sol = np.linalg.lstsq(a, np.array([row[f"{x}_y"] for x in names]), rcond=None)[0]
    return spark.createDataFrame([tuple(float(v) for v in sol)], "a double, b double, c double, d double")


@query("f18_poly_fit")
def f18(spark, d):
    """Normal equations of a parabola; a singular system gives the line y = x"""
    import numpy as np

    x = F.col("l_quantity") / 100
    s = table(spark, d, "lineitem").agg(*[F.sum(F.pow(x, F.lit(k))) for k in range(5)], *[F.sum(F.pow(x, F.lit(k)) * F.col("l_discount")) for k in range(3)]).first()
    a = np.array([[s[i + j] for j in range(3)] for i in range(3)])
    c = np.linalg.solve(a, np.array(s[5:8])) if s[0] and abs(np.linalg.det(a)) >= 1e-30 else (0.0, 1.0, 0.0)
    return spark.createDataFrame([tuple(float(v) for v in c)], "c0 double, c1 double, c2 double")


@query("f21_length_stats", "SELECT lang, count(*) AS n, CAST(sum(octet_length(encode(text))) AS BIGINT) AS bytes, round(avg(octet_length(encode(text))), 4) AS mean, CAST(min(octet_length(encode(text))) AS INT) AS lo, CAST(max(octet_length(encode(text))) AS INT) AS hi FROM documents GROUP BY lang")
def f21(spark, d):
    b = F.octet_length("text")
    return table(spark, d, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum(b).alias("bytes"), r(F.avg(b), 4).alias("mean"), F.min(b).alias("lo"), F.max(b).alias("hi"))


@query("f22_best_pair", f"SELECT target, base, ratio FROM (SELECT target, base, ratio, row_number() OVER (PARTITION BY target ORDER BY ratio, base) AS r FROM ({RESULTS}) WHERE target <> base AND ratio IS NOT NULL AND bytes_in > 0) WHERE r = 1")
def f22(spark, d):
    """The best by an aggregate, without a sort of each group"""
    b = results(spark, d).filter("target <> base AND ratio IS NOT NULL AND bytes_in > 0").groupBy("target").agg(F.min(F.struct("ratio", "base")).alias("b"))
    return b.select("target", "b.base", "b.ratio")


@query("f23_cluster_cost", "WITH c AS (SELECT o_custkey AS cluster, o_orderkey AS target FROM orders), m AS (SELECT l_orderkey AS target, min(l_extendedprice) AS best FROM lineitem WHERE l_linenumber < 4 GROUP BY 1) SELECT cluster, round(sum(best), 2) AS cost, count(best) AS covered, count(*) AS targets FROM c LEFT JOIN m USING (target) GROUP BY cluster")
def f23(spark, d):
    m = table(spark, d, "lineitem").filter("l_linenumber < 4").groupBy(F.col("l_orderkey").alias("target")).agg(F.min("l_extendedprice").alias("best"))
    c = table(spark, d, "orders").select(F.col("o_custkey").alias("cluster"), F.col("o_orderkey").alias("target"))
    return c.join(m, "target", "left").groupBy("cluster").agg(r(F.sum("best"), 2).alias("cost"), F.count("best").alias("covered"), F.count(F.lit(1)).alias("targets"))


@query("f24_split_effect", "WITH t AS (SELECT l_orderkey AS k, sum(l_extendedprice) AS star, sum(l_extendedprice * (1 - l_discount)) AS flp, max(l_tax) AS predicted FROM lineitem GROUP BY 1) SELECT k, round(CASE WHEN star > 0 THEN (star - flp) / star ELSE predicted END, 6) AS benefit, flp < star AS better FROM t")
def f24(spark, d):
    t = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.sum("l_extendedprice").alias("star"), F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("flp"), F.max("l_tax").alias("predicted"))
    return t.select("k", r(F.when(F.col("star") > 0, (F.col("star") - F.col("flp")) / F.col("star")).otherwise(F.col("predicted"))).alias("benefit"), (F.col("flp") < F.col("star")).alias("better"))


@query("f25_subclusters", "WITH t AS (SELECT o_custkey AS k, list(CAST(o_orderkey % 5 AS BIGINT)) AS moves, CAST(count(*) * 3 AS BIGINT) AS items FROM orders GROUP BY 1), s AS (SELECT k, items - list_sum(moves) AS rest, moves FROM t) SELECT k, CAST(size AS BIGINT) AS size, count(*) AS n FROM (SELECT k, rest AS size FROM s WHERE rest > 0 UNION ALL SELECT k, unnest(moves) FROM s) GROUP BY 1, 2")
def f25(spark, d):
    """moves are rows, so no group's list is gathered"""
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("k"), (F.col("o_orderkey") % 5).alias("size"))
    rest = o.groupBy("k").agg((F.count(F.lit(1)) * 3 - F.sum("size")).alias("size")).filter("size > 0")
    return rest.unionByName(o).groupBy("k", "size").agg(F.count(F.lit(1)).alias("n"))


@query("f26_monthly_merge", "SELECT month, sum(n) AS n, sum(sum(n)) OVER (ORDER BY month) AS running FROM (SELECT strftime(ts, '%Y-%m-%d') AS month, event_type, count(*) AS n FROM events GROUP BY 1, 2) GROUP BY month".replace("sum(n) AS n", "CAST(sum(n) AS BIGINT) AS n").replace("sum(sum(n)) OVER (ORDER BY month)", "CAST(sum(sum(n)) OVER (ORDER BY month) AS BIGINT)"))
def f26(spark, d):
    """A map for each kind, exploded and summed by step"""
    e = table(spark, d, "events").groupBy("event_type", F.date_format("ts", "yyyy-MM-dd").alias("month")).agg(F.count(F.lit(1)).alias("n"))
    maps = e.groupBy("event_type").agg(F.map_from_entries(F.collect_list(F.struct("month", "n"))).alias("m"))
    g = maps.select(F.explode("m").alias("month", "n")).groupBy("month").agg(F.sum("n").alias("n"))
    return g.withColumn("running", F.sum("n").over(Window.orderBy("month").rowsBetween(Window.unboundedPreceding, 0)))


@query("f27_quintiles", "WITH t AS (SELECT c_acctbal, c_nationkey % 3 = 0 AS card, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS rn, count(*) OVER () AS n FROM customer), b AS (SELECT CAST(least(4, (rn - 1) // (n // 5)) AS VARCHAR) AS bucket, * FROM t) SELECT coalesce(bucket, 'Overall') AS bucket, count(*) AS n, round(100.0 * count(*) FILTER (card) / count(*), 6) AS complete, min(c_acctbal) AS lo, max(c_acctbal) AS hi FROM b GROUP BY ROLLUP (bucket)")
def f27(spark, d):
    """Not ntile, as the last bucket takes the remainder"""
    c = table(spark, d, "customer")
    placed = ranks.places(c.select("c_acctbal", "c_custkey", (F.col("c_nationkey") % 3 == 0).alias("card")), [F.desc("c_acctbal"), F.asc("c_custkey")])
    step = F.greatest(F.lit(1), F.floor(F.col("rows") / 5))
    b = placed.select("c_acctbal", "card", F.least(F.lit(4), F.floor(F.col("place") / step)).cast("string").alias("bucket"))
    g = b.rollup("bucket").agg(F.count(F.lit(1)).alias("n"), r(100.0 * F.count(F.when(F.col("card"), 1)) / F.count(F.lit(1))).alias("complete"), F.min("c_acctbal").alias("lo"), F.max("c_acctbal").alias("hi"))
    return g.withColumn("bucket", F.coalesce("bucket", F.lit("Overall")))


@query("f29_manifest_sums", "SELECT CAST(sum(n_chars) AS BIGINT) AS logical, CAST(sum(CASE WHEN doc_id % 3 = 0 THEN n_chars // 4 ELSE n_chars END) AS BIGINT) AS wire, count(*) FILTER (doc_id % 3 = 0) AS deltas, round(100 * (1 - sum(CASE WHEN doc_id % 3 = 0 THEN n_chars // 4 ELSE n_chars END) / sum(n_chars)), 6) AS saved FROM documents")
def f29(spark, d):
    t = table(spark, d, "documents").selectExpr("doc_id", "n_chars", "CASE WHEN doc_id % 3 = 0 THEN n_chars DIV 4 ELSE n_chars END AS w")
    return t.agg(F.sum("n_chars").alias("logical"), F.sum("w").alias("wire"), F.count(F.when(F.col("doc_id") % 3 == 0, 1)).alias("deltas"), r(100 * (1 - F.sum("w") / F.sum("n_chars"))).alias("saved"))


@query("f30_tallies", "WITH t AS (SELECT abs(l_discount - l_tax) <= 0.03 AS ok, l_returnflag AS f FROM lineitem) SELECT f, count(*) FILTER (ok) AS good, count(*) FILTER (NOT ok) AS bad, round(count(*) FILTER (ok) * 1.0 / count(*), 6) AS rate, count(*) FILTER (ok) * 1.0 / count(*) >= 0.98 AS passed FROM t GROUP BY f")
def f30(spark, d):
    t = table(spark, d, "lineitem").select((F.abs(F.col("l_discount") - F.col("l_tax")) <= 0.03).alias("ok"), F.col("l_returnflag").alias("f"))
    good, n = F.count(F.when(F.col("ok"), 1)), F.count(F.lit(1))
    return t.groupBy("f").agg(good.alias("good"), (n - good).alias("bad"), r(good / n).alias("rate"), (good / n >= 0.98).alias("passed"))


@query("f31_savings", f"SELECT target, base, round((1 - aratio) * 100, 6) AS saved FROM ({RESULTS}) WHERE bytes_in >= 50000")
def f31(spark, d):
    return results(spark, d).filter("bytes_in >= 50000").select("target", "base", r((1 - F.col("aratio")) * 100).alias("saved"))


@query("f32_weighted_ratio", f"SELECT round(sum(aratio * bytes_in) / sum(bytes_in), 8) AS predicted, round(sum(coalesce(ratio, 1) * bytes_in) / sum(bytes_in), 8) AS stored FROM ({RESULTS})")
def f32(spark, d):
    w = F.sum("bytes_in")
    return results(spark, d).agg(r(F.sum(F.col("aratio") * F.col("bytes_in")) / w, 8).alias("predicted"), r(F.sum(F.coalesce("ratio", F.lit(1.0)) * F.col("bytes_in")) / w, 8).alias("stored"))


@query("f33_fixed_histogram", "SELECT CAST(least(58, floor(v * 59)) AS INT) AS bin, count(*) AS n FROM (SELECT l_quantity / 45.0 AS v FROM lineitem) WHERE v >= 0 AND v <= 1 GROUP BY 1")
def f33(spark, d):
    v = table(spark, d, "lineitem").select((F.col("l_quantity") / 45.0).alias("v")).filter("v >= 0 AND v <= 1")
    return v.groupBy(F.least(F.lit(58), F.floor(F.col("v") * 59)).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


# -- H, I: windows, sorts, sets --------------------------------------------------------------------------


@query("h01_cdf", "WITH t AS (SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS i, count(*) OVER () AS n FROM orders) SELECT o_orderkey, round(CASE WHEN n = 1 THEN 0 ELSE i / (n - 1) END, 9) AS y FROM t WHERE i % greatest(1, n // 3000) = 0")
def h01(spark, d):
    """H1: the place in sorted order over n - 1, thinned"""
    t = ranks.places(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), [F.asc("o_totalprice"), F.asc("o_orderkey")])
    thin = F.greatest(F.lit(1), F.floor(F.col("rows") / 3000))
    return t.filter(F.col("place") % thin == 0).select("o_orderkey", r(F.when(F.col("rows") == 1, 0.0).otherwise(F.col("place") / (F.col("rows") - 1)), 9).alias("y"))


TRACE = "SELECT c_mktsegment AS family, o_orderdate, o_orderkey, o_totalprice AS v FROM orders JOIN customer ON o_custkey = c_custkey"


@query("h02_family_trace", f"SELECT o_orderkey, family, round(sum(v) OVER (PARTITION BY family, month(o_orderdate) ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING), 2) AS running, round(v - coalesce(lag(v) OVER (PARTITION BY family, month(o_orderdate) ORDER BY o_orderdate, o_orderkey), 0), 2) AS diff FROM ({TRACE})")
def h02(spark, d):
    """H2, H3, H5, G5"""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("family"))
    t = table(spark, d, "orders").join(c, "o_custkey")
    w = Window.partitionBy("family", F.month("o_orderdate")).orderBy("o_orderdate", "o_orderkey")
    v = F.col("o_totalprice")
    return t.select("o_orderkey", "family", r(F.sum(v).over(w.rowsBetween(Window.unboundedPreceding, 0)), 2).alias("running"), r(v - F.coalesce(F.lag(v).over(w), F.lit(0.0)), 2).alias("diff"))


@query("i03_hashed_sample", "SELECT o_orderkey FROM orders ORDER BY sha256(CAST(o_orderkey AS VARCHAR)), o_orderkey LIMIT 200")
def i03(spark, d):
    """A seeded shuffle by hash, first n"""
    return table(spark, d, "orders").select("o_orderkey").orderBy(F.sha2(F.col("o_orderkey").cast("string"), 256), "o_orderkey").limit(200)


@query("i08_set_operations", "SELECT k, 'both' AS s FROM (SELECT l_partkey AS k FROM lineitem WHERE l_quantity > 30 INTERSECT SELECT l_partkey FROM lineitem WHERE l_discount > 0.08) UNION ALL SELECT k, 'only' FROM (SELECT p_partkey AS k FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity > 30)")
def i08(spark, d):
    li, k = table(spark, d, "lineitem"), F.col("l_partkey").alias("k")
    a = li.filter("l_quantity > 30").select(k)
    both = a.intersect(li.filter("l_discount > 0.08").select(k)).withColumn("s", F.lit("both"))
    return both.unionByName(table(spark, d, "part").select(F.col("p_partkey").alias("k")).subtract(a).withColumn("s", F.lit("only")))


# -- G: traces that joins and windows express ------------------------------------------------------------


@query("g03_trace", "WITH o AS (SELECT o_custkey AS model, l_partkey AS tensor, min(o_orderdate) AS t FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2), f AS (SELECT tensor, min(struct_pack(t := t, m := model)) AS x FROM o GROUP BY 1), s AS (SELECT x.t AS t, x.m AS model, p_retailprice AS size, p_retailprice * (p_size / 100.0) AS stored FROM f JOIN part ON tensor = p_partkey), g AS (SELECT date_trunc('month', t) AS month, sum(size) AS size, sum(stored) AS stored FROM s GROUP BY 1) SELECT month, round(sum(size) OVER w, 2) AS original, round(sum(stored) OVER w, 2) AS stored, round(1 - sum(stored) OVER w / sum(size) OVER w, 6) AS reduction FROM g WINDOW w AS (ORDER BY month)")
def g03(spark, d):
    """Each tensor counts once, where the first model holds it; first touch is a minimum, so no sequential pass is needed"""
    li = table(spark, d, "lineitem").select("l_orderkey", F.col("l_partkey").alias("tensor"))
    first = table(spark, d, "orders").join(li, F.col("o_orderkey") == F.col("l_orderkey")).groupBy("tensor").agg(F.min("o_orderdate").alias("t"))
    p = table(spark, d, "part").select(F.col("p_partkey").alias("tensor"), F.col("p_retailprice").alias("size"), (F.col("p_retailprice") * F.col("p_size") / 100).alias("stored"))
    g = first.join(p, "tensor").groupBy(F.date_trunc("month", "t").alias("month")).agg(F.sum("size").alias("size"), F.sum("stored").alias("stored"))
    w = Window.orderBy("month").rowsBetween(Window.unboundedPreceding, 0)  # a row for each month
    a, b = F.sum("size").over(w), F.sum("stored").over(w)
    return g.select("month", r(a, 2).alias("original"), r(b, 2).alias("stored"), r(1 - b / a).alias("reduction"))


PLAN = "SELECT l_orderkey AS target, max(l_partkey) AS base, max(l_discount) * 100 AS gain FROM lineitem GROUP BY 1"


@query("g02_roles", f"WITH p AS ({PLAN}), g AS (SELECT base AS id, sum(greatest(gain, 0)) AS children FROM p GROUP BY 1), c AS (SELECT target AS id, children > greatest(gain, 0) AS forced FROM p JOIN g ON p.target = g.id) SELECT target, base FROM p WHERE target NOT IN (SELECT id FROM c WHERE forced) AND base NOT IN (SELECT id FROM c WHERE NOT forced)")
def g02(spark, d):
    """A tensor that is a target and a base stays a base if its children gain more than itself; plans that this contradicts go"""
    p = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("target")).agg(F.max("l_partkey").alias("base"), (F.max("l_discount") * 100).alias("gain"))
    children = p.groupBy(F.col("base").alias("id")).agg(F.sum(F.greatest("gain", F.lit(0.0))).alias("children"))
    both = p.join(children, p.target == children.id).select("id", (F.col("children") > F.greatest("gain", F.lit(0.0))).alias("forced"))
    forced, free = both.filter("forced").select(F.col("id").alias("target")), both.filter("NOT forced").select(F.col("id").alias("base"))
    return p.join(forced, "target", "left_anti").join(free, "base", "left_anti").select("target", "base")


@query("g07_facility_cost", "WITH r AS (SELECT s_nationkey AS g, s_suppkey AS i, s_acctbal AS size FROM supplier), b AS (SELECT g, i FROM r WHERE i % 4 = 0), c AS (SELECT r.g, r.i, r.size, min(CASE WHEN r.i = b.i THEN 1.0 ELSE abs(r.i - b.i) / 1000.0 END) AS ratio, bool_or(r.i = b.i) AS is_base FROM r LEFT JOIN b ON r.g = b.g GROUP BY 1, 2, 3) SELECT g, round(sum(CASE WHEN is_base THEN size WHEN ratio IS NULL THEN 'inf'::DOUBLE ELSE size * ratio END), 2) AS cost FROM c GROUP BY g")
def g07(spark, d):
    """Bases cost their size, others their least ratio; unreachable is infinite"""
    s = table(spark, d, "supplier").select(F.col("s_nationkey").alias("g"), F.col("s_suppkey").alias("i"), F.col("s_acctbal").alias("size"))
    b = s.filter("i % 4 = 0").select("g", F.col("i").alias("b"))
    c = s.join(b, "g", "left").groupBy("g", "i", "size").agg(F.min(F.abs(F.col("i") - F.col("b")) / 1000).alias("ratio"), F.max(F.coalesce(F.col("i") == F.col("b"), F.lit(False))).alias("is_base"))
    cost = F.when(F.col("is_base"), F.col("size")).when(F.col("ratio").isNull(), F.lit(float("inf"))).otherwise(F.col("size") * F.col("ratio"))
    return c.groupBy("g").agg(r(F.sum(cost), 2).alias("cost"))


# -- more of F, G, I: bytes of digests, per-model parts of a trace, splits -----------------------------------

PAIRS_OF = "SELECT a.doc_id AS x, b.doc_id AS y, sha256(a.text) AS ha, sha256(b.text) AS hb FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1"
BYTES = f"WITH p AS ({PAIRS_OF} WHERE a.text IS NOT NULL AND b.text IS NOT NULL), i AS (SELECT x, y, k, ('0x' || substr(ha, 2 * k + 1, 2))::INT AS a, ('0x' || substr(hb, 2 * k + 1, 2))::INT AS b FROM p, range(32) r(k))"


def digests(spark, d) -> DataFrame:
    """Neighbouring documents' digests as payloads of 32 bytes, which SQL has too"""
    t = table(spark, d, "documents").filter("text IS NOT NULL").select(F.col("doc_id").alias("x"), F.unhex(F.sha2("text", 256)).alias("a"))
    return t.join(t.select((F.col("x") - 1).alias("x"), F.col("x").alias("y"), F.col("a").alias("b")), "x")


@query("k08_hamming_digests", f"{BYTES} SELECT x, y, CAST(sum(bit_count(xor(a, b))) AS BIGINT) AS bits, round(1 - sum(bit_count(xor(a, b))) / 256.0, 9) AS zero_bits FROM i GROUP BY x, y")
def k08d(spark, d):
    """K8, B21, B22"""
    t = digests(spark, d).select("x", "y", K.hamming_udf()("a", "b").alias("bits"))
    return t.withColumn("zero_bits", r(1 - F.col("bits") / 256, 9))


@query("f20_digest_entropy", f"{BYTES}, u AS (SELECT x, y, k // 2 AS w, (((sum(a << (8 * (k % 2))) - sum(b << (8 * (k % 2)))) % 65536) + 65536) % 65536 AS v FROM i GROUP BY x, y, k // 2), s AS (SELECT x, y, 'xor' AS kind, xor(a, b) AS byte FROM i UNION ALL SELECT x, y, 'sub', v % 256 FROM u UNION ALL SELECT x, y, 'sub', v // 256 FROM u), c AS (SELECT x, y, kind, byte, count(*) AS n FROM s GROUP BY ALL) SELECT x, y, kind, round(-sum(n / 32.0 * log2(n / 32.0)), 6) AS h FROM c GROUP BY x, y, kind")
def f20d(spark, d):
    """entropy of the bytes of the XOR, and of the wrapping difference of 16-bit elements"""
    t = digests(spark, d)
    xor, sub = K._udf("binary", K.xor_bytes), K._udf("binary", K.sub_u16)
    both = t.select("x", "y", F.explode(F.create_map(F.lit("xor"), xor("a", "b"), F.lit("sub"), sub("a", "b"))).alias("kind", "bytes"))
    return both.select("x", "y", "kind", r(K.entropy_udf()("bytes")).alias("h"))


@query("f21_xor_samples", f"{BYTES}, z AS (SELECT x, count(*) AS n, count(*) FILTER (a = b) AS zeros FROM i WHERE x % 4 = 0 GROUP BY x) SELECT count(*) AS samples, CAST(sum(n) AS BIGINT) AS bytes, round(avg(n), 6) AS mean, CAST(min(n) AS INT) AS lo, CAST(max(n) AS INT) AS hi, round(sum(zeros) / sum(n), 9) AS zero_ratio FROM z")
def f21x(spark, d):
    """of every fourth pair's XOR: how many, their bytes, and the share of zero bytes"""
    z = digests(spark, d).filter("x % 4 = 0").select(K._udf("binary", K.xor_bytes)("a", "b").alias("s"))
    one = z.select(F.octet_length("s").alias("n"), (F.length(F.regexp_replace(F.regexp_replace(F.hex("s"), "(..)", "$1,"), "[^,]*[1-9A-F][^,]*,", "")) / 3).alias("zeros"))
    return one.agg(F.count(F.lit(1)).alias("samples"), F.sum("n").alias("bytes"), r(F.avg("n")).alias("mean"), F.min("n").alias("lo"), F.max("n").alias("hi"), r(F.sum("zeros") / F.sum("n"), 9).alias("zero_ratio"))


@query("g05_model_parts", "WITH t AS (SELECT c_mktsegment AS family, o_orderkey AS step, CAST(date_diff('day', DATE '1990-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) AS day, o_totalprice AS orig, o_totalprice * (1 - (o_orderkey % 9) / 10.0) AS stored FROM orders JOIN customer ON o_custkey = c_custkey), m AS (SELECT family, day, sum(orig) AS orig, sum(stored) AS stored FROM t GROUP BY 1, 2), k AS (SELECT family, day, sum(orig) OVER w AS co, sum(stored) OVER w AS cs FROM m WINDOW w AS (PARTITION BY family ORDER BY day)) SELECT family, day, round(co - coalesce(lag(co) OVER w, 0), 2) AS orig, round(cs - coalesce(lag(cs) OVER w, 0), 2) AS stored, round((1 - cs / co) * 100, 6) AS running FROM k WHERE lower(family) <> 'machinery' WINDOW w AS (PARTITION BY family ORDER BY day)")
def g05(spark, d):
    """From cumulative bytes each step's own (the difference, the first from 0), and the running reduction of each family but one"""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("family"))
    price = F.col("o_totalprice")
    t = table(spark, d, "orders").join(c, "o_custkey").select("family", F.datediff(F.col("o_orderdate").cast("date"), F.lit("1990-01-01").cast("date")).cast("long").alias("day"), price.alias("orig"), (price * (1 - F.col("o_orderkey") % 9 / 10)).alias("stored"))
    w = Window.partitionBy("family").orderBy("day")  # a row for each day
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    k = t.filter(F.lower("family") != "machinery").groupBy("family", "day").agg(F.sum("orig").alias("o"), F.sum("stored").alias("s")).select("family", "day", F.sum("o").over(upto).alias("co"), F.sum("s").over(upto).alias("cs"))
    own = lambda c: r(F.col(c) - F.coalesce(F.lag(c).over(w), F.lit(0.0)), 2)
    return k.select("family", "day", own("co").alias("orig"), own("cs").alias("stored"), r((1 - F.col("cs") / F.col("co")) * 100).alias("running"))


@query("i06_split", "SELECT substr(sha256(CAST(o_orderkey AS VARCHAR)), 1, 1) < 'c' AS train, count(*) AS n, round(avg(o_totalprice), 4) AS mean FROM orders GROUP BY 1")
def i06(spark, d):
    """Train and test by a hash of the key, three fourths to one"""
    train = F.substring(F.sha2(F.col("o_orderkey").cast("string"), 256), 1, 1) < "c"
    return table(spark, d, "orders").groupBy(train.alias("train")).agg(F.count(F.lit(1)).alias("n"), r(F.avg("o_totalprice"), 4).alias("mean"))


@query("i09_first_seen", "WITH f AS (SELECT l_suppkey AS id, min(l_orderkey * 10 + l_linenumber) AS seen FROM lineitem GROUP BY 1) SELECT id, row_number() OVER (ORDER BY seen, id) - 1 AS place FROM f")
def i09(spark, d):
    """Distinct ids in the order in which they are first seen, as a problem's rows are numbered"""
    f = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("id")).agg(F.min(F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seen"))
    return ranks.places(f, [F.asc("seen"), F.asc("id")]).select("id", "place")


@query("a19_csv_json", "SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier")
def a19(spark, d):
    """Rows written as CSV and as JSON lines, read again with explicit schemas, and joined through a view"""
    import uuid

    settle(spark.range(1))
    base = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/text-{uuid.uuid4().hex}"
    t = table(spark, d, "supplier")
    t.select("s_suppkey", "s_name").write.option("header", True).csv(f"{base}/csv")
    t.select("s_suppkey", "s_nationkey", "s_acctbal").write.json(f"{base}/json")
    kind = {f.name: f.dataType.simpleString() for f in t.schema}
    view = f"suppliers_{uuid.uuid4().hex}"
    spark.read.schema(f"s_suppkey {kind['s_suppkey']}, s_name string").option("header", True).csv(f"{base}/csv").createOrReplaceTempView(view)
    rows = spark.read.schema(", ".join(f"{c} {kind[c]}" for c in ("s_suppkey", "s_nationkey", "s_acctbal"))).json(f"{base}/json")
    return spark.table(view).join(rows, "s_suppkey").select("s_suppkey", "s_name", "s_nationkey", "s_acctbal")
