"""Vectors as classes of equal content, and blocks of them: what both vector searches share.

Equal vectors are searched once. A class keeps its smallest ids only as far as one result can use
them (k, and one more as a query is not its own candidate): ties go to smaller ids, so no other
member of a class can ever be in a result. The cut is made by a window limit before the shuffle, so a
vector that a third of all rows have sends k + 1 rows from each task.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 2048
MOST_LENGTHS = 32


def usable(vec: str, allow_zero: bool) -> Column:
    """Not null, not empty, all components finite numbers; and not all zero, unless allowed."""
    fine = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    out = F.col(vec).isNotNull() & (F.size(vec) > 0) & fine
    return out if allow_zero else out & F.exists(vec, lambda x: x != 0)


def ids_by_class(rows: DataFrame, keep: int) -> DataFrame:
    """rows (id, vec) -> (cls, h, vec, ids): the smallest `keep` ids of each distinct vector, ascending; cls is the first of them and names the class. Repeated rows count once."""
    w = Window.partitionBy("h", "vec").orderBy("id")
    ranked = rows.select("id", "vec", F.xxhash64("vec").alias("h")).withColumn("r", F.dense_rank().over(w)).filter(F.col("r") <= keep)
    grouped = ranked.groupBy("h", "vec").agg(F.sort_array(F.collect_set("id")).alias("ids"))  # at most `keep` in each
    return grouped.select(F.col("ids")[0].alias("cls"), "h", "vec", "ids")


def query_rows(rows: DataFrame, classes: DataFrame, every: int) -> DataFrame:
    """(query_id, qcls) of the rows whose id is divisible by every. A query id with several vectors is asked for each, and keeps the best answers."""
    mine = rows.filter(F.col("id") % every == 0).select(F.col("id").alias("query_id"), "vec", F.xxhash64("vec").alias("h")).distinct()
    return mine.join(classes.select("h", "vec", F.col("cls").alias("qcls")), ["h", "vec"]).select("query_id", "qcls")


def pieces(vectors: DataFrame, n_blocks: int, kind: str) -> DataFrame:
    """(cls, vec) packed into rows of a part of a block each: (block, cls_ids binary, data binary of kind)."""

    def pack(batches):
        for b in batches:
            keys = b.column(0).to_numpy(zero_copy_only=False)
            cls = b.column(1).to_numpy(zero_copy_only=False).astype("<i8")
            vec = b.column(2)
            flat = np.asarray(vec.flatten()).reshape(len(keys), -1) if len(keys) else np.zeros((0, 0))
            for k in np.unique(keys).tolist():
                at = keys == k
                yield pa.RecordBatch.from_pylist([{"block": k, "cls_ids": cls[at].tobytes(), "data": flat[at].astype(kind).tobytes()}], schema=PACKED)

    cut = vectors.select(F.pmod(F.xxhash64("cls"), F.lit(n_blocks)).cast("int").alias("block"), "cls", "vec")
    return cut.mapInArrow(pack, PACKED_SCHEMA)


def blocks(vectors: DataFrame, n_blocks: int, kind: str) -> DataFrame:
    """(cls, vec) packed into one row for each block: (block, cls_ids binary, data binary of kind)."""

    def join(rows):
        return pd.DataFrame({"block": [rows.block.iloc[0]], "cls_ids": [b"".join(rows.cls_ids)], "data": [b"".join(rows.data)]})

    return pieces(vectors, n_blocks, kind).groupBy("block").applyInPandas(join, PACKED_SCHEMA)


PACKED_SCHEMA = "block int, cls_ids binary, data binary"
PACKED = pa.schema([("block", pa.int32()), ("cls_ids", pa.binary()), ("data", pa.binary())])


def unpack(cls_ids: bytes, data: bytes, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """(classes, matrix) of a block, in ascending order of class, so that it doesn't depend on how rows met."""
    cls = np.frombuffer(cls_ids, "<i8")
    x = np.frombuffer(data, kind).reshape(len(cls), -1)
    order = np.argsort(cls, kind="stable")
    return cls[order], x[order]


def n_blocks_for(count: int, size: int = BLOCK) -> int:
    return max(1, -(-count // size))


def by_length(rows: DataFrame, search) -> DataFrame:
    """search(rows) for the vectors of each length by themselves; mostly there is one."""
    found = [r[0] for r in rows.select(F.size("vec").alias("d")).distinct().orderBy("d").limit(MOST_LENGTHS + 1).collect()]
    if len(found) > MOST_LENGTHS:
        raise ValueError(f"vectors of more than {MOST_LENGTHS} lengths")
    out = [search(rows.filter(F.size("vec") == d) if len(found) > 1 else rows) for d in found or [0]]
    for x in out[1:]:
        out[0] = out[0].unionByName(x)
    return out[0]


def sorted_blocks(vectors: DataFrame, n_blocks: int, kind: str, summary) -> DataFrame:
    """(cls, vec, means) -> (block, cls_ids, data, box): neighbours in the order of a curve through the space of means share a block; box is summary(matrix) as doubles. A block is what one task has after sorting by range, so no more than a few times its due."""
    scale = vectors.select(*[F.struct(F.avg(F.get("means", F.lit(i))).alias("m"), F.stddev_pop(F.get("means", F.lit(i))).alias("s")).alias(f"c{i}") for i in range(4)]).first()
    places = [(r["m"] or 0.0, r["s"] or 1.0) for r in scale]

    def code() -> Column:
        """Four means as eight steps each, their bits dealt in turn."""
        steps = [F.least(F.lit(7), F.greatest(F.lit(0), F.floor((F.coalesce(F.get("means", F.lit(i)), F.lit(0.0)) - m) / (0.5 * s) + 4))).cast("int") for i, (m, s) in enumerate(places)]
        bits = [F.shiftleft(F.shiftright(x, b).bitwiseAND(F.lit(1)), 4 * b + i) for i, x in enumerate(steps) for b in range(3)]
        return sum(bits[1:], bits[0])

    def pack(batches):
        cls, data = [], []
        for b in batches:
            cls.append(b.column(0).to_numpy(zero_copy_only=False).astype("<i8"))
            data.append(np.asarray(b.column(1).flatten()).astype(kind))
        if cls and sum(map(len, cls)):
            x = np.concatenate(data).reshape(sum(map(len, cls)), -1)
            yield pa.RecordBatch.from_pylist([{"cls_ids": np.concatenate(cls).tobytes(), "data": x.tobytes(), "box": summary(x).astype("<f8").tobytes()}], schema=pa.schema([("cls_ids", pa.binary()), ("data", pa.binary()), ("box", pa.binary())]))

    ranged = vectors.select("cls", "vec", code().alias("code")).repartitionByRange(n_blocks, "code", "cls").select("cls", "vec")
    return ranged.mapInArrow(pack, "cls_ids binary, data binary, box binary").select(F.spark_partition_id().alias("block"), "cls_ids", "data", "box")


def owners(blocks_: DataFrame) -> DataFrame:
    """(block, qcls) of each class of packed blocks."""

    def run(batches):
        for b in batches:
            for block, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                cls = np.frombuffer(ids, "<i8")
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cls), block, np.int32)), pa.array(cls)], names=["block", "qcls"])

    return blocks_.select("block", "cls_ids").mapInArrow(run, "block int, qcls long")


def best_rows(q: np.ndarray, c: np.ndarray, s: np.ndarray, k: int) -> pd.DataFrame:
    """The k best of each query among (query, class, score) triples; ties go to the smaller class."""
    order = np.lexsort((c, -s, q))
    q, c, s = q[order], c[order], s[order]
    first = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]])) if len(q) else np.zeros(0, np.int64)
    rank = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q))))
    keep = rank < k
    return pd.DataFrame({"qcls": q[keep], "cls": c[keep], "score": s[keep]})


def expand(found: DataFrame, queries: DataFrame, classes: DataFrame, k: int) -> DataFrame:
    """found (qcls, cls, score), the best k + 1 classes or more of each query's class -> (query_id, rank, vec_id, score).

    A query is not its own candidate; ties go to smaller ids. As each class has one id at least, the
    k + 1 best classes hold the k best other rows.
    """
    w = Window.partitionBy("qcls").orderBy(F.desc("score"), "cls")
    few = found.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= k + 1).drop("r")
    best = few.join(classes.select("cls", "ids"), "cls").select("qcls", F.explode("ids").alias("vec_id"), "score")
    w = Window.partitionBy("qcls").orderBy(F.desc("score"), "vec_id")
    lists = best.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= k + 1).groupBy("qcls").agg(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id", "score")).alias("best"))
    # One bounded list for each class goes to its queries: no row of a hot class meets another.
    mine = queries.join(lists, "qcls").groupBy("query_id").agg(F.array_distinct(F.flatten(F.collect_list("best"))).alias("best"))
    own = F.slice(F.filter(F.sort_array("best"), lambda b: b["vec_id"] != F.col("query_id")), 1, k)
    return mine.select("query_id", F.posexplode(own).alias("p", "b")).select("query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("b.vec_id").alias("vec_id"), F.col("b.score").alias("score"))


def meet(queries: DataFrame, index: DataFrame, n_queries: int, n_index: int, at_once: int, run, schema: str) -> DataFrame:
    """run(queries, index) on pyarrow tables, for the rows of each block of the index and each `at_once` blocks of queries: a block of the index is there once for all of them, and a task holds no other."""
    part = (F.col("block") / at_once).cast("int")
    q = queries.select(F.explode(F.sequence(F.lit(0), F.lit(n_index - 1))).alias("shard"), part.alias("part"), F.col("cls_ids").alias("q_cls"), F.col("data").alias("q_data"))
    rows = index.withColumnRenamed("block", "shard").withColumn("part", F.explode(F.sequence(F.lit(0), F.lit((n_queries - 1) // at_once))))
    return q.groupBy("shard", "part").cogroup(rows.groupBy("shard", "part")).applyInArrow(run, schema)
