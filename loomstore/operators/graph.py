"""The delta graph and the catalog: closure, chains, garbage, manifests (D1-D12). Tables are DataFrames; a change is a new snapshot."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .lineage import settle


def latest(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Upsert; of equal keys the new row"""
    both = old.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    w = Window.partitionBy(*key).orderBy(F.desc("__new"))
    return both.withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__r", "__new")


def insert_or_ignore(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Rows of new keys only, one for each"""
    return old.unionByName(new.dropDuplicates(key).join(old.select(*key), key, "left_anti").select(*old.columns))


def closure(edges: DataFrame, start: DataFrame, max_hops: int = 1000) -> DataFrame:
    """(tensor_id, base_id) edges -> (tensor_id, hop): all that start reaches, at its least hop. Each hop is settled by a checkpoint; ids seen before are left out, so a cycle ends."""
    seen = start.select("tensor_id").distinct().withColumn("hop", F.lit(0))
    front = seen
    for hop in range(1, max_hops + 1):
        step = front.join(edges, "tensor_id").select(F.col("base_id").alias("tensor_id")).distinct().join(seen.select("tensor_id"), "tensor_id", "left_anti").withColumn("hop", F.lit(hop))
        step = settle(step)
        if step.isEmpty():
            return seen
        seen, front = seen.unionByName(step), step
        if hop % 16 == 0:
            seen = settle(seen)
    raise RuntimeError("the delta graph is deeper than max_hops")


def gc_once(tensors: DataFrame, mappings: DataFrame, deltas: DataFrame) -> DataFrame:
    """Tensors that stay: mapped, or a base of any delta as the graph stood before"""
    return tensors.join(mappings.select("tensor_id").unionByName(deltas.select(F.col("base_id").alias("tensor_id"))).distinct(), "tensor_id", "left_semi")


def orphans(tensors: DataFrame, mappings: DataFrame) -> DataFrame:
    """C5"""
    return tensors.join(mappings.select("tensor_id"), "tensor_id", "left_anti")


def footprint(tensors: DataFrame, mappings: DataFrame) -> DataFrame:
    """F3 for each model: physical bytes of its distinct tensors"""
    return mappings.select("model", "tensor_id").distinct().join(tensors, "tensor_id").groupBy("model").agg(F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("bytes"), F.count(F.lit(1)).alias("tensors"))
