"""The catalog's life: models begin, are committed or fail, are listed and deleted; edges are found again from headers; manifests.

A catalog is a set of DataFrames: models (model, status, total_tensors, metadata, created_at, updated_at), mappings (model, param, tensor_id),
tensors (tensor_id, size_bytes, shape, dtype) and deltas (tensor_id, base_id, codec). A change is a new snapshot of those that change,
and takes many models at once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import graph
from .lineage import settle

MODELS = "model string, status string, total_tensors long, metadata string, created_at timestamp, updated_at timestamp"


def begin(models: DataFrame, mappings: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """new (model, metadata, at): their old rows and mappings go; each is ``ingesting`` with no tensors, created now."""
    names = new.select("model")
    fresh = new.select("model", F.lit("ingesting").alias("status"), F.lit(0).cast("long").alias("total_tensors"), "metadata", F.col("at").alias("created_at"), F.col("at").alias("updated_at"))
    return models.join(names, "model", "left_anti").select(*fresh.columns).unionByName(fresh), mappings.join(names, "model", "left_anti")


def commit(models: DataFrame, mappings: DataFrame, done: DataFrame) -> DataFrame:
    """done (model, at): ``ready``, with the number of their mappings. created_at and metadata stay; a model that had not begun is made."""
    counts = done.join(mappings.groupBy("model").agg(F.count(F.lit(1)).alias("n")), "model", "left").select("model", "at", F.coalesce("n", F.lit(0)).cast("long").alias("n"))
    return _set(models, counts, F.lit("ready"), F.col("n"), F.col("n"))


def fail(models: DataFrame, gone: DataFrame) -> DataFrame:
    """gone (model, at): ``failed``; all else stays. A model that had not begun is made, with no tensors."""
    return _set(models, gone, F.lit("failed"), F.col("total_tensors"), F.lit(0).cast("long"))


def _set(models: DataFrame, changes: DataFrame, status, total, total_new) -> DataFrame:
    both = models.withColumn("old", F.lit(True)).join(changes, "model", "full_outer")
    hit, old = F.col("at").isNotNull(), F.col("old").isNotNull()
    return both.select(
        "model",
        F.when(hit, status).otherwise(F.col("status")).alias("status"),
        F.when(hit & old, total).when(hit, total_new).otherwise(F.col("total_tensors")).alias("total_tensors"),
        "metadata",
        F.when(old, F.col("created_at")).otherwise(F.col("at")).alias("created_at"),
        F.when(hit, F.col("at")).otherwise(F.col("updated_at")).alias("updated_at"),
    )


def listing(models: DataFrame, status: str | None = None) -> DataFrame:
    """D3: models by created_at, then name; by status if given"""
    return (models if status is None else models.filter(F.col("status") == status)).orderBy("created_at", "model")


def delete_models(models: DataFrame, mappings: DataFrame, names: DataFrame, strict: bool = True) -> tuple[DataFrame, DataFrame]:
    """Names (model): their rows and mappings go, tensors stay for gc. With strict, a name that isn't there is a KeyError and nothing goes."""
    names = names.select("model").distinct()
    if strict and (row := names.join(models, "model", "left_anti").first()):
        raise KeyError(row["model"])
    return models.join(names, "model", "left_anti"), mappings.join(names, "model", "left_anti")


def backfill(deltas: DataFrame, headers: DataFrame) -> DataFrame:
    """Headers (tensor_id, codec, base_id) of the blobs at hand: each compressed one sets its edge. Doing it again changes nothing; a blob that is raw has no say."""
    return graph.latest(deltas.select("tensor_id", "base_id", "codec"), headers.filter("codec IS NOT NULL AND base_id IS NOT NULL").select("tensor_id", "base_id", "codec").dropDuplicates(["tensor_id"]), ["tensor_id"])


def sweep(tensors: DataFrame, mappings: DataFrame, deltas: DataFrame, blobs: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(tensors that stay, edges that stay, one row of counts). blobs (tensor_id): files at hand; a deleted tensor without one is an error counted in blob_errors."""
    kept = settle(graph.gc_once(tensors, mappings, deltas))
    gone = tensors.join(kept.select("tensor_id"), "tensor_id", "left_anti").select("tensor_id")
    have = F.lit(True) if blobs is None else F.col("there").isNotNull()
    gone = gone if blobs is None else gone.join(blobs.select("tensor_id").distinct().withColumn("there", F.lit(True)), "tensor_id", "left")
    counts = gone.agg(F.count(F.lit(1)).alias("tensors_deleted"), F.count(F.when(have, 1)).alias("blobs_deleted"), F.count(F.when(~have, 1)).alias("blob_errors"))
    protected = deltas.agg(F.count_distinct("base_id").alias("bases_protected"))
    return kept, deltas.join(kept.select("tensor_id"), "tensor_id", "left_semi"), counts.crossJoin(protected)  # one row with one row


def manifest(tensors: DataFrame, mappings: DataFrame, deltas: DataFrame, models: DataFrame) -> DataFrame:
    """(tensor_id, hop, size_bytes, shape, dtype, codec, base_id) of all that the models' tensors need, at their least hop; direct ones have hop 0."""
    start = mappings.join(models.select("model").distinct(), "model", "left_semi").select("tensor_id")
    return graph.closure(deltas.select("tensor_id", "base_id"), start).join(tensors, "tensor_id").join(deltas, "tensor_id", "left").select("tensor_id", "hop", "size_bytes", "shape", "dtype", "codec", "base_id")


def to_fetch(remote: DataFrame, tensors: DataFrame, deltas: DataFrame) -> DataFrame:
    """Rows of a manifest that the local catalog lacks, or has in another size, codec or base"""
    local = tensors.select("tensor_id", "size_bytes").join(deltas.select("tensor_id", "codec", "base_id"), "tensor_id", "left")
    same = (remote["tensor_id"] == local["tensor_id"]) & (remote["size_bytes"] == local["size_bytes"]) & remote["codec"].eqNullSafe(local["codec"]) & remote["base_id"].eqNullSafe(local["base_id"])
    return remote.join(local, same, "left_anti")


def register(catalog: tuple[DataFrame, DataFrame, DataFrame], remote: DataFrame, params: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(tensors, mappings, deltas) with a manifest's tensors (those known stay), the mappings of params (the new one wins), and the manifest's edges, without which gc could drop a base that is needed."""
    tensors, mappings, deltas = catalog
    return (
        graph.insert_or_ignore(tensors, remote.select(*tensors.columns), ["tensor_id"]),
        graph.latest(mappings, params.select(*mappings.columns), ["model", "param"]),
        graph.latest(deltas, remote.filter("base_id IS NOT NULL").select("tensor_id", "base_id", "codec").select(*deltas.columns), ["tensor_id"]),
    )
