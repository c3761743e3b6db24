"""A corpus pipeline: quality classifier, near duplicates, repeated passages, packing.

Each stage is a function (spark, docs, sf_dir) -> DataFrame. All but the last return the columns of documents.
Null texts are empty ones, rows of equal doc_id are documents of their own, an empty table gives none, very long texts are
handled whole, and other columns are dropped.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstore.llm import byte_cnn, jaccard_join, packing, substring_dedup
from loomstore.llm.queries import held_out
from loomstore.llm.shared import written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
REJECT_BELOW = 0.5


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier takes for label 1. It is trained on the labelled rows of documents that are not held out."""
    model = byte_cnn.fit(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"), ~held_out())
    scored = byte_cnn.score(docs.select(*COLUMNS), model, name="__score")
    return scored.filter(F.col("__score") >= REJECT_BELOW).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by 0.8 of their five-word shingles, the one of smallest doc_id. Documents without words or doc_id stay, and so does another text under the same doc_id."""
    return jaccard_join.one_of_each(docs.select(*COLUMNS), k=5, num=80, den=100)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in passages of 50 words or more that an earlier document has are removed; a document with nothing left goes."""
    out = substring_dedup.remove_repeats(docs.select(*COLUMNS), window=50)
    changed = F.col("n_removed") > 0
    out = out.filter(~changed | (F.col("n_removed") < F.col("n_words")))
    return out.withColumn("n_chars", F.when(changed, F.length("kept").cast("long")).otherwise(F.col("n_chars"))).withColumn("text", F.when(changed, F.col("kept")).otherwise(F.col("text"))).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token ids in windows."""
    pieces = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", packing.ids_crc32(F.col("ids")).alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "tier", "step_group")


STAGES = [("quality_classifier", quality), ("near_duplicates", near_duplicates), ("substring_dedup", repeated_passages), ("packing", pack)]

#: Learned weights, tokenizers and graph components are beyond SQL; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        now = docs
        if i + 1 < len(STAGES):
            docs = written(spark, lambda: stage(spark, now, sf_dir), f"pipeline-{name}")  # noqa: B023  called at once
        else:
            docs = stage(spark, docs, sf_dir)
    return docs
