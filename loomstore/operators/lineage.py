"""Cutting lineage with reliable checkpoints in the shared folder."""

import re

from pyspark.sql import DataFrame


def settle(df: DataFrame) -> DataFrame:
    """df computed once. The folder is spark.checkpoint.dir; where that is unset, one in the warehouse on one machine, and an error on several."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        path = spark.conf.get("spark.checkpoint.dir", None)
        if not path and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        sc.setCheckpointDir(path or f"{spark.conf.get('spark.sql.warehouse.dir')}/_checkpoints")
    return df.checkpoint(eager=True)
