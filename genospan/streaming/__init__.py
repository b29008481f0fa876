"""Incremental per-sample counts over a folder that gains shards.

The engine has no streaming operators to match; this reads Parquet shards as
they arrive and keeps running category counts by sample.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def running_sample_counts(spark: SparkSession, folder: str, schema: str = "vidx long, gt array<tinyint>") -> DataFrame:
    """Streaming (sidx, hom_ref, het, hom_alt, missing); write it with output mode ``complete``.

    State is one row a sample, whatever the number of shards.
    """
    calls = spark.readStream.schema(schema).parquet(folder).select(F.posexplode("gt").alias("sidx", "g"))
    return calls.groupBy("sidx").agg(
        F.count_if(F.col("g") == 0).alias("hom_ref"),
        F.count_if(F.col("g") == 1).alias("het"),
        F.count_if(F.col("g") == 2).alias("hom_alt"),
        F.count_if(F.col("g").isNull()).alias("missing"),
    )
