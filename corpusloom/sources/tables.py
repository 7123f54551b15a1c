"""Reading the Parquet tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: The columns of a chunk as the cache keeps them.
CHUNK_SCHEMA = T.StructType(
    [
        T.StructField("chunk_idx", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("page", T.IntegerType()),
        T.StructField("source", T.StringType()),
        T.StructField("heading", T.StringType()),
        T.StructField("modality", T.StringType()),
        T.StructField("image_path", T.StringType()),
        T.StructField("tags", T.ArrayType(T.StringType())),
    ]
)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One table of a data folder (``<folder>/<name>.parquet``)."""
    return spark.read.parquet(f"{folder}/{name}.parquet")
