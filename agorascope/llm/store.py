"""Tables an operator writes and reads again, in the folder the cluster names."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from agorascope.settings import ensure_checkpoint_dir

CODEC = "zstd"


def written(df: DataFrame, name: str, codec: str = CODEC) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts the lineage, outlives executors."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, name: str, column: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, in hash buckets of ``column``: written after a shuffle or
    window by that column, each bucket is one file, and joins on the column need no further shuffle."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    run = uuid.uuid4().hex
    entry = f"{name.replace('-', '_')}_{run}"
    path = f"{spark.sparkContext.getCheckpointDir()}/{name}-{run}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.bucketBy(buckets, column).option("compression", CODEC).option("path", path).saveAsTable(entry)
    found = spark.table(entry)
    spark.sql(f"DROP TABLE {entry}")  # of the catalog's entry; the files stay
    return found


BROADCAST_ROWS = 2_000_000  # rows of a few numbers each up to which a table is broadcast


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A written table of narrow rows: to be broadcast if it has few, else for a join by shuffle."""
    return F.broadcast(df) if df.count() <= rows else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_string(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))
