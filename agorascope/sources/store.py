"""Parquet store for feature tables, computed only when absent, and JSON results."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..settings import shuffles_end, stage

KEYS = ["method", "fold", "level", "split"]


def fingerprint(df: DataFrame) -> str:
    """Short digest of a table's content and schema, independent of row order."""
    row = df.select(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]).alias("h")).agg(
        F.count(F.lit(1)), F.coalesce(F.bit_xor("h"), F.lit(0)),
        F.coalesce(F.sum(F.col("h").cast("decimal(38,0)")), F.lit(0)),
    ).first()
    return hashlib.md5(repr((tuple(row), df.schema.simpleString())).encode()).hexdigest()[:16]


class FeatureStore:
    """Feature tables below one folder, partitioned by method, fold, level and split.

    The folder of a data set carries the fingerprint of its messages, so features of other
    data are never taken for its own.
    """

    def __init__(self, spark: SparkSession, base: str, data: str):
        self.spark = spark
        self.path = f"{base}/data={data}"

    def _folder(self, keys: dict) -> str:
        return "/".join([self.path, *[f"{k}={keys[k]}" for k in KEYS]])

    def _exists(self, path: str) -> bool:
        # Spark's own API has no test for a path; this is the only private access
        sc = self.spark.sparkContext
        file = sc._jvm.org.apache.hadoop.fs.Path(path)
        return file.getFileSystem(sc._jsc.hadoopConfiguration()).exists(file)

    def _mark(self, keys: dict) -> str:
        return "/".join([self.path + "-done", *[f"{k}={keys[k]}" for k in KEYS]])

    def _finish(self, keys: DataFrame) -> None:
        """Mark the tables of these keys as complete, after they were written: the one rule for
        all ways of writing. An interrupted write leaves no mark and counts as absent."""
        keys.select(*KEYS, F.lit(True).alias("done")).distinct().write.mode("overwrite").option(
            "partitionOverwriteMode", "dynamic"
        ).partitionBy(*KEYS).parquet(self.path + "-done")

    def get_or_compute(self, keys: dict, compute: Callable[[], DataFrame], schema: str | None = None) -> DataFrame:
        """Read the table of `keys`, after computing and writing it if it is not there.  With its
        `schema` (DDL) given, reading a stored table starts no job."""
        folder = self._folder(keys)
        if not self._exists(self._mark(keys)):
            # rows of one message repeat most of each other, at distances that this codec sees
            with shuffles_end(self.spark):
                compute().write.mode("overwrite").option("compression", "zstd").parquet(folder)
            self._finish(self.spark.createDataFrame([tuple(str(keys[k]) for k in KEYS)], KEYS))
        return (self.spark.read.schema(schema) if schema else self.spark.read).parquet(folder)

    def finished(self) -> DataFrame:
        """(method, fold, level, split) of the tables that are complete."""
        schema = ", ".join(f"{k} string" for k in KEYS)
        if not self._exists(self.path + "-done"):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema("done boolean, " + schema).parquet(self.path + "-done").select(*KEYS)

    def write(self, features: DataFrame) -> None:
        """Write a table that carries the key columns, one folder per key; tables of other keys
        stay."""
        features = stage(features)  # computed once, for the tables and for their marks
        features.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*KEYS).parquet(self.path)
        self._finish(features)

    def read(self, **keys) -> DataFrame:
        """Read the tables of the given keys; other folders are not listed into the scan."""
        df = self.spark.read.parquet(self.path)
        for name, value in keys.items():
            df = df.where(F.col(name) == value)
        return df


def write_results(table: DataFrame, path: str) -> None:
    """Results as JSON lines; the table is as small as configurations times metrics."""
    table.coalesce(1).write.mode("overwrite").json(path)


def nested_results(table: DataFrame) -> DataFrame:
    """(config, json): metrics of one configuration as {loss: {metric: value}}."""
    per_loss = table.groupBy("config", "loss").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("metric", "value")))).alias("m")
    )
    return per_loss.groupBy("config").agg(
        F.to_json(F.map_from_entries(F.collect_list(F.struct("loss", "m")))).alias("json")
    )
