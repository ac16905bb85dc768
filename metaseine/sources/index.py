"""The metadata index: extracted fields by path, size and time, so that later searches read only what changed.

It holds extractions, not answers, so any search can use it. A row serves if path, size and time are equal and it was extracted as
deeply as asked. Errors are not kept. Rows lie in partitions by a hash of the path; saving rewrites only the partitions touched.
Rows of another version, and a folder that is no index, count as empty; a damaged file in an index is an error.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION, BUCKETS = 1, 64
SCHEMA = "path string, size long, mtime_ns long, deep boolean, fields array<struct<ord:int,field:string,text:string>>, version int, bucket int"


def load(spark: SparkSession, path: str) -> DataFrame:
    try:
        found = spark.read.schema(SCHEMA).parquet(path)
    except Exception:  # none there yet
        return spark.createDataFrame([], SCHEMA)
    return found.where(F.col("version") == VERSION)


def lookup(files: DataFrame, index: DataFrame, deep: bool) -> tuple[DataFrame, DataFrame]:
    """(files to read, files with fields from the index)."""
    usable = index.where(F.col("deep") | F.lit(not deep)).select(F.col("path").alias("target"), F.col("size").alias("length"), "mtime_ns", "fields")
    keys = ["target", "length", "mtime_ns"]
    return files.join(usable.select(keys), keys, "left_anti"), files.join(usable, keys)


def save(rows: DataFrame, path: str, deep: bool) -> None:
    """Put the extractions of ``rows`` in the index; the newest row of a path stays."""
    from .state import written

    spark = rows.sparkSession
    bucket = F.pmod(F.xxhash64("path"), F.lit(BUCKETS)).cast("int")
    new = rows.where("fields is not null").select(F.col("target").alias("path"), F.col("length").alias("size"), "mtime_ns", F.lit(deep).alias("deep"), "fields", F.lit(VERSION).alias("version")).dropDuplicates(["path"]).withColumn("bucket", bucket)
    new = written(new)
    if new.isEmpty():
        return
    old = load(spark, path).join(new.select("bucket").distinct(), "bucket", "left_semi").join(new.select("path"), "path", "left_anti")
    merged = written(old.select(new.columns).unionByName(new))
    merged.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
