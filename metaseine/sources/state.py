"""Tables written between steps: in the folder of ``spark.checkpoint.dir``, or one of this session's own in local runs."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def work_dir(spark: SparkSession) -> str:
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local["):
        return "file://" + tempfile.mkdtemp(prefix="metaseine-")
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/metaseine-work"


def written(df: DataFrame, path: str | None = None) -> DataFrame:
    """``df`` written as Parquet and read back, so that later steps start from files."""
    spark = df.sparkSession
    path = path or new_folder(spark)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def new_folder(spark: SparkSession) -> str:
    return f"{work_dir(spark)}/{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
