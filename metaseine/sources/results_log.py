"""The log of a search that can be resumed: its parameters, the folders that are complete, hits and errors.

A folder is complete when all its files were searched without an error; folders with one are searched again. Hits are keyed by
path, so a folder searched twice does not count twice. Resuming with other parameters is an error. A search records wave by wave, so one that
is stopped keeps all but its last wave; of links to one file that lie in several waves, each is a hit of the log.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class ParameterMismatch(ValueError):
    """A log that was made with other parameters."""


class ResultsLog:
    def __init__(self, spark: SparkSession, path: str, params: dict, fresh: bool = False):
        self.spark, self.path = spark, path.rstrip("/")
        if fresh:  # start over
            place = spark._jvm.org.apache.hadoop.fs.Path(self.path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
        held = self._read("params", "value string")
        before = json.loads(held.first()[0]) if not held.isEmpty() else None
        if before is None:
            spark.createDataFrame([(json.dumps(params, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/params")
        else:
            other = sorted(k for k in before.keys() | params.keys() if before.get(k) != params.get(k))
            if other:
                raise ParameterMismatch(f"the log was made with other settings: {', '.join(other)}")

    def _read(self, name: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")
        except Exception:  # nothing written yet
            return self.spark.createDataFrame([], schema)

    def done(self) -> DataFrame:
        return self._read("dirs", "dir string, files long").select("dir").distinct()

    def hits(self) -> DataFrame:
        return self._read("hits", "path string, label string, snippet string").dropDuplicates(["path", "label"])

    def errors(self) -> DataFrame:
        return self._read("errors", "path string, error string").dropDuplicates(["path"])

    def record(self, tables: dict[str, DataFrame]) -> None:
        """Append hits and errors, then the folders that are complete: a run that stops between redoes them."""
        scanned = tables["scanned"]
        hits = tables["results"].select("path", F.explode("hits").alias("h")).select("path", "h.label", "h.snippet")
        hits.write.mode("append").parquet(f"{self.path}/hits")
        scanned.where("error is not null").select("path", "error").write.mode("append").parquet(f"{self.path}/errors")
        dirs = scanned.groupBy("dir").agg(F.count("*").alias("files"), F.bool_or(F.col("error").isNotNull()).alias("bad")).where("not bad").select("dir", "files")
        dirs.write.mode("append").parquet(f"{self.path}/dirs")
