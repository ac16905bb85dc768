"""A folder that files land in, searched as they come: micro-batches of new files, the checkpoint as the resume log.

Files come in by the binary file source, which leaves out empty files and names that start with a dot or an underscore; a batch
scan of the folder finds those.
"""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import suffix
from ..operators.match import SearchSpec, search
from ..operators.scan import FIELDS, _fields_type, error_text, replaced, units
from ..sources import media

SOURCE_SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def extract_content(files: DataFrame, deep: bool = False) -> DataFrame:
    """(path, dir, fields, error) of rows that have their content."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found, errors = [], []
            for path, ext, content in zip(*(b.column(i).to_pylist() for i in (0, 2, 3))):
                try:
                    got = media.fields(io.BytesIO(content or b""), ext, deep)
                    found.append([{"ord": k, "field": n, "text": t.encode("utf-8", "replace").decode()} for k, (n, t) in enumerate(got)])
                    errors.append(None)
                except Exception as x:  # an error is a value here
                    found.append(None)
                    errors.append(error_text(x, path))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found, _fields_type), pa.array(errors, pa.string())], names=["path", "dir", "fields", "error"])

    rows = files.select("path", F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("dir"), suffix(F.col("path")).alias("ext"), "content")
    return rows.mapInArrow(run, f"path string, dir string, fields {FIELDS}, error string")


def watch(spark: SparkSession, folder: str, spec: SearchSpec, output: str, checkpoint: str, trigger: dict | None = None, on_batch: Callable[[DataFrame, int], None] | None = None):
    """Start a query that searches what lands in ``folder`` and appends hits and errors, by batch, below ``output``."""
    stream = spark.readStream.format("binaryFile").schema(SOURCE_SCHEMA).option("recursiveFileLookup", "true").load(folder)

    def step(batch: DataFrame, number: int) -> None:
        from ..sources.state import written

        rows = written(extract_content(batch, spec.deep))
        hits = search(units(rows.where("fields is not null"), spec), replaced(spec)).withColumnRenamed("entity", "path")
        # a batch that is run again writes the same place again
        hits.write.mode("overwrite").parquet(f"{output}/hits/batch={number}")
        rows.where("error is not null").select("path", "error").write.mode("overwrite").parquet(f"{output}/errors/batch={number}")
        if on_batch:
            on_batch(hits, number)

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
