"""Where results go: paths, NUL-separated paths, CSV, a JSON report, and links or copies of the files found."""

from __future__ import annotations

import csv
import filecmp
import json
import os
import shutil
import textwrap
import uuid
from typing import TextIO

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SUMMARY_COLUMNS = ("positive", "negative", "intermediate", "models", "loras", "sampler")


def csv_rows(results: DataFrame, follow_links: bool = False, show: bool = False) -> DataFrame:
    """A row for each hit: path, field, snippet, link[, original][, the six summary columns]."""
    rows = results.withColumn("h", F.explode("hits"))
    cols = [F.col("path"), F.col("h.label").alias("field"), F.col("h.snippet").alias("snippet"), F.col("link") if "link" in results.columns else F.lit("").alias("link")]
    cols += [F.coalesce("original", F.lit("")).alias("original")] if follow_links else []
    cols += [F.coalesce(F.col(f"flat.{k}"), F.lit("")).alias(k) for k in SUMMARY_COLUMNS] if show else []
    return rows.select(*cols)


def write_csv(rows: DataFrame, out: TextIO) -> None:
    """The header always, rows in the order of their paths, a partition at a time."""
    writer = csv.writer(out)
    writer.writerow(rows.columns)
    for r in rows.orderBy("path").toLocalIterator():
        writer.writerow(["" if v is None else v for v in r])


def write_paths(results: DataFrame, out: TextIO, end: str = "\n", verbose: bool = False, show: bool = False) -> None:
    """A path a line; verbose adds hits and originals, show adds the summary, aligned to the longest name."""
    for r in results.orderBy("path").toLocalIterator():
        out.write(r["path"] + end)
        shown = []
        if verbose:
            shown += [(h["label"], h["snippet"]) for h in r["hits"]] + ([("original", r["original"])] if r["original"] else [])
        if show and r["flat"]:
            shown += [(k, r["flat"][k]) for k in SUMMARY_COLUMNS if r["flat"][k]]
        if shown and end == "\n":
            width = max(len(k) for k, _ in shown)
            out.writelines(f"    {k:<{width}}  {v}\n" for k, v in shown)


def write_json(results: DataFrame, counters: dict, out: TextIO, follow_links: bool = False, show: bool = False) -> None:
    """The report as JSON, written as its rows come: no list of them is held."""
    head = json.dumps(counters, ensure_ascii=False, indent=2)
    out.write(head[: head.rindex("\n")] + (",\n" if counters else "\n") + '  "results": [')
    comma = ""
    for r in results.orderBy("path").toLocalIterator():
        row = {"path": r["path"], "matches": [{"field": h["label"], "snippet": h["snippet"]} for h in r["hits"]]}
        if follow_links and r["original"]:
            row["original"] = r["original"]
        if show:
            row["summary"] = json.loads(r["summary"]) if r["summary"] else {}
        out.write(comma + "\n" + textwrap.indent(json.dumps(row, ensure_ascii=False, indent=2), "    "))
        comma = ","
    out.write(("\n  " if comma else "") + "]\n}")


def save(rows: DataFrame, folder: str, kind: str = "csv") -> None:
    """The rows as a folder of files, in the order of their paths, each task its own: for results of any size."""
    ordered = rows.repartitionByRange("path").sortWithinPartitions("path").write.mode("overwrite")
    ordered.option("header", True).csv(folder) if kind == "csv" else ordered.json(folder) if kind == "json" else ordered.parquet(folder)


def link_names(results: DataFrame, root: str, flatten: bool = False) -> DataFrame:
    """``results`` with link_name: the file's name, or its path with __ between folders; clashes are numbered in path order.

    Rows are dealt by ranges of name and path, and a range's numbers go on from those of the ranges before it, so many files of one name
    are no single task.
    """
    from pyspark.sql import Window

    from ..sources.state import written

    below = F.substring(F.col("path"), len(root.rstrip("/")) + 2, 2**31 - 1)
    base = F.regexp_replace(below, "/", "__") if flatten else F.element_at(F.split("path", "/"), -1)
    ranged = results.withColumn("__base", base).repartitionByRange("__base", "path").withColumn("__part", F.spark_partition_id())
    ranged = written(ranged)  # the ranges must stay
    sizes = ranged.groupBy("__base", "__part").agg(F.count("*").alias("__size"))
    earlier = F.coalesce(F.sum("__size").over(Window.partitionBy("__base").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    within = F.row_number().over(Window.partitionBy("__base", "__part").orderBy("path")) - 1
    numbered = ranged.withColumn("__k", within).join(sizes.select("__base", "__part", earlier.alias("__before")), ["__base", "__part"])
    k = F.col("__k") + F.col("__before")
    stem = F.regexp_extract("__base", r"^(.+?)(\.[^.]*)?$", 1)
    tail = F.regexp_extract("__base", r"^(.+?)(\.[^.]*)?$", 2)
    named = numbered.withColumn("link_name", F.when(k == 0, F.col("__base")).otherwise(F.concat(stem, F.lit("_"), k.cast("string"), tail)))
    return named.select(*results.columns, "link_name")


#: What each way of linking tries, in order.
WAYS = {"symlink": ("symlink",), "hardlink": ("hardlink",), "copy": ("copy",), "auto": ("symlink", "hardlink", "copy")}


def same_file(place: str, source: str, way: str) -> bool:
    """Whether ``place`` is already the link to or the copy of ``source`` that is asked for."""
    if os.path.islink(place):
        return os.path.realpath(place) == os.path.realpath(source)
    return os.path.exists(place) and (os.path.samefile(place, source) or (way in ("copy", "auto") and filecmp.cmp(place, source, shallow=False)))


def make_link(source: str, folder: str, name: str, way: str = "symlink", dates: bool = True) -> str:
    """Link or copy a file into a folder: what is there for the same file is used again, another name is taken for a clash.

    The file is made under a temporary name and linked to its own, which fails if that is taken: a task that runs twice finds what the first made.
    """
    os.makedirs(folder, exist_ok=True)
    stem, ext = os.path.splitext(name)
    made = os.path.join(folder, f".{uuid.uuid4().hex}")
    failed: OSError | None = None
    for kind in WAYS[way]:
        try:
            if kind == "symlink":
                os.symlink(os.path.abspath(source), made)
            elif kind == "hardlink":
                os.link(source, made)
            else:
                shutil.copyfile(source, made)
                stat = os.stat(source)
                if dates:
                    os.utime(made, ns=(stat.st_atime_ns, stat.st_mtime_ns))
            break
        except OSError as x:
            failed = x
    else:
        raise failed
    try:
        k, place = 0, os.path.join(folder, name)
        while not same_file(place, source, way):
            try:
                os.link(made, place, follow_symlinks=False)
            except FileExistsError:
                k += 1
                place = os.path.join(folder, f"{stem}_{k}{ext}")
        return place
    finally:
        os.remove(made)


def link_all(results: DataFrame, root: str, folder: str, way: str = "symlink", flatten: bool = False, dates: bool = True) -> DataFrame:
    """``results`` with link: the names are settled relationally, the files are made in the tasks, each in one attempt's order."""
    from pyspark.sql.types import StringType, StructField, StructType

    named = link_names(results, root, flatten)
    schema = StructType([*named.drop("link_name").schema.fields, StructField("link", StringType())])
    at = named.columns.index("path")
    last = named.columns.index("link_name")

    def run(batches):
        import pyarrow as pa

        for b in batches:
            made = [make_link(p, folder, n, way, dates) for p, n in zip(b.column(at).to_pylist(), b.column(last).to_pylist())]
            keep = [i for i in range(b.num_columns) if i != last]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in keep), pa.array(made, pa.string())], names=[*(b.schema.names[i] for i in keep), "link"])

    return named.mapInArrow(run, schema)
