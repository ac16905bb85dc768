"""Helpers shared by the operators of this subpackage: batches, cut lineage, connected components."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is ``spark.checkpoint.dir`` where the session has it. Where it is unset, a local session gets a
    temporary folder and any other session a folder below the warehouse; the setting is then kept for reuse.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found
    master = spark.sparkContext.master
    if master == "local" or master.startswith("local["):
        found = "file://" + tempfile.mkdtemp(prefix="metaseine-")
    else:
        found = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/metaseine-shared"
    try:
        spark.conf.set("spark.checkpoint.dir", found)
    except Exception:  # a static setting there: the folder then holds for this call alone
        pass
    return found


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/metaseine-{uuid.uuid4().hex}/{name}"


def cut(df: DataFrame, name: str = "table", path: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: no lineage, nothing held in executors."""
    spark = df.sparkSession
    path = path or fresh_path(spark, name)
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


#: Bytes of an Arrow batch between the engine and a worker, for tables with long texts.
BATCH_BYTES = 4 << 20


def bounded(df: DataFrame) -> DataFrame:
    """``df``, in a session whose Arrow batches hold no more than BATCH_BYTES, so that workers' memory does not follow text lengths."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    held = re.fullmatch(r"(\d+)b?", df.sparkSession.conf.get(name))
    if not held or not 0 < int(held[1]) <= BATCH_BYTES:
        df.sparkSession.conf.set(name, str(BATCH_BYTES))
    return df


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512, mb: int = 16) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of at most ``rows`` rows and about ``mb`` MB, so that long texts stay bounded.

    After the last one memory that is no longer used goes back to the system: workers live on for other tasks.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        step = max(1, min(rows, int(batch.num_rows * mb * 1e6 / max(1, batch.nbytes))))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)
    give_back()


def give_back() -> None:
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def crc_bucket(column: str, buckets: int):
    """crc32 of the id as text, modulo ``buckets``; null for a null id."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % buckets


def components(edges: DataFrame, name: str = "components", rounds: int = 60) -> DataFrame:
    """(node, component) for every node of the undirected ``edges`` (a, b): the smallest node that it reaches.

    Alternating large-star and small-star rounds; a round is a minimum per node (pre-aggregated on the map side) and
    an equi-join, which adaptive execution splits when a node has very many links. Each round ends in a written table.
    """
    spark = edges.sparkSession
    base = fresh_path(spark, name)
    pairs = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct()
    pairs = cut(pairs, path=f"{base}/0")
    print_of = (F.count("*"), F.expr("bit_xor(xxhash64(u, v))"))
    before = pairs.agg(*print_of).first()
    for k in range(1, rounds + 1):
        both = pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        pairs = cut(small.where("u > v").distinct(), path=f"{base}/{k}")
        remove(spark, f"{base}/{k - 1}")
        now = pairs.agg(*print_of).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"no fixed point of the components after {rounds} rounds")
    roots = pairs.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)


def likely(ids: DataFrame, column: str, bits: int = 24):
    """A Bloom filter of the ids as a numpy array of 2**bits bits, two a key: at most 2 MB at the default, however many ids.

    It only spares work: with too many ids all pass, and what passes is still joined.
    """
    import numpy as np

    mask = (1 << bits) - 1
    at = F.explode(F.array(F.xxhash64(F.col(column).cast("long")).bitwiseAND(mask), F.shiftrightunsigned(F.xxhash64(F.col(column).cast("long")), 32).bitwiseAND(mask)))
    words = ids.select(at.alias("p")).select((F.shiftright("p", 6)).alias("w"), F.expr("shiftleft(1L, cast(p & 63 as int))").alias("b")).groupBy("w").agg(F.bit_or("b").alias("b")).toPandas()
    out = np.zeros(1 << max(0, bits - 6), np.int64)
    out[words["w"].to_numpy(np.int64)] = words["b"].to_numpy(np.int64)
    return out


def placed(df: DataFrame, column: str, bits: int = 24) -> DataFrame:
    """``df`` with the two places of each id in a filter as its last columns, for ``may_hold``."""
    mask = (1 << bits) - 1
    h = F.xxhash64(F.col(column).cast("long"))
    return df.withColumns({"__p": h.bitwiseAND(mask), "__q": F.shiftrightunsigned(h, 32).bitwiseAND(mask)})


def may_hold(words, batch: pa.RecordBatch) -> pa.RecordBatch:
    """The rows of a batch of ``placed`` whose id may be in the filter ``words``, without the places."""
    p, q = (batch.column(batch.num_columns - i).to_numpy() for i in (2, 1))
    good = (words[p >> 6] >> (p & 63)) & (words[q >> 6] >> (q & 63)) & 1
    return batch.filter(pa.array(good.astype(bool))).select(list(range(batch.num_columns - 2)))


def keep_likely(df: DataFrame, column: str, bloom, bits: int = 24) -> DataFrame:
    """The rows of ``df`` whose id may be in the filter, tested before anything is shuffled."""
    held = df.sparkSession.sparkContext.broadcast(bloom)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield may_hold(held.value, b)

    return placed(df, column, bits).mapInArrow(run, df.schema)
