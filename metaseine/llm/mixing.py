"""Mixing sources to target weights by Poisson replication.

A source's target rate is the mean number of times that a document of it is to be seen. A document's number of copies is the
inverse of the Poisson distribution of that mean at a uniform number hashed from seed and id, so it is the same wherever and
whenever it is computed; each copy is a row of its own, and all rows are shuffled globally by a hash of seed, id and copy.

Rates: by default the share of a source's characters in the mixture is its weight over all weights, and a weight is the
source's characters to the power ``temperature``; ``budget`` is the length of the mixture in lengths of the input. Weights by name
may be given instead (sources not named get none). Sizes are summed over all rows before they meet a document.

A null source is a source of its own. A source without characters has the rate ``budget``. Null texts have no characters but are
replicated like others. Rows without an id, and rows whose id another row has too, are told apart by their position in the table, so that each has a
number of copies and keys of its own. Columns called copy_no and shuffle_key are replaced.

A rate above ``MOST`` is drawn as a sum of independent Poisson numbers of rates up to ``MOST``, each at a uniform number of its own. Copies
of a source with a high rate are made ``CHUNK`` at a time, the chunks spread over the tasks. Every row has a shuffle_key of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import cut

SEED, TEMPERATURE, BUDGET = 17, 0.5, 1.0
#: Sources up to which their rates are broadcast; more of them are joined.
BROADCAST_ROWS = 10_000
#: The greatest rate of one draw: exp(-rate) is a normal number up to about 708.
MOST = 500.0
#: Copies of a row that one task makes at a time.
CHUNK = 1000


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) with 52 bits, from the MD5 of the parts."""
    text = F.md5(F.concat_ws(":", *parts).cast("binary"))
    return F.conv(F.substring(text, 1, 13), 16, 10).cast("double") / F.lit(float(16**13))


def poisson_inverse(rate: Column, u: Column) -> Column:
    """The least k with P(X <= k) > u for X of the Poisson distribution with mean ``rate``."""
    start = F.struct(F.exp(-rate).alias("p"), F.lit(0.0).alias("sum"), F.lit(0).alias("k"))
    most = F.ceil(rate + 12 * F.sqrt(rate) + 40).cast("int")

    def step(acc: Column, k: Column) -> Column:
        total = acc["sum"] + acc["p"]
        return F.struct((acc["p"] * rate / (k + 1)).alias("p"), total.alias("sum"), (acc["k"] + F.when(total <= u, 1).otherwise(0)).alias("k"))

    return F.aggregate(F.sequence(F.lit(0), most), start, step, lambda acc: acc["k"])


def poisson(rate: Column, *parts: Column) -> Column:
    """A Poisson number of mean ``rate`` from the hash of the parts; the first of several draws is the one of a rate up to MOST."""
    draws = F.greatest(F.ceil(rate / MOST), F.lit(1)).cast("int")
    rest = F.sequence(F.lit(1), draws - 1)
    more = F.aggregate(rest, F.lit(0), lambda n, i: n + poisson_inverse(rate / draws, uniform(*parts, F.lit("draw"), i.cast("string"))))
    first = poisson_inverse(rate / draws, uniform(*parts))
    return F.when(draws > 1, first + more).otherwise(first)


def rates(documents: DataFrame, weights: dict[str, float] | None = None, temperature: float = TEMPERATURE, budget: float = BUDGET, source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(source, rate) for each source of ``documents``."""
    sizes = documents.groupBy(F.col(source_col).alias("source")).agg(F.sum(F.coalesce(F.char_length(text_col), F.lit(0))).cast("double").alias("size"))
    weight = F.pow("size", F.lit(temperature)) if weights is None else F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in weights.items() for x in kv)), F.coalesce("source", F.lit(""))), F.lit(0.0))
    sizes = sizes.withColumn("weight", weight)
    total = sizes.agg(F.sum("size").alias("size"), F.sum("weight").alias("weight")).first()
    share = F.col("weight") / F.lit(total["weight"] or 1.0) * F.lit(total["size"] or 0.0) * F.lit(budget)
    return sizes.select("source", F.when(F.col("size") > 0, share / F.col("size")).otherwise(F.lit(budget)).alias("rate"))


def named(documents: DataFrame, id_col: str) -> DataFrame:
    """``documents`` with __at, the row's position, and __name: the id as text, with the position where the id is null or not the row's alone."""
    rows = documents.withColumn("__at", F.monotonically_increasing_id())
    text, at = F.col(id_col).cast("string"), F.concat(F.lit("@"), F.col("__at").cast("string"))
    again = cut(documents.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("__again")).agg(F.count("*").alias("n")).where("n > 1").select("__again"), "repeated")
    n = again.count()
    if not n:
        return rows.withColumn("__name", F.coalesce(text, at))
    again = F.broadcast(again) if n <= BROADCAST_ROWS else again
    return rows.join(again, F.col(id_col) == F.col("__again"), "left").withColumn("__name", F.when(F.col(id_col).isNull() | F.col("__again").isNotNull(), F.concat(F.coalesce(text, F.lit("")), at)).otherwise(text)).drop("__again")


def replicate(documents: DataFrame, weights: dict[str, float] | None = None, temperature: float = TEMPERATURE, budget: float = BUDGET, seed: int = SEED, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """``documents``, a row for each copy, with copy_no from 0 and shuffle_key, in the order of shuffle_key within partitions by it."""
    table = cut(rates(documents, weights, temperature, budget, source_col, text_col), "rates")
    small = table.select(F.col("source").alias("__source"), F.col("rate").alias("__rate"))
    n, most = table.agg(F.count("*"), F.max("rate")).first()
    if n <= BROADCAST_ROWS:
        small = F.broadcast(small)
    docs = documents.drop("copy_no", "shuffle_key")
    name = F.col("__name")
    count = poisson(F.col("__rate"), F.lit(str(seed)), name)
    many = named(docs, id_col).join(small, F.col(source_col).eqNullSafe(F.col("__source"))).withColumn("__n", count).where("__n > 0")
    if (most or 0) <= CHUNK:
        copies = many.withColumn("copy_no", F.explode(F.expr("sequence(0, __n - 1)")))
    else:
        chunks = many.withColumn("__chunk", F.explode(F.expr(f"sequence(0, cast((__n - 1) div {CHUNK} as int))"))).repartition("__at", "__chunk")
        copies = chunks.withColumn("copy_no", F.explode(F.expr(f"sequence(__chunk * {CHUNK}, least(__n, (__chunk + 1) * {CHUNK}) - 1)")))
    copies = copies.withColumn("shuffle_key", F.md5(F.concat_ws(":", F.lit(str(seed)), name, F.col("copy_no").cast("string")).cast("binary")))
    return copies.select(*docs.columns, "copy_no", "shuffle_key").repartition("shuffle_key").sortWithinPartitions("shuffle_key")
