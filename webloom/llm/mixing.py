"""Mixing sources to target weights by Poisson replication, with DataFrame operations only.

Every document is repeated a Poisson-distributed number of times whose mean is the repetition rate
that its source's target asks for. The draw inverts the distribution at a number hashed from the
seed and the document's identifier, so it needs no state, no order and no second look at the data:
a lost task draws the same counts again. The copies are then dealt globally by a hash.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from webloom.core.scratch import Scratch

#: A rate above this is drawn as a sum of independent draws of equal, smaller rates.
PART = 32.0
#: Terms of the distribution at a rate of PART: what lies beyond has less than 1e-17 of its mass.
TERMS = 120
HEX, BITS = 13, 52


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of the MD5 of the parts joined by ':'."""
    digest = F.md5(F.concat_ws(":", *[p.cast("string") for p in parts]))
    return F.conv(F.substring(digest, 1, HEX), 16, 10).cast("double") / F.lit(float(2**BITS))


def cumulative(rate: Column) -> Column:
    """P(X <= k) for k = 0 .. TERMS - 1, as an array; from where it stops growing, it only repeats."""
    terms = F.aggregate(
        F.sequence(F.lit(1), F.lit(TERMS - 1)),
        F.struct(F.exp(-rate).alias("term"), F.array(F.exp(-rate)).alias("all")),
        lambda acc, i: F.struct(
            (acc["term"] * rate / i).alias("term"), F.concat(acc["all"], F.array(F.element_at(acc["all"], -1) + acc["term"] * rate / i)).alias("all")
        ),
        lambda acc: acc["all"],
    )
    return terms


def source_rates(docs: DataFrame, weights: Mapping[str, float] | None, rows_out: float | None, alpha: float, source_col: str) -> DataFrame:
    """(source, count, rate, cdf, parts): the mean number of copies of each document of a source.

    weights: the share of the result that each source should have, in any unit; sources that it does
    not name get none. None: shares follow count ** alpha. A null source is a source like any other.
    """
    counts = docs.groupBy(F.col(source_col).alias("source")).agg(F.count(F.lit(1)).alias("count"))
    if weights is None:
        counts = counts.withColumn("share", F.pow(F.col("count").cast("double"), F.lit(alpha)))
    else:
        pairs = [F.when(F.col("source") == F.lit(k), F.lit(float(v))) for k, v in weights.items() if k is not None]
        pairs += [F.when(F.col("source").isNull(), F.lit(float(v))) for k, v in weights.items() if k is None]
        counts = counts.withColumn("share", F.coalesce(*pairs, F.lit(0.0)))
    total = counts.agg(F.sum("share").alias("shares"), F.sum("count").alias("rows"))
    size = F.lit(float(rows_out)) if rows_out is not None else F.col("rows").cast("double")
    rate = F.when(F.col("shares") > 0, size * F.col("share") / F.col("shares") / F.col("count")).otherwise(0.0)
    counts = counts.crossJoin(F.broadcast(total)).withColumn("rate", rate)  # `total` is one row
    parts = F.greatest(F.ceil(F.col("rate") / PART), F.lit(1)).cast("int")
    return counts.withColumn("parts", parts).withColumn("cdf", F.array_distinct(cumulative(F.col("rate") / F.col("parts")))).select("source", "count", "rate", "parts", "cdf")


def mix(
    docs: DataFrame,
    weights: Mapping[str, float] | None = None,
    rows_out: float | None = None,
    alpha: float = 0.5,
    seed: int = 17,
    id_col: str = "doc_id",
    source_col: str = "source",
    shuffle: bool = True,
) -> DataFrame:
    """The documents, each as often as its draw says, with mix_copy (from 0) and mix_key.

    rows_out: expected rows of the result (None: as many as came in). mix_key is a hash of the seed,
    identifier, copy, source and numeric columns, so rows whose identifiers are null or repeat are
    spread too; with `shuffle`, rows are dealt over partitions and sorted by it, so any source
    is spread over all written files and the order within them is the training order. Rows of one identifier share a draw; a null identifier
    draws like any other value. Columns and their types stay as they are. An empty table gives no rows;
    texts of any length are only carried along.
    """
    key, taken = "_mix", {c.lower() for c in docs.columns}
    while key in taken:
        key += "_"
    # written first, so Spark knows its size: it is broadcast if small, and joined with skew handling if not
    rates = Scratch(docs.sparkSession, "mixing").write(source_rates(docs, weights, rows_out, alpha, source_col), "rates")
    rates = rates.select(F.struct("source", "rate", "parts", "cdf").alias(key))
    drawn = docs.join(rates, docs[source_col].eqNullSafe(F.col(f"{key}.source")))
    identity = F.coalesce(F.col(id_col).cast("string"), F.lit("null"))
    # the number is bound to a variable first, or it would be hashed anew for every term
    draw = lambda part: F.transform(F.array(uniform(F.lit(seed), part, identity)), lambda u: F.size(F.filter(F.col(f"{key}.cdf"), lambda c: c <= u)))[0]
    # one draw in the common case; the sum of several where the rate is above PART
    one = draw(F.lit(0))
    several = F.aggregate(F.sequence(F.lit(0), F.col(f"{key}.parts") - 1), F.lit(0), lambda acc, i: acc + draw(i))
    copies = F.when(F.col(f"{key}.parts") == 1, one).otherwise(several)
    drawn = drawn.withColumn(key, F.when(copies > 0, F.sequence(F.lit(0), copies - 1))).where(F.col(key).isNotNull())
    out = drawn.select("*", F.explode(key).alias("mix_copy")).drop(key)
    columns = [f.name for f in docs.schema if isinstance(f.dataType, T.NumericType) or f.name in (id_col, source_col)]
    out = out.withColumn("mix_key", F.xxhash64(F.lit(seed), identity, "mix_copy", *[F.col(f"`{c}`") for c in columns]))
    return out.repartition("mix_key").sortWithinPartitions("mix_key") if shuffle else out
