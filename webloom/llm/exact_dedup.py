"""Exact deduplication by sorting content.

Whole normalised texts are range-partitioned by sampled splitters and sorted, so that equal texts
lie side by side; a window over the sorted run compares each neighbour in full and keeps the
smallest identifier. A range partition cannot hold one text twice, so a text with very many copies
would pile up in one task. Such texts are found beforehand by counting 64-bit hashes (pre-aggregated,
8 bytes a row); their rows are dealt over several runs by a hash of the identifier, and the few rows
that the runs keep are merged by their whole text. Splitters are sampled on the sort key's bounded
head (a prefix and a hash of the text), so what the driver sees of them does not grow with the texts;
whole texts decide who is equal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from webloom.core.scratch import Scratch

WHITE = r"[\x20\x09-\x0D]+"
#: Characters of the text that lead the sort key.
HEAD = 32
#: Copies of a text that one sorted run holds at most, and texts with more copies that are broadcast
#: (16 bytes each); of these the latter holds where it must, beyond RUN_ROWS * HOT_TEXTS rows.
RUN_ROWS, HOT_TEXTS = 100_000, 1_000_000


def normalised(text: Column) -> Column:
    """The text with each run of white space as one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITE, " ")


def copies_of_a_run(rows: int, runs: int) -> int:
    """rows / runs while that is under RUN_ROWS, and then RUN_ROWS; at least rows / HOT_TEXTS."""
    return max(2, min(-(-rows // runs), max(RUN_ROWS, -(-rows // HOT_TEXTS))))


def _spread(docs: DataFrame, id_col: str, text_col: str) -> Column:
    """A hash of all but the text, so copies whose ids are null or repeat go to several runs too."""
    columns = [f.name for f in docs.schema if f.name != text_col and isinstance(f.dataType, T.AtomicType) and not isinstance(f.dataType, T.VariantType)]
    return F.xxhash64(F.lit("run"), F.col(f"`{id_col}`"), *[F.col(f"`{c}`") for c in columns if c != id_col])


def _keyed(rows: DataFrame, runs: int, scratch: Scratch) -> DataFrame:
    """`rows` (id, norm, spread, ..) with their sort key: head, h and run (-1 unless the text is hot)."""
    rows = rows.withColumn("h", F.xxhash64("norm"))
    limit = copies_of_a_run(rows.count(), runs)
    hot = scratch.write(rows.groupBy("h").count().where(F.col("count") > limit), "hot")
    dealt = F.pmod("spread", F.ceil(F.col("count") / limit).cast("long"))
    rows = rows.join(F.broadcast(hot), "h", "left")  # HOT_TEXTS at most
    return rows.withColumns({"head": F.substring("norm", 1, HEAD), "run": F.coalesce(dealt, F.lit(-1))}).drop("count", "spread")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", runs: int = 1000) -> DataFrame:
    """One row per input row: (id, keep_id, group_size, kept, text_sha256).

    runs: a text with more than one copy in `runs` rows, or more than RUN_ROWS copies, is dealt over
    several sorted runs by a hash of its row's other columns; rows that are equal in all of them share
    a run. There can be no more than HOT_TEXTS such texts, which bounds what is broadcast. Null texts equal empty ones. A null id counts as larger than any other; a group of
    null ids only has a null keep_id and keeps one of its rows. When one id repeats with the same
    text, one of its rows is kept. Other columns change nothing in the result. An empty table gives no rows.
    Texts of any length are compared whole; a text is one value of a row and must fit a task's memory.
    """
    scratch = Scratch(docs.sparkSession, "exact")
    rows = docs.select(F.col(id_col).alias("id"), normalised(F.col(text_col)).alias("norm"), _spread(docs, id_col, text_col).alias("spread"))
    rows = _keyed(rows, runs, scratch)
    group = Window.partitionBy("head", "h", "run", "norm")
    first = group.orderBy(F.col("id").asc_nulls_last())
    runs_df = rows.repartitionByRange("head", "h", "run").select(
        "id",
        F.first("id").over(first).alias("keep"),
        F.row_number().over(first).alias("nth"),
        F.count(F.lit(1)).over(group).alias("n"),
        "run",
        F.sha2("norm", 256).alias("sha"),
        F.when((F.col("run") >= 0) & (F.row_number().over(first) == 1), F.col("norm")).alias("kept_text"),
    )
    runs_df = scratch.write(runs_df, "runs")
    merged = runs_df.where("kept_text is not null").groupBy("kept_text")
    merged = merged.agg(
        F.min(F.struct(F.col("keep").isNull().alias("o"), "keep", "run")).alias("m"), F.sum("n").alias("all"), F.first("sha").alias("sha")
    ).select("sha", F.col("m.keep").alias("all_keep"), F.col("m.run").alias("all_run"), "all")
    merged = scratch.write(merged, "merged")  # no more rows than `hot`; broadcast if Spark finds it small
    out = runs_df.drop("kept_text").join(merged, "sha", "left")
    here = (F.col("run") < 0) | (F.col("run") == F.col("all_run"))
    return out.select(
        F.col("id").alias(id_col),
        F.when(F.col("run") < 0, F.col("keep")).otherwise(F.col("all_keep")).alias("keep_id"),
        F.coalesce("all", "n").alias("group_size"),
        ((F.col("nth") == 1) & here).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", runs: int = 1000) -> DataFrame:
    """The rows that exact_groups keeps, with their columns as they were.

    Whole rows go through the sort, so the texts are shuffled once and nothing is looked up later;
    the normalised text is made anew behind the shuffle. Of rows that share id and text one stays,
    and so does one of a group of null ids only. Column names are free, as rows travel as one struct.
    """
    scratch = Scratch(docs.sparkSession, "exact-drop")
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rows = docs.select(F.col(id_col).alias("id"), normalised(F.col(text_col)).alias("norm"), _spread(docs, id_col, text_col).alias("spread"), whole)
    rows = _keyed(rows, runs, scratch).drop("norm").repartitionByRange("head", "h", "run")
    rows = rows.withColumn("norm", normalised(F.col("row")[text_col]))
    first = Window.partitionBy("head", "h", "run", "norm").orderBy(F.col("id").asc_nulls_last())
    rows = rows.withColumn("nth", F.row_number().over(first)).where("nth = 1")
    kept = scratch.write(rows.select("row", "id", "run", F.when(F.col("run") >= 0, F.col("norm")).alias("norm")), "first")
    of_runs = kept.where("run >= 0")  # no more rows than hot texts have runs
    best = of_runs.groupBy("norm").agg(F.min(F.struct(F.col("id").isNull().alias("o"), "id", "run")).alias("m"))
    best = scratch.write(best.select(F.sha2("norm", 256).alias("sha"), F.col("m.run").alias("run")), "best")
    merged = of_runs.withColumn("sha", F.sha2("norm", 256)).join(best, ["sha", "run"], "left_semi")
    return kept.where("run < 0").select("row.*").union(merged.select("row.*"))
