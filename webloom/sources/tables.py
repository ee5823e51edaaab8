"""Tables, seed files and exports."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from webloom.core.schemas import TABLES
from webloom.core.scratch import Scratch


def read_seeds(spark: SparkSession, path: str) -> DataFrame:
    """(seed) of a text file: a name a line; blank lines and lines that start with # are left out."""
    lines = spark.read.text(path).where(~F.col("value").startswith("#"))
    return lines.select(F.trim("value").alias("seed")).where("seed <> ''")


def read_words(spark: SparkSession, path: str) -> DataFrame:
    """(seq, word) of a word list, in file order."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\r?\n")).alias("seq", "word"))
    return lines.select(F.col("seq").cast("long").alias("seq"), F.trim("word").alias("word")).where("word <> ''")


def split_list(text: str) -> list[str]:
    return [x for x in (p.strip() for p in text.split(",")) if x]


def write_seeds(domains: DataFrame, path: str) -> None:
    """One sorted name a line."""
    domains.select("domain").distinct().orderBy("domain").coalesce(1).write.mode("overwrite").text(path)


#: Keys of the stored tables: a table is partitioned by their hash.
KEYS = {"domains": ("domain",), "pages": ("url",), "crypto_addresses": ("address",), "graph_edges": ("src", "dst")}
#: Parts that a new store deals each table to; a store keeps the number it began with.
BUCKETS = 64
_NUMBERS = "name string, number long"

#: The new rows of a table from its old ones and a batch.
Step = Callable[[DataFrame, DataFrame], DataFrame]


class Store:
    """The four tables under a folder, each partitioned by a hash of its key.

    A commit reads and rewrites only the partitions that its batches have keys of. It first writes the new
    partitions of all its tables aside, with the numbers that go with them, and then puts them in the old
    ones' place by dynamic partition overwrite. What is aside is whole or does not count, and can be put in
    place any number of times, so a commit that dies is finished by whoever comes next. Commits, and reads
    that overlap with one, take turns: there is one writer, and no reader while it puts partitions in place.
    """

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS):
        self.spark, self.root = spark, root.rstrip("/")
        self._scratch = Scratch.__new__(Scratch)
        self._scratch.spark, self._scratch.root, self._scratch._named = spark, self.root, set()
        self.buckets = self.numbers().get("buckets", buckets)

    def _listed(self, folder: str) -> list[str]:
        path, fs = self._scratch._fs(f"{self.root}/{folder}")
        return sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []

    def _done(self, folder: str) -> bool:
        path, fs = self._scratch._fs(f"{self.root}/{folder}/_SUCCESS")
        return fs.exists(path)

    def numbers(self) -> dict[str, int]:
        """Numbers of the last finished commit: last batches of streams, the last id of a page, the partitions."""
        done = [n for n in self._listed("_numbers") if self._done(f"_numbers/{n}")]
        if not done:
            return {}
        return {r.name: r.number for r in self.spark.read.schema(_NUMBERS).json(f"{self.root}/_numbers/{done[-1]}").collect()}  # a row a stream

    def mark(self, stream: str) -> int:
        """The number of the last batch of a stream that the tables hold, or -1."""
        self.recover()
        return self.numbers().get(f"stream {stream}", -1)

    def bucket(self, name: str) -> Column:
        return F.pmod(F.xxhash64(*KEYS[name]), F.lit(self.buckets)).cast("int")

    def _parts(self, name: str) -> DataFrame:
        schema = T.StructType([*TABLES[name], T.StructField("bucket", T.IntegerType())])
        if not self._listed(name):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.root}/{name}")

    def read(self, name: str) -> DataFrame:
        self.recover()
        return self._parts(name).drop("bucket")

    def one(self, name: str, *values: str) -> DataFrame:
        """Rows with a key: one partition is listed, and the filter reaches its scan."""
        self.recover()
        given = self.spark.range(1).select(*[F.lit(v).alias(k) for k, v in zip(KEYS[name], values, strict=True)])
        (at,) = given.select(self.bucket(name)).first()
        rows = self._parts(name).where(F.col("bucket") == at).drop("bucket")
        for key, value in zip(KEYS[name], values, strict=True):
            rows = rows.where(F.col(key) == value)
        return rows

    def commit(self, changes: dict[str, tuple[Step, DataFrame]], mark: tuple[str, int] | None = None, numbers: dict[str, int] | None = None) -> bool:
        """Replaces the touched partitions of each table by step(their rows, batch), all tables or none.

        mark: (stream, number) of the batches; those of a number that the tables hold already change nothing,
        and the answer is False. numbers: others to keep with the tables."""
        self.recover(drop=True)
        before = self.numbers()
        if mark and before.get(f"stream {mark[0]}", -1) >= mark[1]:
            return False
        aside = f"_pending/{uuid.uuid4().hex}"
        for name, (step, batch) in changes.items():
            touched = [r.b for r in batch.select(self.bucket(name).alias("b")).distinct().collect()]  # `buckets` at most
            old = self._parts(name).where(F.col("bucket").isin(touched)).drop("bucket")
            new = step(old, batch).select(*TABLES[name].names).withColumn("bucket", self.bucket(name))
            if touched:
                new.hint("rebalance", "bucket").write.partitionBy("bucket").parquet(f"{self.root}/{aside}/tables/{name}")
        kept = before | (numbers or {}) | ({f"stream {mark[0]}": mark[1]} if mark else {}) | {"buckets": self.buckets}
        self.spark.createDataFrame(list(kept.items()), _NUMBERS).coalesce(1).write.json(f"{self.root}/{aside}/numbers")  # from here on it counts
        self.recover()
        return True

    def recover(self, drop: bool = False) -> None:
        """Puts in place what a commit has written aside whole. drop: the rest is dropped, as a writer may."""
        for run in self._listed("_pending"):
            aside = f"_pending/{run}"
            if self._done(f"{aside}/numbers"):
                for name in self._listed(f"{aside}/tables"):
                    rows = self.spark.read.schema(T.StructType([*TABLES[name], T.StructField("bucket", T.IntegerType())])).parquet(f"{self.root}/{aside}/tables/{name}")
                    rows.hint("rebalance", "bucket").write.partitionBy("bucket").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(f"{self.root}/{name}")
                known = self._listed("_numbers")
                last = f"_numbers/{int(known[-1]) + 1 if known else 0:09d}"
                self.spark.read.schema(_NUMBERS).json(f"{self.root}/{aside}/numbers").coalesce(1).write.json(f"{self.root}/{last}")
                self._scratch.drop(*(f"_numbers/{n}" for n in known[:-1]), aside)
            elif drop:
                self._scratch.drop(aside)
