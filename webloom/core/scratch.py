"""Tables written to the shared folder, which cut lineage and survive lost executors.

The folder is the one the cluster names in spark.checkpoint.dir; only when the session names none
(tests, a laptop) is a local one set. Everything goes through Spark's writers and Hadoop's file
system, so any store that the executors share will do.
"""

from __future__ import annotations

import tempfile
import uuid
import warnings
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Spark's switch for removing a query's shuffle files as soon as the query has ended.
RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the session."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            warnings.warn("spark.checkpoint.dir is not set: intermediate tables go to a local folder, which executors on other machines do not see", stacklevel=2)
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="webloom-shared-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


@contextmanager
def _released(spark: SparkSession):
    """Queries that run within leave no shuffle files behind; what they wrote stands in for those."""
    before = spark.conf.get(RELEASE, "false")
    spark.conf.set(RELEASE, "true")
    try:
        yield
    finally:
        spark.conf.set(RELEASE, before)


class Scratch:
    """A folder of intermediate tables; dropped by name, or all at the end of the session."""

    def __init__(self, spark: SparkSession, purpose: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/webloom-{purpose}-{uuid.uuid4().hex}"
        self._named: set[str] = set()
        path, fs = self._fs(self.root)
        fs.mkdirs(path)
        fs.deleteOnExit(path)

    def _fs(self, name: str):
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(name)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """`df` as written and read again: no lineage, no inherited partitioning."""
        with _released(self.spark):
            df.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def _table(self, name: str) -> str:
        return "`" + f"{self.root.rsplit('/', 1)[-1]}_{name}".replace("-", "_").replace(".", "_") + "`"

    def bucketed(self, df: DataFrame, name: str, *keys: str, laid: bool = False) -> DataFrame:
        """As write, in as many buckets by `keys` as a shuffle has partitions and sorted within them: joins and
        groupings by those keys read the table where it lies, and only what meets it is shuffled.

        laid: `df` comes from a join by those keys with such a table, so its partitions are the buckets already.
        Its name is known to this session's catalogue until drop(), its files are in the shared folder."""
        n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        with _released(self.spark):
            rows = (df if laid else df.repartition(n, *keys)).write.mode("overwrite").format("parquet").option("path", self.path(name))
            rows.bucketBy(n, *keys).sortBy(*keys).saveAsTable(self._table(name))
        self._named.add(name)
        return self.spark.table(self._table(name))

    def append(self, df: DataFrame, name: str) -> None:
        """Adds rows to a table, which table() reads."""
        with _released(self.spark):
            df.write.mode("append").parquet(self.path(name))

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path(name))

    def drop(self, *names: str) -> None:
        for name in names:
            if name in self._named:
                self.spark.sql(f"drop table if exists {self._table(name)}")
                self._named.discard(name)
            path, fs = self._fs(self.path(name))
            fs.delete(path, True)
