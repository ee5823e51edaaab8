"""Session construction with the settings the operators are planned for."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Sends this package to the workers, which need it whether or not they have it installed."""
    package = Path(__file__).resolve().parent.parent
    name = Path(tempfile.mkdtemp(prefix="webloom-")) / "webloom.zip"
    with zipfile.ZipFile(name, "w") as out:
        for f in sorted(package.rglob("*.py")):
            out.write(f, f.relative_to(package.parent))
    spark.sparkContext.addPyFile(str(name))


def session(master: str | None = None, partitions: int | None = None, app: str = "webloom", **conf: str) -> SparkSession:
    """A session with adaptive execution on; `master` is left to the cluster when None."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    if partitions:
        settings["spark.sql.shuffle.partitions"] = str(partitions)
    if master and master.startswith("local"):
        settings["spark.driver.memory"] = os.environ.get("WEBLOOM_DRIVER_MEMORY", "12g")
    for k, v in {**settings, **conf}.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    ship(spark)
    return spark
