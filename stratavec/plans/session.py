"""Session defaults and table loading."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

from stratavec.operators.vector import Vector
from stratavec.sources.generate import column


def session(cpus: str = "8", memory: str = "8g") -> SparkSession:
    """A local session for tests and timing."""
    return (
        SparkSession.builder.master(f"local[{cpus}]").appName("stratavec").config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.driver.memory", memory)
        .config("spark.sql.python.filterPushdown.enabled", "true").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vector(spark: SparkSession, sf_dir: str, name: str, value, key: str, kind: str | None = None) -> Vector:
    """A table's column, positioned by its contiguous key."""
    df = table(spark, sf_dir, name)
    return column(df, value, df[key] + 1, kind=kind)


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder that driver and executors share: under spark.checkpoint.dir, else (on one machine) the temp folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    base = base.removeprefix("file://") if base else tempfile.gettempdir()
    os.makedirs(base, exist_ok=True)
    return tempfile.mkdtemp(prefix=f"{name}-", dir=base)
