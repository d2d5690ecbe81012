"""Session settings and the scratch folder used for checkpoints."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Runtime SQL settings every plan in this package is written for. On a cluster
# they belong in spark-defaults; nothing here changes a session it was given.
SQL_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.parquet.filterPushdown": "true",
    # "First n per key" is limited on the map side up to this n; a larger n is
    # still right, but all rows of a key are shuffled.
    "spark.sql.optimizer.windowGroupLimitThreshold": "100000",
    # Stream state off the heap.
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def local_session(cores: int | str = "*", app: str = "watchfold") -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    parallel = str(os.cpu_count() if cores == "*" else cores)
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("WATCHFOLD_DRIVER_MEMORY", "12g"))
        .config("spark.sql.shuffle.partitions", parallel)
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in SQL_SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder under ``spark.checkpoint.dir``.

    Driver and executors must share that folder, so a cluster has to name one.
    Only a session on one machine may leave the setting out.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = _local_scratch_base()
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


_LOCAL_BASE: str | None = None


def _local_scratch_base() -> str:
    global _LOCAL_BASE
    if _LOCAL_BASE is None:
        _LOCAL_BASE = tempfile.mkdtemp(prefix="watchfold-")
    return _LOCAL_BASE


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder and read it back.

    A written table survives lost executors and gives the next plan exact size
    statistics, which is what lets the optimiser choose a broadcast safely.
    """
    path = scratch_dir(df.sparkSession, "lineage")
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
