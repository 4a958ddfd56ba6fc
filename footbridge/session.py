"""Session settings and the one way this package cuts lineage.

Iterative operators (relation closure, frontier expansion, shortest walks) end
every round by writing the round's table to the cluster's shared checkpoint
folder and reading it back. That bounds the plan, survives lost executors, and
gives the next round true file statistics, so Spark itself decides from the
measured size whether a side may be broadcast.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

# Settings that may be changed on a running session.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # split a skewed join even where that costs an extra exchange
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
    # state of streams lives on disk and carries timers
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the settings the operators count on to an existing session."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def local_session(cores: str = "*", name: str = "footbridge", **extra: str) -> SparkSession:
    """A single-machine session for tests and the bench."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.shuffle.partitions", "8")
        # call-site capture costs several driver round trips per column expression
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    for key, value in extra.items():
        builder = builder.config(key, value)
    return tune(builder.getOrCreate())


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; a temporary one only in a session on one machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if current is None:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="footbridge-"))
        current = spark.sparkContext.getCheckpointDir()
    return current.rstrip("/")


def materialise(df: DataFrame, **metrics: Column) -> tuple[DataFrame, dict]:
    """Write ``df`` as a table in the shared folder and return it read back.

    ``metrics`` are aggregate columns observed while writing, so a loop learns
    whether anything changed without a second job.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/cut-{uuid.uuid4().hex}"
    if metrics:
        watch = Observation()
        df = df.observe(watch, *[c.alias(k) for k, c in metrics.items()])
    df.write.parquet(path)
    seen = watch.get if metrics else {}
    return spark.read.schema(df.schema).parquet(path), seen


def cut(df: DataFrame) -> DataFrame:
    """``materialise`` without metrics."""
    return materialise(df)[0]


def count_true(flag: Column) -> Column:
    """Null-free count of true rows, for ``materialise`` metrics."""
    return F.coalesce(F.sum(F.when(flag, F.lit(1)).otherwise(F.lit(0))), F.lit(0))
