"""Session defaults and the one shared scratch location that all operators use."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


#: Bytes of an Arrow batch, where the session says nothing: 10,000 long texts at once would cost executors and workers far more than they need.
_BATCH = ("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))


def importable(spark: SparkSession) -> None:
    """Let Python workers on this machine import the package (on a cluster it is shipped with the job), and bound their batches by bytes."""
    if not spark._jsparkSession.conf().contains(_BATCH[0]):
        spark.conf.set(*_BATCH)
    env, root = spark.sparkContext.environment, str(Path(__file__).resolve().parent.parent)
    known = env.get("PYTHONPATH", "").split(os.pathsep)
    if root not in known and root not in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join([root, *filter(None, known)])


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary one is set only where none is configured on one machine (tests)."""
    current = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not current:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        current = tempfile.mkdtemp(prefix="loomspark-")
        spark.sparkContext.setCheckpointDir(current)
        current = spark.sparkContext.getCheckpointDir()
    return current


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write a DataFrame as Parquet into the shared folder and read it back: lineage ends here, and lost executors lose nothing."""
    spark = df.sparkSession
    importable(spark)
    path = f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch = path
    return out


def release(*frames: DataFrame) -> None:
    """Delete the files of materialised DataFrames that nothing will read any more."""
    for df in frames:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.scratch)
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    importable(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame, below_mb: int = 64) -> DataFrame:
    """A small table dealt out over all cores: its few row groups would else give few tasks. Larger tables are left as they are."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if size < below_mb << 20 else df
