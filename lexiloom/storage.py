"""Shared storage for iterative plans: driver loops write each step as a table that all executors can reread."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session. Where it is unset, a temporary folder serves a local master; a cluster is an error."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        kept = context._jsc.sc().getCheckpointDir()
        named = kept.get() if kept.isDefined() else None
    if not named:
        if not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="lexiloom-")
        context.setCheckpointDir(named)
    return named.rstrip("/")


def step_path(spark: SparkSession, name: str) -> str:
    """A new path below this application's folder of steps."""
    return f"{shared_dir(spark)}/lexiloom/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def clear_steps(spark: SparkSession) -> None:
    """Deletes the steps of this application, once no table read from them is needed any more."""
    jvm, path = spark.sparkContext._jvm, f"{shared_dir(spark)}/lexiloom/{spark.sparkContext.applicationId}"
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def step(df: DataFrame, name: str = "step") -> DataFrame:
    """``df`` written to the shared folder and read back: lineage ends here, and a lost executor costs a reread."""
    path = step_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is something at any path that Spark can read."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def share_code(spark: SparkSession) -> None:
    """Python workers find this package where the driver has found it, whatever folder they start in."""
    root, env = str(Path(__file__).resolve().parents[1]), spark.sparkContext.environment
    known = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in known:
        env["PYTHONPATH"] = os.pathsep.join([*known, root])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, read by Spark so that any Hadoop path works."""
    share_code(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
