"""Session helpers shared by the operators: lineage cuts, table loading, size-checked broadcasts."""

from __future__ import annotations

import atexit
import importlib.util
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only if it provably has no more rows than this; beyond it the join shuffles.
BROADCAST_ROWS = 20_000


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once per context, so that Python operators run where it isn't installed."""
    sc = spark.sparkContext
    if getattr(sc, "_ledgerwright_shipped", False):
        return
    sc._ledgerwright_shipped = True
    home = Path(importlib.util.find_spec("ledgerwright").origin).parent
    if home.parent.suffix == ".zip":
        return
    made = tempfile.mkdtemp(prefix="ledgerwright-")
    atexit.register(shutil.rmtree, made, ignore_errors=True)
    stage = Path(made, "stage", "ledgerwright")
    shutil.copytree(home, stage, ignore=shutil.ignore_patterns("__pycache__"))
    sc.addPyFile(shutil.make_archive(str(Path(made, "ledgerwright")), "zip", stage.parent))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, *columns: str) -> DataFrame:
    """`df` (its named columns) in as many partitions as there are cores, if it has fewer.

    A small compressed file is one split, however much work its texts are. Larger tables have enough splits: they pass
    through as they are, without a shuffle.
    """
    df = df.select(*columns) if columns else df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def cut(df: DataFrame) -> DataFrame:
    """`df` with its lineage cut by a reliable checkpoint in the folder the cluster names, spark.checkpoint.dir.

    Only where the driver is the one executor (local mode) may it be unset: a folder of our own is made then, and removed
    at the end. On a cluster it would be on the disk of one machine, so it is refused. What is no longer used is removed by
    spark.cleaner.referenceTracking.cleanCheckpoints, if the session has it.
    """
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None and (named := spark.conf.get("spark.checkpoint.dir", None)):
        spark.sparkContext.setCheckpointDir(named)
    if spark.sparkContext.getCheckpointDir() is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        own = tempfile.mkdtemp(prefix="ledgerwright-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(own)
    return df.checkpoint()


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """A broadcast hint after counting at most `limit` + 1 rows; a larger side stays unhinted and shuffles."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df
