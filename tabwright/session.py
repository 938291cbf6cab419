"""Session helpers shared by the operators that need a little configuration."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(name: str = "tabwright", cores: str = "*", partitions: int = 8) -> SparkSession:
    """A session for tests and the bench; a cluster brings its own."""
    # Scratch files go beside the shuffle data, not into the working folder.
    warehouse = os.path.join(tempfile.gettempdir(), "tabwright-warehouse")
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.warehouse.dir", warehouse)
        .config("spark.ui.enabled", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def shared_folder(spark: SparkSession) -> str | None:
    """The folder that driver and executors share; None in local mode without one, an error on a cluster without one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None and not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return named


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder the cluster names; fall back to a new local one only where none is set."""
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    context.setCheckpointDir(shared_folder(spark) or tempfile.mkdtemp(prefix="tabwright-checkpoint-"))


def cut_lineage(df: DataFrame, keep_layout: bool = False) -> DataFrame:
    """Write an iteration's state to the checkpoint folder so that lost executors cost one round only.

    With ``keep_layout`` later joins know by which columns the rows are dealt and sorted, and do not shuffle them again;
    Spark forgets that of plans it adapts while they run.
    """
    ensure_checkpoint_dir(df.sparkSession)
    if not keep_layout:
        return df.checkpoint(eager=True)
    conf, name = df.sparkSession.conf, "spark.sql.adaptive.enabled"
    before = conf.get(name)
    conf.set(name, "false")
    try:
        # a new plan, as the given one may have been made already
        return df.select("*").checkpoint(eager=True)
    finally:
        conf.set(name, before)
