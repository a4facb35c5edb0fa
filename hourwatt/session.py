"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_SETTING = "spark.checkpoint.dir"


def prepare_session(spark: SparkSession) -> SparkSession:
    """Pin the UTC session time zone that every operator relies on."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """Return the cluster's shared checkpoint folder.

    The cluster names it in ``spark.checkpoint.dir``. Where that is missing, a temporary folder stands in on a local
    master only, as there the driver is the one executor; on a cluster it is an error.
    """
    context = spark.sparkContext
    configured = spark.conf.get(CHECKPOINT_SETTING, None)
    if context.getCheckpointDir() is None:
        if not configured and not re.match(r"local(\[|$)", context.master):
            raise ValueError(f"{CHECKPOINT_SETTING} must name a folder that all executors share")
        context.setCheckpointDir(configured or tempfile.mkdtemp(prefix="hourwatt-"))
    return configured or context.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the shared checkpoint folder."""
    return f"{checkpoint_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the rows survive the loss of any executor."""
    checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=True)
