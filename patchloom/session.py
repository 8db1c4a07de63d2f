"""Session settings and the checkpoint folder."""

from __future__ import annotations

import functools
import tempfile

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def get_spark(app_name: str = "patchloom", master: str | None = None,
              shuffle_partitions: int | None = None) -> SparkSession:
    """A session with adaptive execution on. On a cluster leave ``master`` and
    ``shuffle_partitions`` unset: the submit command and AQE decide them."""
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.sources.partitionOverwriteMode", "dynamic")
    )
    if master:
        builder = builder.master(master).config("spark.ui.enabled", "false")
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names for checkpoints. Only a local session that names none (tests)
    falls back to a fresh temporary one, the same for the life of the session."""
    folder = spark.conf.get(CHECKPOINT_KEY, "") or spark.sparkContext.getConf().get(
        CHECKPOINT_KEY, "")
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith(
            "local-cluster"):
        raise ValueError(f"set {CHECKPOINT_KEY} to a folder every executor can reach")
    return _own_folder(spark.sparkContext.applicationId)


@functools.cache
def _own_folder(application_id: str) -> str:
    return tempfile.mkdtemp(prefix=f"patchloom-{application_id}-")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)
