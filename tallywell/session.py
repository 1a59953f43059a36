"""Spark sessions as the engine needs them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def get_session(app: str = "tallywell", master: str | None = None, **conf: str) -> SparkSession:
    """A session in UTC with ANSI mode and adaptive execution on.

    Days are cut in the session's time zone, and timestamps without one pass
    through it, so it is always UTC.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    for k, v in settings.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or the one that checkpoints were given.

    Where it is unset and all tasks run in one process, a folder of this machine; on a cluster that is an error.
    """
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found and sc.master != "local" and not sc.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (found or "/tmp/checkpoints/tallywell").rstrip("/")


def checkpoint_ready(spark: SparkSession) -> None:
    """Make checkpoint() usable, in the shared folder."""
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back.

    For loops: a checkpoint keeps the size that Spark guessed for its plan, and
    guesses of joins multiply round by round; a written table has its own size.
    """
    path = f"{shared_folder(df.sparkSession)}/tallywell-{df.sparkSession.sparkContext.applicationId}-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
