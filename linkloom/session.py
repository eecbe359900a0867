"""Session helpers: a local session for tests and benches, and reliable cuts of lineage."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "linkloom", cores: int | None = None, **conf: str) -> SparkSession:
    """A single-node session with the settings that the tests and the bench use."""
    n = cores or int(os.environ.get("BENCH_CPUS", "8"))
    builder = SparkSession.builder.master(f"local[{n}]").appName(app)
    settings = {
        "spark.sql.shuffle.partitions": str(n),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.driver.memory": os.environ.get("LINKLOOM_DRIVER_MEMORY", "8g"),
        "spark.driver.host": "127.0.0.1",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    } | conf
    for k, v in settings.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _checkpoint_folder(spark: SparkSession) -> None:
    """The folder that the session names in spark.checkpoint.dir; only a session on one machine gets one of its own, which goes with it."""
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isEmpty():
        return
    named = context.getConf().get("spark.checkpoint.dir", "")
    if not named:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("a cluster needs a shared folder in spark.checkpoint.dir")
        named = tempfile.mkdtemp(prefix="linkloom-checkpoint-")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
    context.setCheckpointDir(named)


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the checkpoint folder, its lineage cut, so that a lost executor costs no recomputation."""
    _checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)
