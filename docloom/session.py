"""Session settings shared by the tests, the bench and applications."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Settings that hold at any size; everything sized by the cluster stays with the caller.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


#: Rows that one task is given where its memory grows with them.
TASK_ROWS = 500_000


def tasks_for(spark: SparkSession, rows: int) -> int:
    """How many tasks ``rows`` are dealt to: the caller's number of partitions, or more where that would give one over ``TASK_ROWS``."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // TASK_ROWS))


def local_session(cores: int = 8, shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and the bench."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("docloom")
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    spark = (
        builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", memory)
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables below ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _shared_top(spark: SparkSession) -> str:
    """The folder that driver and executors share, set for checkpoints too; a temporary one on a single machine only."""
    context = spark.sparkContext
    top = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not top:
        if not re.match(r"local($|\[)", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        top = "file://" + tempfile.mkdtemp(prefix="docloom-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(top)
    return top.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A path below the shared checkpoint folder at which nothing is yet."""
    return f"{_shared_top(spark)}/{name}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut in the shared checkpoint folder."""
    _shared_top(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut as a table in the shared folder: repeated values, such as tokens of sets, take a few bits each."""
    spark = df.sparkSession
    path = shared_path(spark, "stored")
    df.write.option("parquet.dictionary.page.size", str(16 << 20)).parquet(path, compression="zstd")
    return spark.read.schema(df.schema).parquet(path)
