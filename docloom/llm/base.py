"""What the operators share: table access, the shared folder, and the cutting of lineage."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Ids up to this number (8 bytes each) are sent to every task; more are joined by a shuffle.
BROADCAST_IDS = 500_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables below ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir``; a temporary one on a single machine only."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="docloom-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def new_dir(spark: SparkSession, name: str) -> str:
    """A path in the shared folder at which nothing is yet."""
    return f"{shared_dir(spark)}/docloom/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """``df`` as a Parquet table in the shared folder. Cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = new_dir(spark, name)
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Removes a table that ``written`` has made, when nothing is to be read from it any more."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def without(docs: DataFrame, gone: DataFrame, same: Column | str) -> DataFrame:
    """``docs`` without the rows that ``same`` finds in ``gone``, a written table of ids."""
    return docs.join(F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone, same, "left_anti")
