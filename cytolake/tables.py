"""Tables in the folder that spark.checkpoint.dir names, which cut a plan's lineage and outlive lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder as a URI. Where it is unset, one is made for a local master, and others fail."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        made = spark.sparkContext._jsc.sc().getCheckpointDir()
        if made.isDefined():
            base = made.get()
        elif spark.sparkContext.master.split("[")[0] == "local":
            base = "file://" + tempfile.mkdtemp(prefix="checkpoint-")
            spark.sparkContext.setCheckpointDir(base)
        else:
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return (base if ":" in base.split("/")[0] else "file://" + base).rstrip("/")


def settled(df: DataFrame, name: str = "table") -> DataFrame:
    """The rows as a new table of the shared folder. What is used several times is made once, and the plans that use it stay small."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
