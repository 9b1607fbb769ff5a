"""Cutting lineage: rows are written to the folder that the cluster names in ``spark.checkpoint.dir`` and survive lost executors.

Written tables are used instead of checkpoint(), which carries constraints of the plan along: in loops of self-joins they grow
exponentially.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Only where none is named and all runs in one process, as in tests, a local one is made."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isDefined():
            base = held.get()
        elif spark.sparkContext.master.startswith("local["):
            base = "file://" + tempfile.mkdtemp(prefix="rasterloom-")
            spark.sparkContext.setCheckpointDir(base)
        else:
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return base.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """df's rows, written below the shared folder and read back."""
    path = f"{shared_dir(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
