"""Tables written once and read back, in the folder that the cluster shares."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame


def staged(df: DataFrame) -> DataFrame:
    """df as a written table: computed once, with a short lineage that survives lost executors.

    The folder is the session's spark.checkpoint.dir; where that is unset, one is set on a single machine, and a cluster
    must name one that it shares.
    """
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="polyzona-")
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/zones-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
