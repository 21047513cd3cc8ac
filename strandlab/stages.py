"""Cutting a plan between stages."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back: later stages get a short plan and don't repeat its work.

    The folder is ``spark.checkpoint.dir``; a temporary one only where that is unset, as in local tests. ``checkpoint()`` would
    compute ``df`` twice, and its result keeps the constraints of the plan before, which grow with every round of a loop.
    """
    spark = df.sparkSession
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        where = "file://" + tempfile.mkdtemp(prefix="strandlab-")
        spark.conf.set("spark.checkpoint.dir", where)
    path = f"{where.rstrip('/')}/strandlab/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
