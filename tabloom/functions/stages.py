"""Cutting lineage between the steps of a loop, and the package on the workers."""

from __future__ import annotations

import os
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def ship(spark: SparkSession) -> None:
    """Lets Python workers import this package where their path does not lead to it; sent once per session."""
    root, context = Path(__file__).resolve().parents[2], spark.sparkContext
    if str(root) in os.environ.get("PYTHONPATH", "").split(os.pathsep) or getattr(context, "_shipped", False):
        return
    package = Path(__file__).resolve().parents[1].name
    context.addPyFile(shutil.make_archive(f"{tempfile.mkdtemp(prefix='spark-')}/{package}", "zip", root, package))
    context._shipped = True


def keep(df: DataFrame) -> DataFrame:
    """df computed once and held in the checkpoint folder of the session, which all executors share: lineage ends here and lost executors do not matter.

    Only a session on one machine that names no folder gets one of its own.
    """
    ship(df.sparkSession)
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder or "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return df.checkpoint()
