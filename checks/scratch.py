"""A folder for queries that write: versions of the books, tables laid out by name."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def folder(spark: SparkSession, name: str) -> str:
    """A new folder under ``spark.checkpoint.dir``.

    Only on a local master may that be unset; a folder of this machine stands in then.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that all executors see")
        base = f"file://{tempfile.mkdtemp(prefix='books-')}"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
