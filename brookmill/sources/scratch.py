"""Folders for tables in between, in the session's shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def new_folder(spark: SparkSession, name: str) -> str:
    """A path below ``spark.checkpoint.dir``; only where that is unset, in a temporary folder here."""
    base = spark.conf.get("spark.checkpoint.dir", None) or "file://" + tempfile.mkdtemp(prefix="spark-brookmill-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
