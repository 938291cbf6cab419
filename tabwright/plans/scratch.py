"""Scratch folders for queries that write a table and read it back."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

from tabwright.session import shared_folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the cluster's shared folder; a local one only where no shared folder is named."""
    shared = shared_folder(spark)
    base = shared.rstrip("/") if shared else tempfile.mkdtemp(prefix="tabwright-")
    return f"{base}/{name}-{uuid.uuid4().hex}"
