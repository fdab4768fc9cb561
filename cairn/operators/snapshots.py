"""Versioned snapshots of several tables that belong together (H4: themes and their members).

A build writes its tables into a folder of its own and then appends one row to the pointer table: version number and
folder. Readers take the folder of the highest version, so they see all tables of one build or of the one
before, never a mixture, and a build that dies leaves no trace that is read. A reader that holds a folder keeps reading
it while later builds are published; ``prune`` forgets what is no longer wanted.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_POINTER = "version long, folder string"


def _pointers(spark: SparkSession, base: str) -> DataFrame | None:
    from pyspark.errors import AnalysisException
    try:
        return spark.read.schema(_POINTER).parquet(f"{base.rstrip('/')}/pointer")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def current(spark: SparkSession, base: str) -> str | None:
    """Folder of the newest snapshot, None before the first (of two builds that raced to the same version, the same
    one for every reader)."""
    found = _pointers(spark, base)
    if found is None:
        return None
    top = found.orderBy(F.col("version").desc(), "folder").first()
    return top.folder if top else None


def publish(spark: SparkSession, base: str, tables: dict[str, DataFrame]) -> str:
    """Write all ``tables`` and then point to them; returns their folder."""
    base = base.rstrip("/")
    folder = f"{base}/build-{uuid.uuid4().hex}"
    for name, df in tables.items():
        df.write.parquet(f"{folder}/{name}")
    found = _pointers(spark, base)
    last = 0 if found is None else found.agg(F.max("version")).first()[0] or 0
    spark.createDataFrame([(last + 1, folder)], _POINTER).coalesce(1).write.mode("append").parquet(f"{base}/pointer")
    return folder


def table_of(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}")
