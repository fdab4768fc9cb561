"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import gc

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.util import materialize, write_table  # noqa: F401  (re-exported)
from ..session import checkpoint_dir, ship_package  # noqa: F401  (re-exported)

# characters between words in the contracts of this subpackage
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def crc_mod(doc_id: Column, mod: int) -> Column:
    """crc32 of the id written as text, modulo ``mod``; a NULL id counts as the
    empty text (crc32 0)."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(mod)).cast("int")


def let(value: Column, body) -> Column:
    """Bind ``value`` once inside an expression: ``body`` gets a variable, so the
    value is computed once however often ``body`` uses it."""
    return F.transform(F.array(value), body)[0]


def total_bytes(df: DataFrame, text: str) -> int:
    """Bytes of a text column, one aggregated scalar."""
    return int(df.agg(F.sum(F.octet_length(text))).first()[0] or 0)


def release(spark: SparkSession) -> None:
    """Let Spark's context cleaner remove the shuffle files of jobs that are done:
    it does so when the driver's references to them have been collected."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
