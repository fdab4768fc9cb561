"""Small shared helpers for operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Largest dimension (rows) we ever broadcast. Parameter tables (probe lists,
# lexicons, decks, mode tables) are far below it; data-derived tables are only
# broadcast after their size has been counted against it.
BROADCAST_ROW_LIMIT = 200_000


def bounded_broadcast(df: DataFrame, limit: int = BROADCAST_ROW_LIMIT) -> DataFrame:
    """Broadcast ``df`` only if it provably has at most ``limit`` rows; otherwise
    leave the join strategy to the planner (sort-merge / shuffle-hash)."""
    n = df.limit(limit + 1).count()
    return F.broadcast(df) if n <= limit else df


def write_table(df: DataFrame, name: str) -> str:
    """Write ``df`` as a parquet table under the shared checkpoint folder; returns its path."""
    import uuid

    from ..session import checkpoint_dir
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/tables/{name}-{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as parquet under the shared checkpoint folder and read it
    back: cuts lineage (no recomputation when several branches reuse it, survives
    executor loss) and gives downstream scans column pruning / filter pushdown."""
    return df.sparkSession.read.parquet(write_table(df, name))


def round6(c):
    return F.round(c, 6)
