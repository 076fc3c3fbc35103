"""Helpers shared by the training-data operators: shared scratch tables, sized joins, name clashes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provena.storage import scratch_path, shared_dir, write_table

__all__ = ["BROADCAST_ROWS", "default_parallelism", "join_sized", "scratch_path", "shared_dir", "without", "write_table"]

#: A side of at most this many rows may be broadcast by :func:`join_sized`; beyond it the join shuffles.
BROADCAST_ROWS = 500_000


def join_sized(left: DataFrame, right: DataFrame, on, how: str, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Join with a *written* small-row table: broadcast when its counted rows are within ``limit``, else shuffle.

    ``right`` should come from :func:`write_table`, so that counting it reads Parquet footers only.
    """
    if right.limit(limit + 1).count() <= limit:
        right = F.broadcast(right)
    return left.join(right, on, how)


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` without columns whose names clash (ignoring case) with an operator's own outputs."""
    taken = {n.lower() for n in names}
    keep = [c for c in df.columns if c.lower() not in taken]
    return df if len(keep) == len(df.columns) else df.select(*[F.col(f"`{c}`") for c in keep])


def default_parallelism(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
