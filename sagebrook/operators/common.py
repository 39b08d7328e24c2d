"""Small table helpers that several operators use."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A dimension with at most so many rows is broadcast; a larger one is joined through a shuffle.
BROADCAST_ROWS = 200_000


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` rows; counted with a limit, so a large table costs little."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def cut(df: DataFrame) -> DataFrame:
    """A checkpoint, computed at once, where the session has a folder for it; else the plan as it is."""
    sc = df.sparkSession.sparkContext
    return df.checkpoint() if sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir() else df


def work_path(spark: SparkSession, name: str) -> str:
    """A new path below ``spark.checkpoint.dir``; without that setting a temporary folder, for a local master only."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="sagebrook-")
    return f"{folder.rstrip('/')}/sagebrook/{name}-{uuid.uuid4().hex}"


def first_per_key(df: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    """The first row of each key in the given order; the order should end in a unique column."""
    return top_per_key(df, keys, 1, *order)


def top_per_key(df: DataFrame, keys: Sequence[str], n: int, *order: Column, rank: str | None = None) -> DataFrame:
    """The first ``n`` rows of each key; Spark prunes each task to ``n`` rows before the shuffle."""
    name = rank or "_rank"
    out = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(name) <= n)
    return out if rank else out.drop(name)


def share_of_total(df: DataFrame, keys: Sequence[str], digits: int = 1) -> DataFrame:
    """(keys, n, pct): counts and their share of all rows.

    The groups are few next to the rows; their total is one aggregate, joined as
    the one row that it is, so no task sees all groups.
    """
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("_total"))
    return counts.crossJoin(F.broadcast(total)).select(  # one row
        *keys, "n", F.round(F.lit(100.0) * F.col("n") / F.col("_total"), digits).alias("pct")
    )


def percent(part: Column, whole: Column, digits: int = 1) -> Column:
    """100 x part / whole, rounded; null without a whole."""
    return F.round(F.lit(100.0) * part / F.nullif(whole, F.lit(0)), digits)
