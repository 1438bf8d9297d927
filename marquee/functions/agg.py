"""Aggregate and ranking helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marquee.functions.text import col_, round_half_up


def mean_hundredths(c_hundredths, cond=None) -> Column:
    """Mean of a value kept in integer hundredths (exact sum, one division),
    optionally restricted to rows where ``cond`` holds; null when no row."""
    v = col_(c_hundredths)
    if cond is not None:
        v = F.when(cond, v)
    return F.try_divide(F.sum(v), F.count(v)) / F.lit(100.0)


def rated_mean(places: int = 2, rating_c: str = "rating_c", rating: str = "rating") -> Column:
    """Mean rating over rated rows (rating > 0), rounded half-up."""
    return round_half_up(mean_hundredths(rating_c, F.col(rating) > 0), places)


def rank_col(order: list[Column], partition: list | None = None) -> Column:
    w = Window.partitionBy(*partition).orderBy(*order) if partition else Window.orderBy(*order)
    return F.row_number().over(w).cast("bigint")


def top_k(df: DataFrame, k: int | None, order: list[Column], partition: list | None = None,
          name: str = "rk") -> DataFrame:
    """Rows ranked 1..k by ``order`` (a total order: callers end it with a
    unique key). With a partition, a ``row_number <= k`` filter is planned as a
    WindowGroupLimit before the exchange, so only k rows per task and key
    move; without one, the k rows are first cut by ``orderBy().limit()`` (a
    top-k per task, merged), whatever k is, and only those are numbered."""
    if k is not None and not partition:
        df = df.orderBy(*order).limit(k)
    out = df.withColumn(name, rank_col(order, partition))
    return out if k is None else out.filter(F.col(name) <= k)


def dense_ids(df: DataFrame, key: str | list[Column], name: str) -> DataFrame:
    """Number the rows 0.. by ``key`` (a column, or a list of orders) without a one-task window: a range sort,
    written as a reliable checkpoint, then the sums of the partitions before
    (one row per partition)."""
    from marquee.session import ensure_checkpoint_dir
    ensure_checkpoint_dir(df.sparkSession)
    placed = df.orderBy(*(key if isinstance(key, list) else [key])).select("*", F.spark_partition_id().alias("_pid"), F.monotonically_increasing_id().bitwiseAND(
        (1 << 33) - 1).alias("_at")).checkpoint()
    per = placed.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    before = per.select("_pid", (F.sum("_n").over(Window.orderBy("_pid")) - F.col("_n")).alias("_before"))
    return placed.join(before, "_pid").withColumn(name, F.col("_before") + F.col("_at")).drop("_pid", "_at", "_before")


def zero_fill(bins: DataFrame, counts: DataFrame, key: str, value: str = "n") -> DataFrame:
    """Left-join a small generated bin table to counts, missing -> 0."""
    return bins.join(counts, key, "left").withColumn(value, F.coalesce(F.col(value), F.lit(0)).cast("bigint"))
