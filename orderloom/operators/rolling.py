"""Rolling statistics over daily rows."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .stats import describe

#: Daily columns that are rolled unless others are named.
METRICS = ("order_to_trade_ratio", "cancel_rate", "fill_rate", "n_rows", "n_trade")


def rolling(daily: DataFrame, windows: tuple[int, ...] = (5, 20), metrics: tuple[str, ...] = METRICS, min_periods: int = 1, keys: tuple[str, ...] = (), order: str = "session_date") -> DataFrame:
    """Means over the last rows of each key, as {metric}_roll{window}; null with fewer values than min_periods."""
    metrics = [m for m in metrics if m in daily.columns]
    if not metrics:
        raise ValueError("no metric to roll")
    by = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).orderBy(order)
    out = {}
    for w in windows:
        last = by.rowsBetween(-(w - 1), 0)
        out |= {f"{m}_roll{w}": F.when(F.count(m).over(last) >= min_periods, F.avg(F.col(m).cast("double")).over(last)) for m in metrics}
    return daily.withColumns(out)


def merge_products(frames: dict[str, DataFrame], on: str = "session_date") -> DataFrame:
    """The union of daily rows with a product column, sorted by day and product."""
    if not frames:
        raise ValueError("no frames")
    rows = [df.withColumn("product", F.lit(name)) for name, df in frames.items()]
    return functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), rows).orderBy(on, "product")


def summary(daily: DataFrame, metric: str, windows: tuple[int, ...] = (5, 20)) -> DataFrame:
    """describe() of a metric and of its rolling means."""
    return describe(rolling(daily, windows, (metric,)), [metric, *(f"{metric}_roll{w}" for w in windows)])


def divergence(a: DataFrame, b: DataFrame, metric: str = "order_to_trade_ratio", window: int = 20, on: str = "session_date") -> DataFrame:
    """a's metric less b's by day, and its rolling mean."""
    both = a.select(on, F.col(metric).alias("a")).join(b.select(on, F.col(metric).alias("b")), on).withColumn("divergence", F.col("a") - F.col("b"))
    last = Window.partitionBy(F.lit(0)).orderBy(on).rowsBetween(-(window - 1), 0)
    return both.withColumn(f"divergence_roll{window}", F.avg("divergence").over(last))
