"""Counts and ratios per contract, day and product, and distributions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.schemas import ACTIONS, NO_PRICE, ratio, round_to

COUNTED = [a for a in ACTIONS if a != "NONE"]


def _count(action: str) -> Column:
    return F.count_if(F.col("action") == action).alias(f"n_{action.lower()}")


def contract_stats(events: DataFrame, keys: tuple[str, ...], tick_fp: int, scale: float = 1e9) -> DataFrame:
    """All counts, the range of trade prices and the ratios of each group, in one aggregation.

    cancel_rate = (cancels - fills) / (adds + modifies), fill_rate = fills / (adds + modifies), order_to_trade_ratio =
    (adds + modifies) / fills; null where the divisor is 0. scale: price units of a point, 1 for prices in points."""
    price = F.when(F.col("action") == "TRADE", F.col("price"))
    out = events.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"), *map(_count, COUNTED), F.min(price).alias("price_min"), F.max(price).alias("price_max"))
    posted = F.col("n_add") + F.col("n_modify")
    return out.select(
        *keys,
        "n_rows",
        *(f"n_{a.lower()}" for a in COUNTED),
        round_to(ratio(F.col("n_cancel") - F.col("n_fill"), posted), 4).alias("cancel_rate"),
        round_to(ratio(F.col("n_fill"), posted), 4).alias("fill_rate"),
        round_to(ratio(posted, F.col("n_fill")), 2).alias("order_to_trade_ratio"),
        "price_min",
        "price_max",
        (F.col("price_min") / scale).alias("price_min_pts"),
        (F.col("price_max") / scale).alias("price_max_pts"),
        ((F.col("price_max") - F.col("price_min")) / (tick_fp * scale / 1e9)).cast("long").alias("price_range_ticks"),
        F.lit(tick_fp / 1e9).alias("tick_size_pts"),
    )


def product_stats(events: DataFrame, tick_fp: int) -> DataFrame:
    """A row per day with trades: the statistics of the outright with most trades, ties to the first name.

    Events are read and aggregated once for all contracts; the front one is chosen among a day's few rows."""
    from .front import outrights

    every = contract_stats(outrights(events), ("session_date", "contract"), tick_fp).where("n_trade > 0")
    place = F.row_number().over(Window.partitionBy("session_date").orderBy(F.desc("n_trade"), "contract"))
    return every.withColumn("_place", place).where("_place = 1").drop("_place")


def cross_market(events: DataFrame, products: DataFrame) -> DataFrame:
    """Full-day statistics per product and contract beside the product's fixed data (a dozen rows, broadcast)."""
    stats = contract_stats(events, ("product", "contract", "session_date"), 1)
    own = stats.drop("tick_size_pts", "price_range_ticks").join(F.broadcast(products), "product")
    names = "product contract session_date exchange currency n_rows n_add n_cancel n_modify n_trade order_to_trade_ratio cancel_rate fill_rate price_min_pts price_max_pts tick_size_pts point_value"
    return own.select(*names.split())


def distribution(df: DataFrame, column: str, within: tuple[str, ...] = ()) -> DataFrame:
    """Counts of each value and their share of the group's total, in hundredths; the window is over the counts only."""
    counts = df.groupBy(*within, column).agg(F.count(F.lit(1)).alias("n"))
    whole = F.sum("n").over(Window.partitionBy(*within) if within else Window.partitionBy(F.lit(0)))
    return counts.withColumn("pct", 100.0 * F.col("n") / whole)


def flag_counts(df: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """How many rows have each flag, how many prices are undefined, and how many keys are distinct."""
    bit = lambda b: F.count_if(F.col("flags").cast("int").bitwiseAND(b) > 0)
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        bit(128).alias("n_last"),
        bit(32).alias("n_snapshot"),
        bit(4).alias("n_bad_ts"),
        bit(1).alias("n_tob"),
        F.count_if(F.col("price") == NO_PRICE).alias("n_no_price"),
        F.count_distinct("order_id").alias("n_orders"),
    )


def percentiles(df: DataFrame, column: str, at: tuple[float, ...], keys: tuple[str, ...] = ()) -> DataFrame:
    """Exact interpolated percentiles, as p50, p95 and so on."""
    return df.groupBy(*keys).agg(*(F.percentile(column, F.lit(p)).alias(f"p{100 * p:g}".replace(".", "_")) for p in at))


def approximate_percentiles(df: DataFrame, column: str, at: tuple[float, ...], keys: tuple[str, ...] = (), accuracy: int = 10_000) -> DataFrame:
    """Percentiles from a summary of bounded size, for columns with very many values: ranks are off by 1 / accuracy of the rows at most."""
    return df.groupBy(*keys).agg(*(F.percentile_approx(column, F.lit(p), F.lit(accuracy)).alias(f"p{100 * p:g}".replace(".", "_")) for p in at))


def order_fingerprint(events: DataFrame) -> DataFrame:
    """Per order id: lifetime, events, price amplitude, rate and mean size."""
    out = events.groupBy("order_id").agg(
        F.count(F.lit(1)).alias("n_events"),
        (F.max("ts_event") - F.min("ts_event")).alias("lifetime_ns"),
        (F.max("price") - F.min("price")).alias("amplitude"),
        F.avg("size").alias("mean_size"),
    )
    return out.withColumn("events_per_s", F.when(F.col("lifetime_ns") > 0, F.col("n_events") / (F.col("lifetime_ns") / 1e9)))


def log_fit(df: DataFrame, x: str, y: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Least-squares line of ln y over ln x, of rows where both are positive."""
    rows = df.where((F.col(x) > 0) & (F.col(y) > 0)).withColumns({"_x": F.ln(x), "_y": F.ln(y)})
    return rows.groupBy(*keys).agg(F.regr_slope("_y", "_x").alias("slope"), F.regr_intercept("_y", "_x").alias("intercept"), F.count(F.lit(1)).alias("n"))


def describe(df: DataFrame, columns: list[str]) -> DataFrame:
    """(series, mean, std, min, max) of each column."""
    stacked = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("series"), F.col(c).cast("double").alias("v")) for c in columns))).alias("s")).select("s.*")
    return stacked.groupBy("series").agg(F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"), F.min("v").alias("min"), F.max("v").alias("max"))
