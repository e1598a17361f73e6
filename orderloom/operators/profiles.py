"""Intraday profiles in UTC bins, per day and across days.

Everything is keyed by contract and day, so all days are one job and no window spans more than a contract-day.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.schemas import ratio, require
from ..functions.timing import time_bin

KEYS = ("contract", "session_date")


def _binned(events: DataFrame, columns: list[str], minutes: int) -> DataFrame:
    require(events, ["ts_event", *columns])
    return events.withColumn("time_bin", time_bin(F.col("ts_event"), minutes))


def _n(action: str) -> Column:
    return F.count_if(F.col("action") == action)


def volume(events: DataFrame, bin_minutes: int = 30, keys: tuple[str, ...] = KEYS) -> DataFrame:
    return _binned(events, ["action"], bin_minutes).groupBy(*keys, "time_bin").agg(_n("TRADE").alias("n_trades"), F.count(F.lit(1)).alias("n_events"))


def otr(events: DataFrame, bin_minutes: int = 30, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Order-to-trade ratio: (adds + modifies) / fills, null without fills."""
    out = _binned(events, ["action"], bin_minutes).groupBy(*keys, "time_bin").agg(
        _n("ADD").alias("n_add"), _n("MODIFY").alias("n_modify"), _n("FILL").alias("n_fill"), F.count(F.lit(1)).alias("n_events")
    )
    return out.withColumn("otr", ratio(F.col("n_add") + F.col("n_modify"), F.col("n_fill")))


def changes(quotes: DataFrame, columns: list[str], keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Rows where a column differs from the row before, and each group's first row.

    A null on either side is no difference, but a missing first value is."""
    by = Window.partitionBy(*keys).orderBy("ts_event", "ord")
    before = quotes.withColumns({f"_{c}": F.lag(c).over(by) for c in columns})
    differs = F.col(f"_{columns[0]}").isNull()
    for c in columns:
        differs = differs | F.coalesce(F.col(c) != F.col(f"_{c}"), F.lit(False))
    return before.where(differs).drop(*(f"_{c}" for c in columns))


def spread(quotes: DataFrame, tick: float, bin_minutes: int = 30, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Spread in ticks over changes of best price or size, without crossed and one-sided rows."""
    if tick <= 0:
        raise ValueError("tick must be positive")
    columns = ["bid_px_00", "ask_px_00", "bid_sz_00", "ask_sz_00"]
    require(quotes, [*columns, "ord"])
    moved = changes(quotes.where("ask_px_00 > bid_px_00"), columns, keys)
    ticks = _binned(moved, [], bin_minutes).withColumn("s", (F.col("ask_px_00") - F.col("bid_px_00")) / tick)
    return ticks.groupBy(*keys, "time_bin").agg(
        F.avg("s").alias("spread_mean"), F.stddev_samp("s").alias("spread_std"), F.min("s").alias("spread_min"), F.max("s").alias("spread_max"), F.count(F.lit(1)).alias("n_obs")
    )


def depth(quotes: DataFrame, bin_minutes: int = 30, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Sizes at the best prices over changes of price or size, where both sides are there."""
    columns = ["bid_sz_00", "ask_sz_00", "bid_px_00", "ask_px_00"]
    require(quotes, [*columns, "ord"])
    moved = changes(quotes.where("bid_sz_00 > 0 and ask_sz_00 > 0"), columns, keys)
    b, a = F.col("bid_sz_00").cast("double"), F.col("ask_sz_00").cast("double")
    return _binned(moved, [], bin_minutes).groupBy(*keys, "time_bin").agg(
        F.avg(b).alias("bid_depth_mean"), F.stddev_samp(b).alias("bid_depth_std"), F.avg(a).alias("ask_depth_mean"), F.stddev_samp(a).alias("ask_depth_std"),
        F.avg(a + b).alias("total_depth_mean"), F.count(F.lit(1)).alias("n_obs"),
    )


def across_days(profile: DataFrame, metrics: list[str], keys: tuple[str, ...] = ()) -> DataFrame:
    """Mean and deviation of each metric over days, and the days that have it, per time of day."""
    return profile.groupBy(*keys, "time_bin").agg(
        *(f(m).alias(f"{m}_{n}") for m in metrics for n, f in (("mean", F.avg), ("std", F.stddev_samp))), *(F.count(m).alias(f"{m}_days") for m in metrics)
    )


def intraday(events: DataFrame, quotes: DataFrame, tick: float, bin_minutes: int = 30, min_obs: int = 1, min_rows: int = 100, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Volume, ratio, spread and depth of all days in one row per time of day; thin days and bins are left out."""
    full = events.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= min_rows).drop("_n")
    events, quotes = (d.join(full, list(keys), "left_semi") for d in (events, quotes))
    parts = [
        across_days(volume(events, bin_minutes, keys), ["n_trades", "n_events"]),
        across_days(otr(events, bin_minutes, keys), ["otr"]),
        across_days(spread(quotes, tick, bin_minutes, keys).where(F.col("n_obs") >= min_obs), ["spread_mean"]),
        across_days(depth(quotes, bin_minutes, keys).where(F.col("n_obs") >= min_obs), ["total_depth_mean"]),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p, "time_bin", "full")
    return out


def hourly_counts(events: DataFrame, keys: tuple[str, ...] = ("contract",)) -> DataFrame:
    """Events in each of the 24 hours, 0 where there are none."""
    hours = events.sparkSession.range(24).select(F.col("id").cast("int").alias("hour"))
    own = events.select(*keys).distinct().join(F.broadcast(hours))
    counts = events.groupBy(*keys, F.floor(F.pmod(F.col("ts_event"), F.lit(86_400_000_000_000)) / 3_600_000_000_000).cast("int").alias("hour")).agg(F.count(F.lit(1)).alias("n"))
    return own.join(counts, [*keys, "hour"], "left").select(*keys, "hour", F.coalesce("n", F.lit(0)).alias("n_events"))
