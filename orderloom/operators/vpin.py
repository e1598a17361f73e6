"""Volume-synchronised probability of informed trading: signed trades, volume bars, rolling imbalance."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.schemas import require

DAY = ("session_date",)


def classify(events: DataFrame, buy_side: str = "ASK") -> DataFrame:
    """Trades with a side, signed_volume positive on buy_side and negative on the other; others are dropped."""
    require(events, ["action", "side", "size"])
    sell_side = "BID" if buy_side == "ASK" else "ASK"
    signed = F.when(F.col("side") == buy_side, F.col("size")).when(F.col("side") == sell_side, -F.col("size"))
    return events.where("action = 'TRADE'").withColumn("signed_volume", signed.cast("long")).where("signed_volume is not null")


def dropped_share(events: DataFrame) -> DataFrame:
    """How many trades have no side."""
    trades = events.where("action = 'TRADE'")
    return trades.agg(F.count(F.lit(1)).alias("n_trades"), F.count_if(~F.coalesce(F.col("side").isin("BID", "ASK"), F.lit(False))).alias("n_dropped"))


def bars(trades: DataFrame, pct: float = 0.05, keys: tuple[str, ...] = DAY) -> DataFrame:
    """Bars of pct of the day's volume: a trade's bar is its inclusive running volume over the bar size, rounded down.

    The running sum is within a day. A day's bar size is truncated; days where that gives 0 have no bars."""
    if not 0 < pct <= 1:
        raise ValueError("pct must be over 0 and at most 1")
    by = Window.partitionBy(*keys)
    volume = F.abs("signed_volume")
    sized = trades.withColumn("bar_size", (F.sum(volume).over(by) * pct).cast("long")).where("bar_size > 0")
    upto = F.sum(volume).over(by.orderBy("ts_event", "ord").rowsBetween(Window.unboundedPreceding, 0))
    placed = sized.withColumn("bucket_id_daily", F.floor(upto / F.col("bar_size")).cast("long"))
    side = lambda sign: F.coalesce(F.sum(F.when(sign * F.col("signed_volume") > 0, volume)), F.lit(0))
    return placed.groupBy(*keys, "bucket_id_daily").agg(
        F.max("ts_event").alias("ts_last"), side(1).alias("v_buy"), side(-1).alias("v_sell"), F.sum(volume).alias("v_total"), F.count(F.lit(1)).alias("n_trades")
    )


def vpin(barred: DataFrame, window: int = 50, order: tuple[str, ...] = ("session_date", "bucket_id_daily"), keys: tuple[str, ...] = ()) -> DataFrame:
    """Order imbalance of each bar and its mean over the last `window` bars.

    The only window over a whole range: over bars, a few dozen a day, never over trades."""
    if window <= 0:
        raise ValueError("window must be positive")
    by = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).orderBy(*order)
    out = barred.withColumn("order_imbalance", F.abs(F.col("v_buy") - F.col("v_sell")) / F.col("v_total"))
    return out.withColumn("vpin", F.avg("order_imbalance").over(by.rowsBetween(-(window - 1), 0)))


def vpin_range(trades: DataFrame, pct: float = 0.05, window: int = 50) -> DataFrame:
    """All days: bars sized per day, imbalance rolled on across days, global bar ids offset by the bars of earlier days."""
    barred = bars(trades, pct)
    days = barred.groupBy("session_date").agg(F.count(F.lit(1)).alias("n_bars"))
    earlier = Window.partitionBy(F.lit(0)).orderBy("session_date").rowsBetween(Window.unboundedPreceding, -1)
    offsets = days.select("session_date", F.coalesce(F.sum("n_bars").over(earlier), F.lit(0)).alias("offset"))
    out = vpin(barred, window).join(offsets, "session_date")
    out = out.withColumn("bucket_id_global", F.col("offset") + F.col("bucket_id_daily")).drop("offset")
    return out.withColumn("is_warmup", F.col("bucket_id_global") < window - 1)
