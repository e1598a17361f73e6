"""Order-flow imbalance, forward returns and information coefficients, keyed by contract and day."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.schemas import require
from ..functions.timing import SECOND

KEYS = ("contract", "session_date")
QUOTE = ["bid_px_00", "ask_px_00", "bid_sz_00", "ask_sz_00"]


def events(quotes: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """With ofi: the change of bid size where the bid price held, less that of ask size where the ask price held; 0 at first."""
    require(quotes, ["ts_event", "ord", *QUOTE])
    by = Window.partitionBy(*keys).orderBy("ts_event", "ord")
    before = quotes.withColumns({f"_{c}": F.lag(c).over(by) for c in QUOTE})

    def change(side: str):
        px, sz = f"{side}_px_00", f"{side}_sz_00"
        delta = F.when(F.col(px) == F.col(f"_{px}"), F.col(sz) - F.col(f"_{sz}"))
        return F.coalesce(delta, F.lit(0)).cast("double")

    return before.withColumn("ofi", change("bid") - change("ask")).drop(*(f"_{c}" for c in QUOTE))


def buckets(quotes: DataFrame, window_seconds: int = 1, mode: str = "nearest", keys: tuple[str, ...] = KEYS, price_scale: float = 1.0) -> DataFrame:
    """Sums per time bucket with the first and last mid price.

    mode nearest: a bucket's start is its centre, halves go to the even bucket; floor: it is its start."""
    if window_seconds <= 0:
        raise ValueError("window_seconds must be positive")
    width = window_seconds * SECOND
    place = F.col("ts_event") / float(width)
    if mode not in ("nearest", "floor"):
        raise ValueError("mode must be nearest or floor")
    bucket = (F.bround(place) if mode == "nearest" else F.floor(place)).cast("long")
    at = F.struct("ts_event", "ord")
    rows = events(quotes, keys).withColumn("bucket_id", bucket).withColumn("mid", (F.col("bid_px_00") + F.col("ask_px_00")) / 2.0 / price_scale)
    return rows.groupBy(*keys, "bucket_id").agg(
        (F.first("bucket_id") * width).alias("bucket_start_ns"), F.sum("ofi").alias("ofi"), F.count(F.lit(1)).alias("n_updates"), F.min_by("mid", at).alias("mid_start"), F.max_by("mid", at).alias("mid_end")
    )


def forward_returns(bucketed: DataFrame, horizons: list[int], window_seconds: int = 1, mode: str = "rows", keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Log returns of mid_end over each horizon in seconds, as ret_{h}s.

    mode rows: so many rows ahead, whatever gaps there are; time: exactly so many buckets ahead, null in a gap."""
    if not horizons or any(h < window_seconds for h in horizons):
        raise ValueError("horizons must be given and not be shorter than a bucket")
    by, out = Window.partitionBy(*keys).orderBy("bucket_id"), bucketed
    for h in horizons:
        ahead, name = h // window_seconds, f"ret_{h}s"
        if mode == "rows":
            out = out.withColumn(name, F.ln(F.lead("mid_end", ahead).over(by) / F.col("mid_end")))
        else:
            later = by.rangeBetween(ahead, ahead)
            out = out.withColumn(name, F.ln(F.max("mid_end").over(later) / F.col("mid_end")))
    return out


def daily_ic(aligned: DataFrame, horizons: list[int], min_obs: int = 100, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Pearson correlation of ofi with each return, per day and horizon, over rows that have both."""
    each = F.explode(F.array(*(F.struct(F.lit(h).alias("horizon_s"), F.col(f"ret_{h}s").alias("ret")) for h in horizons)))
    rows = aligned.select(*keys, "ofi", each.alias("h")).select(*keys, "ofi", "h.*").where("ofi is not null and ret is not null")
    return rows.groupBy(*keys, "horizon_s").agg(F.corr("ofi", "ret").alias("ic"), F.count(F.lit(1)).alias("n_obs")).where(F.col("n_obs") >= min_obs)


def ic_summary(ics: DataFrame) -> DataFrame:
    return ics.groupBy("horizon_s").agg(F.avg("ic").alias("ic_mean"), F.stddev_samp("ic").alias("ic_std"), F.count("ic").alias("n_days"))


def ic_decay(quotes: DataFrame, horizons: list[int], window_seconds: int = 1, min_obs: int = 100, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """From quotes to daily coefficients in one plan; all steps but the last share one partitioning by key."""
    return daily_ic(forward_returns(buckets(quotes, window_seconds, keys=keys), horizons, window_seconds, keys=keys), horizons, min_obs, keys)
