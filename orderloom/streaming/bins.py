"""Profiles and books over streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.schemas import ratio
from ..functions.timing import utc_ts


def otr_stream(events: DataFrame, bin_minutes: int = 30, late: str = "10 minutes") -> DataFrame:
    """Counts and order-to-trade ratio per contract and bin; events later than `late` behind the newest are dropped."""
    n = lambda a: F.count_if(F.col("action") == a)
    timed = events.withColumn("event_time", utc_ts(F.col("ts_event"))).withWatermark("event_time", late)
    out = timed.groupBy(F.window("event_time", f"{bin_minutes} minutes").alias("w"), "contract").agg(
        n("ADD").alias("n_add"), n("MODIFY").alias("n_modify"), n("FILL").alias("n_fill"), n("TRADE").alias("n_trades"), F.count(F.lit(1)).alias("n_events")
    )
    return out.select("contract", F.col("w.start").alias("bin_start"), "n_add", "n_modify", "n_fill", "n_trades", "n_events", ratio(F.col("n_add") + F.col("n_modify"), F.col("n_fill")).alias("otr"))


def book_batches(stream: DataFrame, sink, keys: tuple[str, ...] = ("contract", "session_date")):
    """A writer that hands sink(quotes) the book rows of each micro-batch of complete contract-days."""
    from ..operators.book import reconstruct

    return stream.writeStream.foreachBatch(lambda batch, _: sink(reconstruct(batch, keys=keys)))
