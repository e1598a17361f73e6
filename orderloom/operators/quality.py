"""Checks of reconstructed quotes and of feeds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.schemas import NO_PRICE, SCALE
from .filters import repeated_by, unique_by

KEYS = ("contract", "session_date")
TOP = ("bid_px_00", "ask_px_00", "bid_sz_00", "ask_sz_00", "bid_ct_00", "ask_ct_00")
MATCH = ("ts_recv", "sequence")
# Most crossed, outside-spread, negative-size and null-drop rates in hundredths of each verdict.
VERDICTS = {"RELIABLE": (0.0, 0.01, 0.0, 0.001), "ACCEPTABLE": (0.0001, 1.0, 0.0, 0.01)}
# Least price and size matches in hundredths of each verdict of a comparison.
MATCH_VERDICTS = {"RELIABLE": (99.9, 98.0), "ACCEPTABLE": (99.5, 95.0)}


def _in_order(keys: tuple[str, ...]):
    """By receive time and sequence, trades first, then by position."""
    trade_first = F.when(F.col("action") == "TRADE", 0).otherwise(1)
    return Window.partitionBy(*keys).orderBy("ts_recv", "sequence", trade_first, "ord")


def crossed(quotes: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    both = F.col("bid_px_00").isNotNull() & F.col("ask_px_00").isNotNull()
    return quotes.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(both).alias("n_both"), F.count_if(both & (F.col("bid_px_00") >= F.col("ask_px_00"))).alias("n_crossed")
    )


def trades_outside(quotes: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Trades under the bid or over the ask of the row before."""
    by = _in_order(keys)
    rows = quotes.withColumns({"_bid": F.lag("bid_px_00").over(by), "_ask": F.lag("ask_px_00").over(by)}).where("action = 'TRADE'")
    outside = F.coalesce((F.col("price") < F.col("_bid")) | (F.col("price") > F.col("_ask")), F.lit(False)) & F.col("_bid").isNotNull() & F.col("_ask").isNotNull()
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_trades"), F.count_if(outside).alias("n_outside"))


def spread_distribution(quotes: DataFrame, tick: float, keys: tuple[str, ...] = KEYS) -> DataFrame:
    rows = quotes.where("bid_px_00 is not null and ask_px_00 is not null").withColumn("s", (F.col("ask_px_00") - F.col("bid_px_00")) / tick)
    at = lambda p: F.round(F.percentile("s", F.lit(p)), 2)
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_spread"), F.count_if(F.col("s") < 1).alias("n_locked"), F.round(F.avg("s"), 2).alias("avg_spread"), at(0.5).alias("med_spread"),
        at(0.95).alias("p95_spread"), at(0.99).alias("p99_spread"), F.round(F.min("s"), 2).alias("min_spread"), F.round(F.max("s"), 2).alias("max_spread"),
    )


def negative_sizes(quotes: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    return quotes.groupBy(*keys).agg(*(F.count_if(F.col(f"{s}_sz_00") < 0).alias(f"n_neg_{s}") for s in ("bid", "ask")))


def null_drops(quotes: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Sides that vanish after a row that wasn't a clear."""
    by = _in_order(keys)
    rows = quotes.withColumn("_action", F.lag("action").over(by))
    for s in ("bid", "ask"):
        rows = rows.withColumn(f"_{s}", F.lag(f"{s}_px_00").over(by))
    drop = lambda s: F.count_if(F.col(f"_{s}").isNotNull() & F.col(f"{s}_px_00").isNull() & (F.col("_action") != "CLEAR"))
    return rows.groupBy(*keys).agg(drop("bid").alias("bid_null_drops"), drop("ask").alias("ask_null_drops"))


def rate(n: Column, total: Column) -> Column:
    return F.when(total > 0, F.round(100.0 * n / total, 6)).otherwise(0.0)


def verdict(quotes: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """All invariants of each key, their rates, and whether they are good enough."""
    out = crossed(quotes, keys)
    for part in (trades_outside(quotes, keys), negative_sizes(quotes, keys), null_drops(quotes, keys)):
        out = out.join(part, list(keys), "left")
    out = out.fillna(0).withColumns(
        {
            "crossed_rate": rate(F.col("n_crossed"), F.col("n_both")),
            "outside_rate": rate(F.col("n_outside"), F.col("n_trades")),
            "negative_rate": rate(F.col("n_neg_bid") + F.col("n_neg_ask"), F.col("n_rows")),
            "null_drop_rate": F.greatest(rate(F.col("bid_null_drops"), F.col("n_rows")), rate(F.col("ask_null_drops"), F.col("n_rows"))),
        }
    )
    found = F.lit("NEEDS_WORK")
    for name, limits in reversed(VERDICTS.items()):
        good = F.lit(True)
        for column, limit in zip(("crossed_rate", "outside_rate", "negative_rate", "null_drop_rate"), limits):
            good = good & (F.col(column) <= limit)
        found = F.when(good, F.lit(name)).otherwise(found)
    return out.withColumn("verdict", found)


def burst_rate(quotes: DataFrame) -> DataFrame:
    """Share of rows whose (ts_recv, sequence) others have, too: two levels of one aggregation, no join."""
    groups = quotes.groupBy(*MATCH).agg(F.count(F.lit(1)).alias("n"))
    return groups.agg(F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("n_burst"), F.sum("n").alias("n_rows")).withColumn("burst_rate", F.col("n_burst") / F.col("n_rows"))


def burst_rows(quotes: DataFrame) -> DataFrame:
    return repeated_by(quotes, list(MATCH))


def matched(ours: DataFrame, reference: DataFrame) -> DataFrame:
    """Rows of both whose key is unique on either side, with our_ and ref_ columns."""
    side = lambda df, p: unique_by(df, list(MATCH)).select(*MATCH, *(F.col(c).alias(f"{p}_{c}") for c in TOP))
    return side(ours, "our").join(side(reference, "ref"), list(MATCH))


def compare(ours: DataFrame, reference: DataFrame) -> DataFrame:
    """Counts of equal columns, of rows equal in all, and of the direction of size differences."""
    rows = matched(ours, reference)
    same = {c: F.col(f"our_{c}") == F.col(f"ref_{c}") for c in TOP}
    full = F.lit(True)
    for c in TOP:
        full = full & same[c]
    sums = [F.count(F.lit(1)).alias("n_joined"), *(F.count_if(same[c]).alias(c[:6]) for c in TOP), F.count_if(full).alias("full_match")]
    for s in ("bid", "ask"):
        price, a, b = same[f"{s}_px_00"], F.col(f"our_{s}_sz_00"), F.col(f"ref_{s}_sz_00")
        sums += [F.count_if(price & (a > b)).alias(f"{s}_sz_over"), F.count_if(price & (a < b)).alias(f"{s}_sz_under"), F.round(F.avg(F.when(price & (a != b), F.abs(a - b))), 2).alias(f"avg_{s}_sz_delta")]
    return rows.agg(*sums)


def match_verdict(compared: DataFrame) -> DataFrame:
    """compare()'s row with a verdict from the worse side's matches of price and size."""
    share = lambda *c: 100.0 * F.least(*map(F.col, c)) / F.col("n_joined")
    found = F.lit("NEEDS_WORK")
    for name, (price, size) in reversed(MATCH_VERDICTS.items()):
        found = F.when((share("bid_px", "ask_px") >= price) & (share("bid_sz", "ask_sz") >= size), F.lit(name)).otherwise(found)
    return compared.withColumn("verdict", found)


def first_mismatches(ours: DataFrame, reference: DataFrame, n: int = 20) -> DataFrame:
    """The first rows in time that differ in any column."""
    rows, same = matched(ours, reference), F.lit(True)
    for c in TOP:
        same = same & F.col(f"our_{c}").eqNullSafe(F.col(f"ref_{c}"))
    return rows.where(~same).orderBy(*MATCH).limit(n)


def fingerprint(df: DataFrame, columns: list[str], keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Row count, bounds and an order-sensitive checksum that partial aggregation can sum: position-salted row hashes."""
    price = F.when(F.col("price") != NO_PRICE, F.col("price"))
    row = F.conv(F.substring(F.md5(F.concat_ws("|", F.col("ord").cast("string"), *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns)).cast("binary")), 1, 8), 16, 10).cast("long")
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("row_count"), F.min("ts_event").alias("ts_min"), F.max("ts_event").alias("ts_max"), F.min(price).alias("price_min"), F.max(price).alias("price_max"), F.sum(row).alias("checksum")
    )


def compare_fingerprints(a: DataFrame, b: DataFrame, keys: tuple[str, ...] = KEYS, tolerance: float = 0.0) -> DataFrame:
    """Keys whose fingerprints differ, or are on one side only; tolerance: relative, of row counts."""
    both = a.alias("a").join(b.alias("b"), list(keys), "full")
    off = F.abs(F.col("a.row_count") - F.col("b.row_count")) > tolerance * F.col("a.row_count")
    differs = off | (F.lit(tolerance == 0) & ~F.col("a.checksum").eqNullSafe(F.col("b.checksum")))
    return both.where(F.coalesce(differs, F.lit(True))).select(*keys, F.col("a.row_count").alias("rows_a"), F.col("b.row_count").alias("rows_b"))


def latency(events: DataFrame, at: tuple[float, ...] = (0.5, 0.95, 0.99), keys: tuple[str, ...] = ("contract",)) -> DataFrame:
    """Percentiles of receive less event time, in nanoseconds."""
    ns = F.col("ts_recv") - F.col("ts_event")
    return events.groupBy(*keys).agg(*(F.percentile(ns, F.lit(p)).alias(f"p{100 * p:g}") for p in at), F.max(ns).alias("max"))


def snapshot_boundary(events: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Rows of the opening snapshot, and the last of them."""
    snap = F.col("flags").cast("int").bitwiseAND(32) > 0
    return events.groupBy(*keys).agg(F.count_if(snap).alias("n_snapshot"), F.max(F.when(snap, F.col("ord"))).alias("last_snapshot"), F.min(F.when(~snap, F.col("ord"))).alias("first_live"))


def sanity(events: DataFrame, tick_fp: int, share: float = 0.1, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Per key: undefined and off-tick prices, and those further from the median than a share of it.

    The medians are one row per key, joined back by key."""
    priced = events.where(F.col("price") != NO_PRICE)
    medians = priced.groupBy(*keys).agg(F.median("price").alias("median"))
    rows = events.join(medians, list(keys), "left")
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("price") == NO_PRICE).alias("n_no_price"), F.count_if((F.col("price") != NO_PRICE) & (F.col("price") % tick_fp != 0)).alias("n_off_tick"),
        F.count_if((F.col("price") != NO_PRICE) & (F.abs(F.col("price") - F.col("median")) > share * F.col("median"))).alias("n_outliers"),
    )


def exclusion_rate(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows before and after cleaning: one row of each."""
    b, a = before.agg(F.count(F.lit(1)).alias("n_before")), after.agg(F.count(F.lit(1)).alias("n_after"))
    return b.crossJoin(F.broadcast(a)).withColumn("excluded_pct", 100.0 * (F.col("n_before") - F.col("n_after")) / F.col("n_before"))


def printable(trades: DataFrame, keys: tuple[str, ...] = ("side",)) -> DataFrame:
    shown = F.col("deal_type").cast("int").bitwiseAND(1) == 1
    return trades.groupBy(*keys).agg(F.count_if(shown).alias("n_printable"), F.count_if(~shown).alias("n_other"))


def top_spread(events: DataFrame, keys: tuple[str, ...] = ("contract", "ts_recv", "sequence")) -> DataFrame:
    """Bid and ask of rows that set a side, by time and sequence, and the spread in points."""
    side = lambda s, f: f(F.when(F.col("side") == s, F.col("price")))
    out = events.where("action = 'ADD'").groupBy(*keys).agg(side("BID", F.max).alias("bid"), side("ASK", F.min).alias("ask"))
    return out.where("bid is not null and ask is not null").withColumn("spread_pts", (F.col("ask") - F.col("bid")) / float(SCALE))
