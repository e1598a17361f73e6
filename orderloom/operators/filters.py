"""Row filters: sessions, flags, prices, uniqueness."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.catalog import rth_bounds
from ..functions.schemas import NO_PRICE
from ..functions.timing import SECOND, as_date, day_ns


def all_of(*conditions: Column | None) -> Column:
    """Conjunction of the conditions that are given."""
    return functools.reduce(operator.and_, [c for c in conditions if c is not None], F.lit(True))


def within(ns: Column, start: int | Column | None, end: int | Column | None, lunch_start=None, lunch_end=None) -> Column:
    """start <= ns < end, without lunch_start <= ns < lunch_end."""
    lunch = None if lunch_start is None else ~((ns >= lunch_start) & (ns < lunch_end))
    return all_of(None if start is None else ns >= start, None if end is None else ns < end, lunch)


def filter_rth(df: DataFrame, product: str, day, session: str = "default", column: str = "ts_recv") -> DataFrame:
    """Rows of a product's regular session on a day; the bounds are literals, which reach the scan."""
    b = rth_bounds(product, day, session)
    return df.where(within(F.col(column), *b.values()))


def in_rth(df: DataFrame, bounds: DataFrame, column: str = "ts_recv", on: str = "session_date") -> DataFrame:
    """Rows within the bounds of their own day; bounds has a row per day, so it is broadcast."""
    out = df.join(F.broadcast(bounds), on)
    ns = F.col(column)
    lunch = F.coalesce((ns >= F.col("lunch_start")) & (ns < F.col("lunch_end")), F.lit(False))
    return out.where((ns >= F.col("rth_start")) & (ns < F.col("rth_end")) & ~lunch).drop("rth_start", "rth_end", "lunch_start", "lunch_end")


def continuous(ns: Column, ranges: list[tuple[int, int]], buffer_s: int = 300) -> Column:
    """Within any of the ranges, apart from a buffer at both ends of each."""
    cut = buffer_s * SECOND
    return functools.reduce(operator.or_, [within(ns, a + cut, b - cut) for a, b in ranges], F.lit(False))


def date_range(df: DataFrame, first, last, column: str = "ts_recv") -> DataFrame:
    """Rows of the days from first to last, both included, sorted by time and position."""
    last_ns = day_ns(as_date(last)) + 86_400 * SECOND
    return df.where(within(F.col(column), day_ns(first), last_ns)).orderBy(column, "ord")


def is_spread(contract: Column) -> Column:
    return contract.contains("_CAL_")


def off_tick(price: Column, tick_fp: int | Column) -> Column:
    """Defined prices that aren't a multiple of the tick."""
    return (price != NO_PRICE) & (price % tick_fp != 0)


def unique_by(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key no other row has: one aggregation and a semi join, so a hot key is one row of the join."""
    alone = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where("_n = 1").drop("_n")
    return df.join(alone, keys, "left_semi")


def repeated_by(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key occurs more than once."""
    many = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    return df.join(many, keys, "left_semi")


def unpaired_trades(events: DataFrame) -> DataFrame:
    """Trades without a fill at the same time and price."""
    fills = events.where("action = 'FILL'").select("ts_event", "price").distinct()
    return events.where("action = 'TRADE'").join(fills, ["ts_event", "price"], "left_anti")


def clean(events: DataFrame, tick_fp: int, floor_fp: int, keys: list[str]) -> DataFrame:
    """Rows of the commonest contract of each group whose price is undefined, or on the tick and not under the floor."""
    ranked = Window.partitionBy(*keys).orderBy(F.desc("n"), "contract")
    main = events.groupBy(*keys, "contract").agg(F.count(F.lit(1)).alias("n")).withColumn("r", F.row_number().over(ranked)).where("r = 1")
    kept = events.join(main.select(*keys, "contract"), [*keys, "contract"], "left_semi")
    return kept.where((F.col("price") == NO_PRICE) | ((F.col("price") % tick_fp == 0) & (F.col("price") >= floor_fp)))
