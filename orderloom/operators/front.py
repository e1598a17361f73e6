"""Contracts of a product and the front one."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.catalog import expiry
from .filters import is_spread


def outrights(events: DataFrame) -> DataFrame:
    return events.where(~is_spread(F.col("contract")))


def by_volume(events: DataFrame, keys: tuple[str, ...] = ("session_date",)) -> DataFrame:
    """(keys, contract): the outright with most trades; without any trade, the one that expires first. Ties go to the first name.

    One aggregation over the two columns it needs; the ranking is over contracts, not events."""
    counts = outrights(events).groupBy(*keys, "contract").agg(F.count_if(F.col("action") == "TRADE").alias("n_trade"))
    order = Window.partitionBy(*keys).orderBy(F.desc("n_trade"), F.when(F.col("n_trade") == 0, expiry(F.col("contract"))).asc_nulls_last(), "contract")
    best = counts.withColumn("r", F.row_number().over(order))
    return best.where("r = 1").select(*keys, "contract", "n_trade")


def by_expiry(events: DataFrame, keys: tuple[str, ...] = ("session_date",), strict: bool = False) -> DataFrame:
    """(keys, contract): the outright of the earliest expiry that isn't over at the group's date.

    Where all have expired, the first of them. strict: don't look at the date, as where two-digit years are read far
    into the future."""
    month = F.year(F.col(keys[0])) * 12 + F.month(F.col(keys[0]))
    known = outrights(events).select(*keys, "contract").distinct().withColumn("expiry", expiry(F.col("contract"))).where("expiry is not null")
    over = F.lit(False) if strict else F.col("expiry") < month
    return known.groupBy(*keys).agg(F.min(F.struct(over.alias("over"), "expiry", "contract")).alias("m")).select(*keys, F.col("m.contract").alias("contract"))


def front(events: DataFrame, method: str = "volume", keys: tuple[str, ...] = ("session_date",)) -> DataFrame:
    methods = {"volume": by_volume, "expiry": by_expiry}
    if method not in methods:
        raise ValueError(f"method must be one of {', '.join(methods)}")
    return methods[method](events, keys).select(*keys, "contract")


def front_events(events: DataFrame, method: str = "volume", keys: tuple[str, ...] = ("session_date",)) -> DataFrame:
    """The events of each group's front contract."""
    return events.join(front(events, method, keys), [*keys, "contract"], "left_semi")
