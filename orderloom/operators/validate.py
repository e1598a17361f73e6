"""Event validation: field checks, duplicates, and coherence with the orders that are active."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.schemas import ACTIONS, F_BAD_TS, F_SNAPSHOT, F_TOB, NO_PRICE, ORDER_ACTIONS, RESTING_ACTIONS, SIDES, has_flag
from .filters import is_spread
from .stateful import run_columns

KEYS = ("contract", "session_date")
DUPLICATE_KEY = ("ts_event", "sequence", "order_id", "action", "price", "size")


def structural_reason() -> Column:
    """The first field check that a row fails, or null."""
    c, zero = F.col, lambda x: F.coalesce(F.col(x), F.lit(0)) == 0
    order, resting, tob = c("action").isin(*ORDER_ACTIONS), c("action").isin(*RESTING_ACTIONS), F.coalesce(has_flag(F_TOB), F.lit(False))
    priced = resting & ~tob
    outright = ~F.coalesce(is_spread(c("contract")), F.lit(False))
    checks = [
        (zero("ts_event"), "TS_EVENT_ZERO"),
        (zero("ts_recv"), "TS_RECV_ZERO"),
        (~F.coalesce(c("action").isin(*ACTIONS), F.lit(False)), "INVALID_ACTION"),
        (~F.coalesce(c("side").isin(*SIDES), F.lit(False)), "INVALID_SIDE"),
        (order & (c("side") == "NONE"), "INVALID_SIDE_FOR_ACTION"),
        (order & zero("order_id") & ~tob, "INVALID_ORDER_ID_ZERO"),
        (priced & (c("price").isNull() | (c("price") == NO_PRICE)), "MISSING_PRICE_FOR_ACTION"),
        (priced & outright & (c("price") == 0), "INVALID_PRICE_ZERO"),
        (priced & outright & (c("price") < 0), "INVALID_PRICE_NEGATIVE"),
        (resting & zero("size"), "INVALID_SIZE_ZERO"),
    ]
    out = F.lit(None).cast("string")
    for test, reason in reversed(checks):
        out = F.when(test, F.lit(reason)).otherwise(out)
    return out


def duplicate(keys: tuple[str, ...] = KEYS) -> Column:
    """Whether an order event repeats an earlier one of its key and warm-up phase; rows that fail field checks don't count.

    Needs structural_reason as reject_reason, and warmup. Its window is per event identity, so small."""
    countable = F.col("reject_reason").isNull() & F.col("action").isin(*ORDER_ACTIONS) & ~has_flag(F_TOB)
    by = Window.partitionBy(*keys, "warmup", *DUPLICATE_KEY, countable).orderBy("ord")
    return countable & (F.row_number().over(by) > 1)


def with_warmup(events: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """With warmup: whether no row before or at this one is live."""
    upto = Window.partitionBy(*keys).orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    return events.withColumn("warmup", F.min(F.when(has_flag(F_SNAPSHOT), 1).otherwise(0)).over(upto) == 1)


def stateless(events: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """With reject_reason by field checks and duplicates."""
    checked = with_warmup(events.withColumn("reject_reason", structural_reason()), keys)
    return checked.withColumn("reject_reason", F.when(duplicate(keys), F.lit("DUPLICATE_EVENT")).otherwise(F.col("reject_reason"))).drop("warmup")


class ActiveOrders:
    """Which orders are active, by id: a shadow of the book that is only as exact as validation needs.

    Any cancel ends an order, a part of one too. Orphan cancels are accepted; orphan modifies begin an order."""

    def __init__(self):
        self.side: dict[int, str] = {}
        self.orphans = 0

    def reason(self, action: str, order: int, side: str, flags: int) -> str | None:
        if action == "CLEAR":
            self.side.clear()
        if action not in ORDER_ACTIONS or flags & F_TOB:
            return None
        held = self.side.get(order)
        if action == "ADD":
            if held is not None:
                return "DUPLICATE_ADD"
            self.side[order] = side
        elif held is None:
            self.orphans += 1
            if action == "MODIFY":
                self.side[order] = side
        elif held != side:
            return "SIDE_MISMATCH"
        elif action == "CANCEL":
            del self.side[order]
        return None


def validate(events: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """All checks: the rows with reject_reason, null for clean ones."""
    first = stateless(events, keys)

    def make():
        active = ActiveOrders()

        def step(reason: str | None, *row) -> tuple:
            return (active.reason(*row) if reason is None else None,)

        return step

    extra = T.StructType([T.StructField("_active_reason", T.StringType())])
    rows = run_columns(first, keys, "ord", ("reject_reason", "action", "order_id", "side", "flags"), make, extra)
    return rows.withColumn("reject_reason", F.coalesce("reject_reason", "_active_reason")).drop("_active_reason")


def split(validated: DataFrame, mode: str = "STRICT") -> tuple[DataFrame, DataFrame]:
    """(kept, rejected). STRICT drops rejected rows; LOOSE keeps them with a flag; they are logged either way."""
    if mode not in ("STRICT", "LOOSE"):
        raise ValueError("mode must be STRICT or LOOSE")
    bad = F.col("reject_reason").isNotNull()
    rejected = validated.where(bad).withColumn("mode", F.lit(mode))
    if mode == "STRICT":
        return validated.where(~bad).drop("reject_reason"), rejected
    flagged = F.when(bad, F.col("flags").cast("int").bitwiseOR(F_BAD_TS)).otherwise(F.col("flags")).cast(dict(validated.dtypes)["flags"])
    return validated.withColumn("flags", flagged).drop("reject_reason"), rejected


def summary(validated: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    out = validated.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_validated"), F.count("reject_reason").alias("n_rejected"))
    return out.withColumn("clean_pct", 100.0 * (F.col("n_validated") - F.col("n_rejected")) / F.col("n_validated"))


def breakdown(validated: DataFrame) -> DataFrame:
    """Rejected rows by reason, day and hour."""
    hour = F.floor(F.pmod(F.col("ts_event"), F.lit(86_400_000_000_000)) / 3_600_000_000_000).cast("int")
    return validated.where("reject_reason is not null").groupBy("reject_reason", "session_date", hour.alias("hour")).agg(F.count(F.lit(1)).alias("n"))
