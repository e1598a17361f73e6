"""Limit-order-book replay: normalised events to top-of-book rows, one key's events in order at a time."""

from __future__ import annotations

import bisect

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.schemas import F_LAST, F_SNAPSHOT, F_TOB, MBP1, NO_PRICE, SCALE
from .stateful import run_columns

KEYS = ("contract", "session_date")


class Level:
    """Orders at a price, by time; total size and number are kept up to date."""

    __slots__ = ("size", "count", "queue")

    def __init__(self):
        self.size, self.count, self.queue = 0, 0, {}


class SideBook:
    """One side's levels with its prices in order."""

    def __init__(self, best_last: bool):
        self.levels: dict[int, Level] = {}
        self.prices: list[int] = []
        self.best_last = best_last

    def level(self, price: int) -> Level:
        if price not in self.levels:
            self.levels[price] = Level()
            bisect.insort(self.prices, price)
        return self.levels[price]

    def drop(self, price: int) -> None:
        del self.levels[price]
        self.prices.pop(bisect.bisect_left(self.prices, price))

    def clear(self) -> None:
        self.levels.clear()
        self.prices.clear()

    def top(self, depth: int) -> list[tuple[int, int, int]]:
        """(price, size, orders) of the best levels."""
        prices = self.prices[: -depth - 1 : -1] if self.best_last else self.prices[:depth]
        return [(p, self.levels[p].size, self.levels[p].count) for p in prices]


class Book:
    """Both sides and the orders by (id, side).

    A cancel is looked up at its own price, and ignored as an orphan if no level is there; with repair it is looked up at
    the order's price, and an add of an id that rests already, or the clearing of a side, takes the old orders away."""

    def __init__(self, repair: bool = False):
        self.sides = {"BID": SideBook(True), "ASK": SideBook(False)}
        self.orders: dict[tuple[int, str], list] = {}  # [price, size, counts]
        self.orphan_cancels = self.orphan_modifies = 0
        self.repair = repair

    def apply(self, action: str, side: str, price: int, size: int, order_id: int, flags: int) -> bool:
        """Whether the event is one that changes the book."""
        if action not in ("ADD", "CANCEL", "MODIFY", "CLEAR"):
            return False
        if action == "CLEAR":
            for s in self.sides.values():
                s.clear()
            self.orders.clear()
            return True
        tob = flags & F_TOB
        if side not in self.sides:
            return False
        if tob and price == NO_PRICE:
            self._empty(side)
        elif action == "ADD":
            self._add(side, price, size, order_id, tob)
        elif action == "CANCEL":
            self._cancel(side, price, size, order_id)
        else:
            self._modify(side, price, size, order_id, tob)
        return True

    def _empty(self, side: str) -> None:
        self.sides[side].clear()
        if self.repair:
            for key in [k for k in self.orders if k[1] == side]:
                del self.orders[key]

    def _add(self, side: str, price: int, size: int, order_id: int, tob: int) -> None:
        if tob:
            self._empty(side)
            level = self.sides[side].level(price)
            level.size, level.queue = size, {id(level): None}
            return
        key = (order_id, side)
        if self.repair and key in self.orders:
            self._leave(key, self.orders[key])
        order = [price, size, 1]
        self.orders[key] = order
        self._join(side, order)

    def _join(self, side: str, order: list) -> None:
        level = self.sides[side].level(order[0])
        level.size += order[1]
        level.count += order[2]
        level.queue[id(order)] = order

    def _leave(self, key: tuple[int, str], order: list) -> None:
        side = self.sides[key[1]]
        if (level := side.levels.get(order[0])) is None:
            return
        level.size -= order[1]
        level.count -= order[2]
        level.queue.pop(id(order), None)
        if not level.queue:
            side.drop(order[0])

    def _cancel(self, side: str, price: int, size: int, order_id: int) -> None:
        key = (order_id, side)
        order = self.orders.get(key)
        at = order[0] if order and self.repair else price
        level = self.sides[side].levels.get(at) if order else None
        if level is None:
            self.orphan_cancels += 1
            return
        taken = min(order[1], size)
        level.size -= taken
        order[1] -= taken
        if order[1] == 0:
            del self.orders[key]
            level.count -= order[2]
            level.queue.pop(id(order), None)
            if not level.queue:
                self.sides[side].drop(at)

    def _modify(self, side: str, price: int, size: int, order_id: int, tob: int) -> None:
        key = (order_id, side)
        order = self.orders.get(key)
        if order is None:
            self.orphan_modifies += 1
            self._add(side, price, size, order_id, tob)
        elif order[0] not in self.sides[side].levels:
            self._add(side, price, size, order_id, tob)
        elif order[0] != price or size > order[1]:
            self._leave(key, order)
            order[0], order[1] = price, size
            self._join(side, order)
        else:
            self.sides[side].levels[price].size -= order[1] - size
            order[1] = size

    def ahead(self, order_id: int, side: str) -> int | None:
        """Orders before this one at its price."""
        order = self.orders.get((order_id, side))
        return None if order is None else list(self.sides[side].levels[order[0]].queue).index(id(order))


class Replay:
    """A row for each group of events that ends in F_LAST, is live, and changed the book or traded."""

    def __init__(self, depth: int, repair: bool):
        self.book, self.depth = Book(repair), depth
        self.changed = self.traded = False

    def __call__(self, action: str, side: str, price: int, size: int, order_id: int, flags: int) -> tuple | None:
        self.changed |= self.book.apply(action, side, price, size, order_id, flags)
        self.traded |= action in ("TRADE", "FILL")
        if not flags & F_LAST:
            return None
        emit = (self.changed or self.traded) and not flags & F_SNAPSHOT
        self.changed = self.traded = False
        if not emit:
            return None
        bids, asks = (side.top(self.depth) for side in self.book.sides.values())
        none = (None, None, None)
        pairs = zip(*(x + [none] * (self.depth - len(x)) for x in (bids, asks)))
        return tuple(x for (bp, bs, bc), (ap, as_, ac) in pairs for x in (None if bp is None else bp / SCALE, None if ap is None else ap / SCALE, bs, as_, bc, ac))


def level_schema(depth: int) -> T.StructType:
    return T.StructType([T.StructField(f"{s}_{c}_{k:02d}", t) for k in range(depth) for c, t in (("px", T.DoubleType()), ("sz", T.LongType()), ("ct", T.LongType())) for s in ("bid", "ask")])


def reconstruct(events: DataFrame, depth: int = 1, repair: bool = False, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Snapshots of the best `depth` levels; parallel over keys, each key's events in order of ord."""
    plain = [f for f in MBP1.fields if f.name[:3] not in ("bid", "ask")]
    own = events.select(*keys, *(f.name for f in plain), "size", "order_id")
    rows = run_columns(own, keys, "ord", ("action", "side", "price", "size", "order_id", "flags"), lambda: Replay(depth, repair), level_schema(depth))
    price = F.when(F.col("price") != NO_PRICE, F.col("price") / float(SCALE))
    return rows.withColumn("price", price).select(*keys, *(F.col(f.name).cast(f.dataType).alias(f.name) for f in plain), *level_schema(depth).fieldNames())


def orphan_counts(events: DataFrame, repair: bool = False, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """How many cancels and modifies of each key met no order: running counts, of which the last is taken."""
    reads = ("action", "side", "price", "size", "order_id", "flags")

    def make():
        book = Book(repair)

        def step(*row) -> tuple | None:
            was = book.orphan_cancels, book.orphan_modifies
            book.apply(*row)
            gained = book.orphan_cancels - was[0], book.orphan_modifies - was[1]
            return gained if any(gained) else None

        return step

    extra = T.StructType([T.StructField("orphan_cancels", T.LongType()), T.StructField("orphan_modifies", T.LongType())])
    return run_columns(events.select(*keys, "ord", *reads), keys, "ord", reads, make, extra).groupBy(*keys).sum("orphan_cancels", "orphan_modifies").toDF(*keys, "orphan_cancels", "orphan_modifies")


def consolidated(quotes: DataFrame, publishers: list[int], keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Best prices over publishers after each row: the last quote of each, then the best of them, with summed sizes."""
    by = Window.partitionBy(*keys).orderBy("ts_recv", "ord").rowsBetween(Window.unboundedPreceding, 0)
    last = {f"_{c}_{p}": F.last(F.when(F.col("publisher_id") == p, F.struct(F.col(f"{c}_px_00").alias("px"), F.col(f"{c}_sz_00").alias("sz"))), ignorenulls=True).over(by) for p in publishers for c in ("bid", "ask")}
    out = quotes.withColumns(last)
    for c, best in (("bid", F.greatest), ("ask", F.least)):
        prices = [F.col(f"_{c}_{p}.px") for p in publishers]
        out = out.withColumn(f"best_{c}", best(*prices, F.lit(None).cast("double")))
        size = sum((F.when(F.col(f"_{c}_{p}.px") == F.col(f"best_{c}"), F.col(f"_{c}_{p}.sz")).otherwise(0) for p in publishers), F.lit(0))
        out = out.withColumn(f"best_{c}_sz", size)
    return out.drop(*last)
