"""Provider events to normalised ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.catalog import parse_hkex_symbol, parse_symbol, product_of_column
from ..functions.schemas import F_BAD_TS, F_LAST, SCALE, VENDOR_ACTIONS, VENDOR_SIDES, has_flag

# Venue of each data set, actions of message types, sides of order and of trade codes.
VENUES = {"glbx.mdp3": "CME", "xeur.eobi": "EUREX", "xnas.itch": "NASDAQ", "xnys.pillar": "NYSE"}
MESSAGES = {330: "ADD", 331: "MODIFY", 332: "CANCEL", 335: "CLEAR", 350: "TRADE"}
ORDER_SIDES = {0: "BID", 1: "ASK", -1: "NONE"}
TRADE_SIDES = {0: "NONE", 2: "ASK", 3: "BID"}
RESTING_SIDES = {0: "NONE", 2: "BID", 3: "ASK"}


def mapped(c: Column, values: dict, default=None) -> Column:
    """A column's values through a small fixed table."""
    found = F.element_at(F.create_map(*(F.lit(x) for kv in values.items() for x in kv)), c)
    return found if default is None else F.coalesce(found, default if isinstance(default, Column) else F.lit(default))


def venue(dataset: Column) -> Column:
    return mapped(F.lower(dataset), VENUES, F.upper(dataset))


def vendor_flags(flags: Column) -> Column:
    """The vendor's bit for an unreliable receive time, 0x08, becomes that of an unreliable event time."""
    f = flags.cast("int")
    return F.when(f.bitwiseAND(8) > 0, f.bitwiseAND(~8 & 0xFF).bitwiseOR(F_BAD_TS)).otherwise(f).cast("short")


def vendor_translate(raw: DataFrame, dataset: str | None = None) -> DataFrame:
    """Landing rows (symbol, action, side as letters, session_date, ...) to events; unknown symbols and letters are dropped.

    dataset: what all rows are of; without it raw has a column of that name.
    A symbol is parsed once, not once per event: distinct symbols of a session are few."""
    names = raw.select("symbol", "session_date").distinct().withColumn("parsed", parse_symbol(F.col("symbol"), F.year("session_date"))).where("parsed is not null")
    out = raw.withColumn("_action", mapped(F.col("action"), VENDOR_ACTIONS)).where("_action is not null").join(names, ["symbol", "session_date"])
    return out.withColumns(
        {
            "venue": venue(F.col("dataset") if dataset is None else F.lit(dataset)),
            "product": F.col("parsed.product"),
            "contract": F.col("parsed.contract"),
            "action": F.col("_action"),
            "side": mapped(F.col("side"), VENDOR_SIDES, "NONE"),
            "flags": vendor_flags(F.col("flags")),
        }
    ).drop("_action", "parsed")


def merge_raw(orders: DataFrame, trades: DataFrame) -> DataFrame:
    """Orders and trades of an exchange day as one stream; each side's own columns are null on the other."""
    tagged = orders.withColumn("source", F.lit("order")).unionByName(trades.withColumn("source", F.lit("trade")).withColumn("msg_type", F.lit(350)), allowMissingColumns=True)
    return tagged


def instruments(orders: DataFrame) -> DataFrame:
    """(orderbook_id, symbol) of a day."""
    return orders.select("orderbook_id", "symbol").distinct().orderBy("symbol", "orderbook_id")


def with_product(events: DataFrame, products: DataFrame) -> DataFrame:
    """Tick and currency of each contract's product, HKD where it is unknown; the dimension is fixed in size."""
    named = events.withColumn("product", product_of_column(F.col("contract")))
    dim = products.select("product", "tick_size_fp", F.col("currency").alias("_currency"))
    return named.join(F.broadcast(dim), "product", "left").withColumn("currency", F.coalesce("_currency", F.lit("HKD"))).drop("_currency")


def resolve_deletes(raw: DataFrame, order: tuple[str, ...] = ("seq_num", "msg_index")) -> DataFrame:
    """With price and size of deletes, which carry none: those last set, less what has traded since; 0 for unknown orders.

    Within an order's key (orderbook_id, order_id, resting side) adds and modifies begin an epoch. A delete takes the
    epoch's price and what is left of its size, unless a delete or a full fill has already ended it. All windows are
    per order, so the largest group is one order's messages."""
    side = F.when(F.col("msg_type") == 350, mapped(F.col("side").cast("int"), RESTING_SIDES, "NONE")).otherwise(mapped(F.col("side").cast("int"), ORDER_SIDES, "NONE"))
    key = Window.partitionBy("orderbook_id", "order_id", "_side").orderBy(*order)
    before = key.rowsBetween(Window.unboundedPreceding, -1)
    sets = F.col("msg_type").isin(330, 331)
    rows = raw.withColumn("_side", side).withColumn("_epoch", F.sum(F.when(sets, 1).otherwise(0)).over(key.rowsBetween(Window.unboundedPreceding, 0)))
    epoch = Window.partitionBy("orderbook_id", "order_id", "_side", "_epoch").orderBy(*order)
    earlier = epoch.rowsBetween(Window.unboundedPreceding, -1)
    first = epoch.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns(
        {
            "_set_price": F.first(F.when(sets, F.col("price")), ignorenulls=True).over(first),
            "_set_size": F.first(F.when(sets, F.col("quantity")), ignorenulls=True).over(first),
            "_traded": F.coalesce(F.sum(F.when(F.col("msg_type") == 350, F.col("quantity"))).over(earlier), F.lit(0)),
            "_deleted": F.coalesce(F.sum(F.when(F.col("msg_type") == 332, 1)).over(earlier), F.lit(0)),
        }
    )
    left = F.greatest(F.col("_set_size") - F.col("_traded"), F.lit(0))
    live = (F.col("_epoch") > 0) & (F.col("_deleted") == 0) & (left > 0)
    is_delete = F.col("msg_type") == 332
    out = rows.withColumn("price", F.when(is_delete, F.when(live, F.col("_set_price")).otherwise(0)).otherwise(F.col("price")))
    out = out.withColumn("quantity", F.when(is_delete, F.when(live, left).otherwise(0)).otherwise(F.col("quantity")))
    return out.drop("_epoch", "_set_price", "_set_size", "_traded", "_deleted")


def without_order(raw: DataFrame) -> DataFrame:
    """Messages without an order id, as resolve_deletes gives others: a delete among them has no price and size."""
    gone = F.col("msg_type") == 332
    side = mapped(F.col("side").cast("int"), ORDER_SIDES, "NONE")
    return raw.withColumns({"_side": side, "price": F.when(gone, 0).otherwise(F.col("price")), "quantity": F.when(gone, 0).otherwise(F.col("quantity"))})


def explode_trades(raw: DataFrame) -> DataFrame:
    """Exchange messages to events with sub_ord: a trade becomes TRADE, FILL without flags and CANCEL of the resting order.

    Trades without an order id and informational messages are dropped."""
    known = raw.where(F.col("msg_type").isin(*MESSAGES) & ~((F.col("msg_type") == 350) & (F.col("order_id") == 0)))
    flags = F_LAST | F_BAD_TS
    one = lambda action, side, f: F.struct(action.alias("action"), side.alias("event_side"), F.lit(f).cast("short").alias("flags"))
    resting = mapped(F.col("side").cast("int"), RESTING_SIDES, "NONE")
    trade = F.array(one(F.lit("TRADE"), mapped(F.col("side").cast("int"), TRADE_SIDES, "NONE"), flags), one(F.lit("FILL"), resting, 0), one(F.lit("CANCEL"), resting, flags))
    other = F.array(one(mapped(F.col("msg_type"), MESSAGES), mapped(F.col("side").cast("int"), ORDER_SIDES, "NONE"), flags))
    rows = known.select("*", F.posexplode(F.when(F.col("msg_type") == 350, trade).otherwise(other)).alias("sub_ord", "e"))
    return rows.withColumn("action", F.col("e.action")).withColumn("side", F.col("e.event_side")).withColumn("flags", F.col("e.flags")).drop("e")


def hkex_translate(orders: DataFrame, trades: DataFrame, session_year: int) -> DataFrame:
    """Raw orders and trades to normalised events, ordered by (seq_num, msg_index, sub_ord) within an order book."""
    names = orders.select("orderbook_id", "symbol").union(trades.select("orderbook_id", "symbol")).distinct()
    names = names.withColumn("parsed", parse_hkex_symbol(F.col("symbol"), F.lit(session_year))).where("parsed is not null").select("orderbook_id", "parsed.*").dropDuplicates(["orderbook_id"])
    merged = merge_raw(orders, trades).join(names, "orderbook_id")
    # Messages without an order would be one window of an order book: they need no look back, and trades among them are dropped anyway.
    own = F.coalesce(F.col("order_id"), F.lit(0)) != 0
    rows = explode_trades(resolve_deletes(merged.where(own)).unionByName(without_order(merged.where(~own & (F.col("msg_type") != 350)))))
    event_time = F.when((F.col("source") == "trade") & (F.col("trade_time_ns") > 0), F.col("trade_time_ns")).otherwise(F.col("send_time_ns"))
    return rows.select(
        event_time.alias("ts_event"), F.col("send_time_ns").alias("ts_recv"), F.lit("HKEX").alias("venue"), "product", "contract", "action", "side",
        (F.col("price").cast("long") * SCALE).alias("price"), F.col("quantity").cast("long").alias("size"), "order_id", "flags",
        F.col("seq_num").bitwiseAND(0xFFFFFFFF).alias("sequence"), F.lit(0).alias("publisher_id"), F.col("orderbook_id").alias("instrument_id"), "seq_num", "msg_index", "sub_ord",
    )


def reconstitute_modifies(events: DataFrame, keys: tuple[str, ...] = ("contract", "session_date")) -> DataFrame:
    """A cancel right before an add of the same order and side, and not part of a fill, is one modify at the add's place.

    Right before means the row before, of all rows of the contract-day in file order."""
    by = Window.partitionBy(*keys).orderBy("ord")
    # The exchange by contract-day, which comes first, serves the windows by sequence, too.
    rows = events.repartition(*keys).withColumn("_pair", F.lead(F.struct("action", "order_id", "side")).over(by))
    filled = F.max(F.when(F.col("action") == "FILL", 1).otherwise(0)).over(Window.partitionBy(*keys, "sequence")) == 1
    gone = (F.col("action") == "CANCEL") & (F.col("order_id") > 0) & ~filled & (F.col("_pair.action") == "ADD") & (F.col("_pair.order_id") == F.col("order_id")) & (F.col("_pair.side") == F.col("side"))
    rows = rows.withColumn("_gone", F.coalesce(gone, F.lit(False))).withColumn("_after", F.coalesce(F.lag("_gone").over(by), F.lit(False)))
    return rows.where(~F.col("_gone")).withColumn("action", F.when(F.col("_after"), F.lit("MODIFY")).otherwise(F.col("action"))).drop("_pair", "_gone", "_after")


def already_reconstituted(events: DataFrame) -> bool:
    """Whether a stream of a provider without modifies has some."""
    return not events.where("action = 'MODIFY'").limit(1).isEmpty()


def warmup_end(events: DataFrame, keys: tuple[str, ...] = ("contract", "session_date")) -> DataFrame:
    """The position of each key's first row that isn't from a snapshot."""
    return events.groupBy(*keys).agg(F.min(F.when(~has_flag(0x20), F.col("ord"))).alias("first_live"))
