"""Column names, types and codes of the event tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Price scale, the undefined price, flag bits, actions, sides.
SCALE = 1_000_000_000
NO_PRICE = 9_223_372_036_854_775_807
F_LAST, F_SNAPSHOT, F_BAD_TS, F_TOB = 0x80, 0x20, 0x04, 0x01
ACTIONS = ("ADD", "CANCEL", "MODIFY", "CLEAR", "TRADE", "FILL", "NONE")
SIDES = ("BID", "ASK", "NONE")
ORDER_ACTIONS = ("ADD", "CANCEL", "MODIFY")
RESTING_ACTIONS = ("ADD", "MODIFY")
VENDOR_ACTIONS = {"A": "ADD", "C": "CANCEL", "M": "MODIFY", "R": "CLEAR", "T": "TRADE", "F": "FILL", "N": "NONE"}
VENDOR_SIDES = {"B": "BID", "A": "ASK", "N": "NONE"}


def _struct(text: str) -> T.StructType:
    fields = (f.strip().rsplit(" ", 1) for f in text.split(","))
    kinds = {"long": T.LongType(), "int": T.IntegerType(), "short": T.ShortType(), "byte": T.ByteType(), "string": T.StringType(), "double": T.DoubleType()}
    return T.StructType([T.StructField(name, kinds[kind]) for name, kind in fields])


MBO = _struct(
    "ts_event long, ts_recv long, venue string, product string, contract string, action string, side string, price long, size long, "
    "order_id long, flags short, sequence long, publisher_id int, instrument_id long, ord long"
)
REJECTED = T.StructType([*MBO.fields, T.StructField("reject_reason", T.StringType()), T.StructField("mode", T.StringType())])
MBP1 = _struct(
    "ts_event long, ts_recv long, action string, side string, price double, flags short, sequence long, bid_px_00 double, ask_px_00 double, "
    "bid_sz_00 long, ask_sz_00 long, bid_ct_00 long, ask_ct_00 long, ord long"
)
RAW_ORDERS = _struct(
    "send_time_ns long, seq_num long, msg_index int, msg_type int, orderbook_id long, symbol string, class_code string, order_id long, "
    "price int, quantity int, side byte, lot_type short, order_type int, orderbook_position long"
)
RAW_TRADES = _struct(
    "send_time_ns long, seq_num long, msg_index int, trade_time_ns long, orderbook_id long, symbol string, class_code string, order_id long, "
    "price int, quantity long, trade_id long, side byte, deal_type short, combo_group_id long, trade_condition int, deal_info int"
)


def normalize_types(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Cast the columns of schema that df has, once, so unsigned and dictionary types of foreign files don't spread."""
    own = set(df.columns)
    return df.select(*(F.col(f.name).cast(f.dataType).alias(f.name) if f.name in own else F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields))


def has_flag(bit: int, name: str = "flags") -> Column:
    return F.col(name).cast("int").bitwiseAND(bit) > 0


def require(df: DataFrame, columns: list[str]) -> None:
    """ValueError for columns that df lacks."""
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")


def ratio(a: Column, b: Column) -> Column:
    """a / b in double precision, null where b is 0."""
    return F.when(b != 0, a.cast("double") / b.cast("double"))


def round_to(x: Column, digits: int) -> Column:
    """x rounded as doubles are, by what it is in binary, halves away from 0."""
    scale = float(10**digits)
    return F.signum(x) * F.floor(F.abs(x) * scale + 0.5) / scale
