"""Binary order-by-order feed files as a Spark data source.

spark.dataSource.register(OmdSource); spark.read.format("omd").option("kind", "orders").load("dir/*.bin").
A partition is a stretch of a file: readers begin at the first record header after the stretch's start that several
further headers confirm, so one large file is read by many tasks. A zip archive is a partition per member. kind: series,
orders or trades. Paths are local or mounted files, which is what the feed's recorder writes.
"""

from __future__ import annotations

import glob as globbing
import os
import re
import struct
import zipfile
from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.schemas import RAW_ORDERS, RAW_TRADES

# Header sizes, message types, byte layouts and least payload sizes.
RECORD, MESSAGE = 18, 4
SERIES, SERIES_EXTENDED = 303, 304
ADD, MODIFY, DELETE, CLEAR, OPENING, TRADE = 330, 331, 332, 335, 364, 350
ORDER_TYPES = (ADD, MODIFY, DELETE, CLEAR, OPENING)
ORDER_BODY = struct.Struct("<IQiIBBHI")
TRADE_BODY = struct.Struct("<IQiQIBBHHxxQQ")
MOST = 2**31 - 1
SERIES_SCHEMA = "orderbook_id long, symbol string, class_code string, product_type int, decimals int, expiry string, msg_type int, priority int, channel string"
# Names of product types, parts of the feed that channels carry.
OPTION, FUTURE = 1, 3
PRODUCT_TYPES = {1: "Option", 2: "Forward", 3: "Future", 4: "FRA", 5: "Cash", 10: "SyntheticBoxLeg", 11: "Combination", 14: "Warrant"}
CHANNEL_PARTS = {"MC101": "Partition1", "MC201": "Partition2", "MC301": "Partition3", "MC151": "OAPI"}


def record_header(data: bytes, at: int) -> tuple[int, int, int, int]:
    """(bytes, messages, sequence, send time); only the length is big-endian."""
    (length,) = struct.unpack_from(">H", data, at)
    (count,) = struct.unpack_from("<B", data, at + 4)
    sequence, sent = struct.unpack_from("<IQ", data, at + 6)
    return length + 2, count, sequence, sent


def records(data: bytes, start: int = 0, end: int | None = None) -> Iterator[tuple[int, int, list[tuple[int, int, bytes]]]]:
    """(sequence, send time, messages) of the records that begin in [start, end); a bad length is skipped byte by byte."""
    at, end = start, len(data) if end is None else end
    while at < end and at + RECORD <= len(data):
        size, count, sequence, sent = record_header(data, at)
        if size < RECORD or at + size > len(data):
            at += 1
            continue
        place, messages = at + RECORD, []
        for index in range(count):
            if place + MESSAGE > at + size:
                break
            length, kind = struct.unpack_from("<HH", data, place)
            if length < MESSAGE or place + length > at + size:
                break
            messages.append((index, kind, data[place + MESSAGE : place + length]))
            place += length
        yield sequence, sent, messages
        at += size


def order_row(kind: int, body: bytes) -> tuple | None:
    """(orderbook_id, order_id, price, quantity, side, lot_type, order_type, position), or None if it is too short."""
    if len(body) < 4:
        return None
    (book,) = struct.unpack_from("<I", body)
    if kind in (ADD, MODIFY):
        return ORDER_BODY.unpack_from(body) if len(body) >= ORDER_BODY.size else None
    if kind == DELETE:
        return (book, *struct.unpack_from("<Q", body, 4), 0, 0, body[12], 0, 0, 0) if len(body) >= 13 else None
    price = struct.unpack_from("<i", body, 4)[0] if kind == OPENING and len(body) >= 8 else 0
    quantity = min(struct.unpack_from("<Q", body, 12)[0], MOST) if kind == OPENING and len(body) >= 20 else 0
    return book, 0, price, quantity, -1, 0, 0, 0


def trade_row(body: bytes) -> tuple | None:
    """(orderbook_id, order_id, price, trade_id, combo, side, deal_type, condition, info, quantity, trade time)."""
    return TRADE_BODY.unpack_from(body) if len(body) >= TRADE_BODY.size else None


def series_row(kind: int, body: bytes) -> tuple | None:
    """(orderbook_id, symbol, class_code, product_type, decimals, expiry): the class is the symbol's first three letters.

    Only base definitions hold the last three; the expiry is eight digits or null."""
    if len(body) < (39 if kind == SERIES else 36):
        return None
    symbol = body[4:36].split(b"\0")[0].decode("ascii", "replace").strip()
    more = (None, None, None)
    if kind == SERIES:
        expiry = body[44:52].decode("ascii", "replace")
        more = body[36], struct.unpack_from("<H", body, 37)[0], expiry if re.fullmatch("[0-9]{8}", expiry) else None
    return struct.unpack_from("<I", body)[0], symbol, symbol[:3], *more


def channel_of(path: str) -> str | None:
    """The channel that a file's name begins with, if it does so."""
    found = re.match(r"MC\d+", os.path.basename(path))
    return found and found.group()


class Stretch(InputPartition):
    """Part of a file, or a whole member of an archive."""

    def __init__(self, path: str, start: int, end: int | None, priority: int, member: str | None = None):
        self.path, self.start, self.end, self.priority, self.member = path, start, end, priority, member


class OmdReader(DataSourceReader):
    def __init__(self, options: dict):
        self.kind = options.get("kind", "orders")
        self.paths = sorted(p for part in options["path"].split(",") for p in globbing.glob(part))
        self.stretch = int(options.get("stretchBytes", 64 << 20))

    def partitions(self) -> list[InputPartition]:
        out = []
        for priority, path in enumerate(self.paths):
            if zipfile.is_zipfile(path):
                with zipfile.ZipFile(path) as archive:
                    out += [Stretch(path, 0, None, priority, name) for name in sorted(archive.namelist()) if not name.endswith("/")]
                continue
            size = os.path.getsize(path)
            out += [Stretch(path, a, min(a + self.stretch, size), priority) for a in range(0, max(size, 1), self.stretch)]
        return out

    def read(self, partition: Stretch) -> Iterator[tuple]:
        import mmap

        if partition.member is not None:
            with zipfile.ZipFile(partition.path) as archive:
                yield from self.rows(archive.read(partition.member), 0, None, partition.priority, channel_of(partition.member))
        elif os.path.getsize(partition.path):
            with open(partition.path, "rb") as f, mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ) as data:
                start = partition.start if not partition.start else first_record(data, partition.start)
                yield from self.rows(data, start, partition.end, partition.priority, channel_of(partition.path))

    def rows(self, data, start: int, end: int | None, priority: int, channel: str | None) -> Iterator[tuple]:
        for sequence, sent, messages in records(data, start, end):
            for index, kind, body in messages:
                if self.kind == "series" and kind in (SERIES, SERIES_EXTENDED):
                    if (row := series_row(kind, body)) is not None:
                        yield (*row, kind, priority, channel)
                elif self.kind == "orders" and kind in ORDER_TYPES:
                    if (row := order_row(kind, body)) is not None:
                        yield (sent, sequence, index, kind, row[0], None, None, *row[1:])
                elif self.kind == "trades" and kind == TRADE and (row := trade_row(body)) is not None:
                    book, order, price, trade, combo, side, deal, condition, info, quantity, when = row
                    yield (sent, sequence, index, when, book, None, None, order, price, quantity, trade, side, deal, combo, condition, info)


def first_record(data, at: int, confirm: int = 4) -> int:
    """The first place from `at` on where a chain of plausible records with rising send times begins."""
    while at + RECORD <= len(data):
        place, last, seen = at, 0, 0
        while seen < confirm and place + RECORD <= len(data):
            size, count, _, sent = record_header(data, place)
            if size < RECORD + MESSAGE * count or place + size > len(data) or sent < last or (not last and not 10**18 < sent < 3 * 10**18):
                break
            place, last, seen = place + size, sent, seen + 1
        if seen == confirm or (seen and place >= len(data) - RECORD):
            return at
        at += 1
    return len(data)


class OmdSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "omd"

    def schema(self):
        kind = self.options.get("kind", "orders")
        return {"orders": RAW_ORDERS, "trades": RAW_TRADES, "series": SERIES_SCHEMA}[kind]

    def reader(self, schema) -> OmdReader:
        return OmdReader(self.options)


def inventory(definitions: DataFrame) -> DataFrame:
    """One row per order book with all that is known of it: base definitions before extended ones, then the first channel."""
    by = Window.partitionBy("orderbook_id").orderBy("msg_type", "priority", "symbol")
    named = lambda c, values: F.element_at(F.create_map(*(F.lit(x) for kv in values.items() for x in kv)), F.col(c))
    unknown = F.concat(F.lit("Unknown("), F.col("product_type").cast("string"), F.lit(")"))
    chosen = definitions.where("orderbook_id > 0").withColumn("_r", F.row_number().over(by)).where("_r = 1").drop("_r", "priority")
    return chosen.withColumns({
        "product_type_name": F.coalesce(named("product_type", PRODUCT_TYPES), unknown),
        "is_future": F.coalesce(F.col("product_type") == FUTURE, F.lit(False)),
        "part": F.coalesce(named("channel", CHANNEL_PARTS), "channel"),
    })


def series(definitions: DataFrame, futures_only: bool = False) -> DataFrame:
    """(orderbook_id, symbol, class_code), one row per order book, as inventory chooses it.

    futures_only: base definitions of other products go first; extended ones don't say their product, and stay."""
    wanted = definitions.where(F.col("product_type").isNull() | (F.col("product_type") == FUTURE)) if futures_only else definitions
    return inventory(wanted).select("orderbook_id", "symbol", "class_code")


def resolved(rows: DataFrame, known: DataFrame, classes: list[str] | None = None) -> DataFrame:
    """Rows with symbol and class; those of unknown books are dropped. Definitions of a day are a few thousand rows."""
    names = known if classes is None else known.where(F.col("class_code").isin(*classes))
    out = rows.drop("symbol", "class_code").join(names.select("orderbook_id", "symbol", "class_code"), "orderbook_id")
    return out.select(*rows.columns)


def write_by_class(rows: DataFrame, path: str) -> None:
    """A folder per class; a class without rows has none."""
    rows.repartition("class_code").sortWithinPartitions("seq_num", "msg_index").write.mode("overwrite").partitionBy("class_code").parquet(path)


def instruments(definitions: DataFrame) -> DataFrame:
    """Order books and distinct symbols per class, by product type, their decimals, expiries and channels: what a feed holds."""
    of_type = lambda *kinds: F.count_if(F.col("product_type").isin(*kinds))
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    n, futures, options = F.count(F.lit(1)), F.coalesce(of_type(FUTURE), F.lit(0)), F.coalesce(of_type(OPTION), F.lit(0))
    return inventory(definitions).groupBy("class_code").agg(
        n.alias("n_books"), F.count_distinct("symbol").alias("n_symbols"), F.min("symbol").alias("first"), F.max("symbol").alias("last"),
        futures.alias("n_futures"), options.alias("n_options"), (n - futures - options).alias("n_other"), joined("decimals").alias("decimals"),
        F.min("expiry").alias("first_expiry"), F.max("expiry").alias("last_expiry"), joined("channel").alias("channels"),
    )


def with_printable(trades: DataFrame) -> DataFrame:
    """Whether a trade counts for public volume: the first bit of its deal type."""
    return trades.withColumn("is_printable", F.col("deal_type").cast("int").bitwiseAND(1) == 1)
