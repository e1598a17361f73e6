"""Vendor files of order-by-order events in the public binary encoding, plain or compressed, as a Spark data source.

spark.dataSource.register(DbnSource); spark.read.format("dbn").load("dir/*.mbo.dbn.zst"). A file is a partition, as a
compressed stream can't be entered in its middle; files hold a day. Blocks of records become Arrow batches through numpy,
so a task holds a block whatever the file's size. Paths are local or mounted files.

Rows are what normalize.vendor_translate takes. Symbols come from the file's own mappings, for the day of the receive
time in UTC; where there is none the symbol is null. Records of other kinds are passed over; undefined times become 0,
which validation rejects; ids beyond 63 bits keep their bits. A file cut off inside a record gives the records before it.
"""

from __future__ import annotations

import datetime as dt
import glob as globbing
import io
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# Magic numbers, the header's fixed part by version, symbol widths, the kind of symbol that is an instrument
# id, the kind of record, its layout, and the undefined time.
MAGIC, ZSTD = b"DBN", b"\x28\xb5\x2f\xfd"
HEADER = {1: struct.Struct("<16sHQQQQBBB47x"), 2: struct.Struct("<16sHQQQBBBH53x"), 3: struct.Struct("<16sHQQQBBBH53x")}
SYMBOL_WIDTH = 22
INSTRUMENT_ID = 0
MBO = 0xA0
RECORD = np.dtype(
    [("length", "u1"), ("rtype", "u1"), ("publisher_id", "<u2"), ("instrument_id", "<u4"), ("ts_event", "<u8"), ("order_id", "<u8"), ("price", "<i8"), ("size", "<u4"),
     ("flags", "u1"), ("channel_id", "u1"), ("action", "S1"), ("side", "S1"), ("ts_recv", "<u8"), ("ts_in_delta", "<i4"), ("sequence", "<u4")]
)
NO_TIME = np.uint64(2**64 - 1)

DAY_NS = 86_400_000_000_000
#: Bytes decoded at once, and records that a file may have before the numbers of the next one begin.
BLOCK, FILE_RECORDS = 56 << 14, 1 << 40
SCHEMA = (
    "ts_event long, ts_recv long, dataset string, symbol string, session_date date, action string, side string, price long, size long, order_id long, "
    "flags short, sequence long, publisher_id int, instrument_id long, channel_id short, ts_in_delta int, ord long"
)


class Metadata:
    """A file's header: its data set, and the symbol of each instrument by days."""

    def __init__(self, version: int, body: bytes):
        if version not in HEADER:
            raise ValueError(f"version {version} of the encoding isn't known")
        fields = HEADER[version].unpack_from(body)
        self.dataset = _text(fields[0])
        if version == 1:
            stype_in, self.ts_out, width = fields[6], fields[8], SYMBOL_WIDTH
        else:
            stype_in, self.ts_out, width = fields[5], fields[7], fields[8]
        self._body, self._at = body, HEADER[version].size
        self._skip(self._number())
        for _ in range(3):
            self._skip(self._number() * width)
        #: (instrument id, first day, day after the last, symbol)
        self.intervals: list[tuple[int, dt.date, dt.date, str]] = []
        for _ in range(self._number()):
            symbol = self._symbol(width)
            for _ in range(self._number()):
                first, end, other = _day(self._number()), _day(self._number()), self._symbol(width)
                number, name = (symbol, other) if stype_in == INSTRUMENT_ID else (other, symbol)
                if name and number.isdigit():
                    self.intervals.append((int(number), first, end, name))

    def _number(self) -> int:
        self._at += 4
        return struct.unpack_from("<I", self._body, self._at - 4)[0]

    def _symbol(self, width: int) -> str:
        self._at += width
        return _text(self._body[self._at - width : self._at])

    def _skip(self, n: int) -> None:
        self._at += n

    def symbols(self, day: dt.date) -> dict[int, str]:
        """Symbols of the instruments that the file maps on a day."""
        return {number: name for number, first, end, name in self.intervals if first <= day < end}


def _text(raw: bytes) -> str:
    return raw.split(b"\0")[0].decode("utf-8", "replace")


def _day(number: int) -> dt.date:
    return dt.date(number // 10000, number // 100 % 100, number % 100)


def opened(path: str) -> io.BufferedIOBase:
    """The file's bytes, decompressed if need be."""
    f = open(path, "rb")
    compressed = f.read(4) == ZSTD
    f.seek(0)
    if not compressed:
        return f
    import zstandard

    return zstandard.ZstdDecompressor().stream_reader(f, read_across_frames=True, closefd=True)


def _exactly(f, n: int) -> bytes:
    """The next n bytes, fewer at the end only: a decompressing reader may give fewer at once."""
    parts, held = [], 0
    while held < n and (part := f.read(n - held)):
        parts.append(part)
        held += len(part)
    return b"".join(parts)


def metadata(f) -> Metadata:
    """Read the header; the first record comes next."""
    prefix = _exactly(f, 8)
    if len(prefix) < 8 or prefix[:3] != MAGIC:
        raise ValueError("not a file of this encoding")
    (length,) = struct.unpack_from("<I", prefix, 4)
    body = _exactly(f, length)
    if len(body) < length:
        raise ValueError("the header is cut off")
    return Metadata(prefix[3], body)


def records(f, block: int = BLOCK) -> Iterator[np.ndarray]:
    """Event records in blocks; those of other kinds are passed over by their own length.

    Neighbouring records of one length are taken at once. A record may be longer than the layout, which then is its start."""
    rest = b""
    while True:
        new = _exactly(f, block)
        data, at, found = rest + new, 0, []
        while at < len(data) and len(data) - at >= (size := 4 * data[at]):
            if not size:
                raise ValueError("a record without length")
            rows = np.frombuffer(data, np.uint8, (len(data) - at) // size * size, at).reshape(-1, size)
            other = np.flatnonzero(rows[:, 0] != data[at])
            rows = rows[: other[0]] if len(other) else rows
            at += rows.size
            if size >= RECORD.itemsize:
                events = rows[rows[:, 1] == MBO, : RECORD.itemsize]
                found.append(np.ascontiguousarray(events).reshape(-1).view(RECORD))
        if found and (out := np.concatenate(found)).size:
            yield out
        if not new:
            return
        rest = data[at:]


def _letters(values: np.ndarray) -> pa.Array:
    return pa.array(values.astype("U1"), pa.string())


def _signed(values: np.ndarray) -> pa.Array:
    return pa.array(values.astype("<u8").view("<i8"), pa.int64())


def _times(values: np.ndarray) -> np.ndarray:
    return np.where(values == NO_TIME, np.uint64(0), values).astype("<i8")


class Batches:
    """Records of a file to rows."""

    def __init__(self, meta: Metadata, first: int):
        self.meta, self.next, self.known = meta, first, {}

    def _symbols(self, days: np.ndarray, instruments: np.ndarray) -> pa.Array:
        pairs = (days.astype(np.uint64) << np.uint64(32)) | instruments.astype(np.uint64)
        distinct, place = np.unique(pairs, return_inverse=True)
        names = []
        for pair in distinct.tolist():
            day = pair >> 32
            if day not in self.known:
                self.known[day] = self.meta.symbols(dt.date(1970, 1, 1) + dt.timedelta(days=day))
            names.append(self.known[day].get(pair & 0xFFFFFFFF))
        return pa.array(names, pa.string()).take(pa.array(place))

    def batch(self, r: np.ndarray) -> pa.RecordBatch:
        received = _times(r["ts_recv"])
        days = received // DAY_NS
        order = np.arange(self.next, self.next + len(r))
        self.next += len(r)
        columns = {
            "ts_event": pa.array(_times(r["ts_event"])), "ts_recv": pa.array(received), "dataset": pa.array([self.meta.dataset] * len(r), pa.string()), "symbol": self._symbols(days, r["instrument_id"]),
            "session_date": pa.array(days.astype(np.int32)).cast(pa.date32()), "action": _letters(r["action"]), "side": _letters(r["side"]), "price": pa.array(r["price"]), "size": _signed(r["size"]),
            "order_id": _signed(r["order_id"]), "flags": pa.array(r["flags"].astype(np.int16)), "sequence": _signed(r["sequence"]), "publisher_id": pa.array(r["publisher_id"].astype(np.int32)),
            "instrument_id": _signed(r["instrument_id"]), "channel_id": pa.array(r["channel_id"].astype(np.int16)), "ts_in_delta": pa.array(r["ts_in_delta"]), "ord": pa.array(order),
        }
        return pa.RecordBatch.from_arrays([*columns.values()], [*columns])


class File(InputPartition):
    """A file and its number among those read."""

    def __init__(self, path: str, number: int):
        self.path, self.number = path, number


class DbnReader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths = sorted({p for part in options["path"].split(",") for p in globbing.glob(part, recursive=True)})

    def partitions(self) -> list[InputPartition]:
        if not self.paths:
            raise FileNotFoundError("no files there")
        return [File(p, k) for k, p in enumerate(self.paths)]

    def read(self, partition: File) -> Iterator[pa.RecordBatch]:
        with opened(partition.path) as f:
            batches = Batches(metadata(f), partition.number * FILE_RECORDS)
            for block in records(f):
                yield batches.batch(block)


class DbnSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "dbn"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DbnReader:
        return DbnReader(self.options)
