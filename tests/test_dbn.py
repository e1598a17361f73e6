"""Vendor files: plain and compressed, every version, records of other kinds, mappings by day, and the way into the store."""

import datetime as dt
import io
import struct

import pytest
import zstandard
from pyspark.sql import functions as F

from orderloom import __main__ as cli
from orderloom.operators import normalize
from orderloom.sources import dbn
from orderloom.sources.store import Store

NS = 10**9
DAY = int(dt.datetime(2025, 1, 2, 15, tzinfo=dt.UTC).timestamp()) * NS


def cstr(text, width):
    return text.encode().ljust(width, b"\0")


def header(version=2, mappings=(), stype_in=1, stype_out=0):
    width = 22 if version == 1 else 71
    fixed = struct.pack("<16sHQQQ", b"GLBX.MDP3", 0, DAY, DAY + 1, 0)
    fixed += struct.pack("<QBBB47x", 0, stype_in, stype_out, 0) if version == 1 else struct.pack("<BBBH53x", stype_in, stype_out, 0, width)
    body = fixed + struct.pack("<II", 0, 1) + cstr("ES.FUT", width) + struct.pack("<III", 0, 0, len(mappings))
    for symbol, intervals in mappings:
        body += cstr(symbol, width) + struct.pack("<I", len(intervals))
        for first, end, other in intervals:
            body += struct.pack("<II", first, end) + cstr(other, width)
    return b"DBN" + struct.pack("<BI", version, len(body)) + body


def event(instrument, order, price, size, action, side, at=DAY, flags=128, sequence=1, extra=b""):
    return struct.pack("<BBHIQQqIBBccQiI", 14 + len(extra) // 4, 0xA0, 1, instrument, at, order, price, size, flags, 3, action, side, at, 100, sequence) + extra


#: A record of another kind, 80 bytes long.
OTHER = struct.pack("<BBHIQ", 20, 0x17, 1, 0, DAY) + b"\0" * 64
MAPS = [("ESH5", [(20250101, 20250103, "7"), (20250103, 20250201, "8")]), ("ESM5", [(20250103, 20250201, "7")]), ("EMPTY", [(20250101, 20250201, "")])]


def stream(n=300, version=2):
    rows = [event(7, 1, 5990 * NS, 10, b"A", b"B"), OTHER, event(7, 1, 5990 * NS, 4, b"T", b"A", flags=8), event(7, 2**64 - 1, 2**63 - 1, 1, b"R", b"N"), event(99, 5, NS, 1, b"A", b"A")]
    rows += [OTHER] * 3 + [event(7, 100 + k, (5991 + k) * NS, 1, b"A", b"A", DAY + k, sequence=k) for k in range(n)]
    rows += [event(7, 9, NS, 1, b"A", b"A", DAY + 86400 * NS), event(8, 9, NS, 1, b"A", b"A", DAY + 86400 * NS), event(7, 9, NS, 1, b"A", b"A", 2**64 - 1)]
    return header(version, MAPS) + b"".join(rows)


@pytest.mark.parametrize("version", [1, 2, 3])
@pytest.mark.parametrize("block", [56, 100, 1 << 20])
def test_blocks(version, block):
    f = io.BytesIO(stream(version=version) + event(7, 3, NS, 1, b"A", b"B")[:30])
    meta = dbn.metadata(f)
    assert meta.dataset == "GLBX.MDP3" and meta.symbols(dt.date(2025, 1, 2)) == {7: "ESH5"} and meta.symbols(dt.date(2025, 1, 3)) == {8: "ESH5", 7: "ESM5"}
    ids = [int(x) for b in dbn.records(f, block) for x in b["order_id"]]
    assert ids == [1, 1, 2**64 - 1, 5, *range(100, 400), 9, 9, 9]


def test_longer_records_and_mappings_by_id():
    f = io.BytesIO(header(2, [("7", [(20250101, 20250103, "ESH5")])], 0, 1) + event(7, 1, NS, 2, b"A", b"B", extra=b"\1" * 8) + event(7, 2, NS, 3, b"C", b"B", extra=b"\2" * 8))
    assert dbn.metadata(f).symbols(dt.date(2025, 1, 2)) == {7: "ESH5"}
    assert [(int(r["order_id"]), int(r["size"])) for b in dbn.records(f) for r in b] == [(1, 2), (2, 3)]


def test_bad_files():
    for bad in (b"", b"PAR1" * 10, b"DBN\x09" + struct.pack("<I", 200) + b"\0" * 200, header()[:50]):
        with pytest.raises(ValueError):
            dbn.metadata(io.BytesIO(bad))
    with pytest.raises(ValueError):
        list(dbn.records(io.BytesIO(b"\0" * 56)))


def test_source(spark, tmp_path):
    (tmp_path / "a-20250102.mbo.dbn").write_bytes(stream())
    packed = stream(5)
    (tmp_path / "b-20250102.mbo.dbn.zst").write_bytes(zstandard.compress(packed[:400]) + zstandard.compress(packed[400:]))
    (tmp_path / "c-20250102.mbo.dbn").write_bytes(header())
    spark.dataSource.register(dbn.DbnSource)
    raw = spark.read.format("dbn").load(str(tmp_path / "*.dbn*"))
    assert raw.count() == 307 + 12 and raw.rdd.getNumPartitions() == 3 and raw.select("ord").distinct().count() == 319
    first = raw.orderBy("ord").first()
    assert (first.symbol, first.session_date, first.action, first.side, first.price, first.size, first.flags, first.dataset) == ("ESH5", dt.date(2025, 1, 2), "A", "B", 5990 * NS, 10, 128, "GLBX.MDP3")
    assert raw.where("symbol is null").count() == 2 * 2 and raw.where("ts_recv = 0 and ts_event = 0").count() == 2
    assert raw.where("order_id = -1 and price = 9223372036854775807").count() == 2
    events = normalize.vendor_translate(raw)
    assert events.count() == 315 and {r[0] for r in events.select("venue").distinct().collect()} == {"CME"}
    assert {tuple(r) for r in events.select("contract", "session_date").distinct().collect()} == {("ESH25", dt.date(2025, 1, 2)), ("ESM25", dt.date(2025, 1, 3)), ("ESH25", dt.date(2025, 1, 3))}
    assert events.where("action = 'TRADE'").first()["flags"] == 4
    with pytest.raises(Exception, match="no files"):
        spark.read.format("dbn").load(str(tmp_path / "none*")).count()


def test_ingest(spark, tmp_path):
    for name in ("x-20250102.mbo.dbn.zst", "x-20250105.mbo.dbn"):
        (tmp_path / name).write_bytes(zstandard.compress(stream()) if name.endswith("zst") else b"broken")
    store = Store(spark, str(tmp_path / "store"))
    cli.ingest_day(spark, store, str(tmp_path / "x-20250102.mbo.dbn.zst"), "2025-01-02")
    rows = store.read("mbo")
    assert {r[0] for r in rows.select("contract").distinct().collect()} == {"ESH25", "ESM25"}
    assert rows.where("contract = 'ESH25' and action = 'ADD'").count() >= 301
    with pytest.raises(Exception, match="not a file"):
        cli.ingest_day(spark, store, str(tmp_path / "x-20250105.mbo.dbn"), "2025-01-05")
    assert rows.where(F.col("ts_recv") == 0).count() == 0
