"""Binary feed, store and stream."""

import datetime as dt
import struct
import zipfile

import pytest
from pyspark.sql import functions as F

from orderloom.functions import catalog, timing
from orderloom.operators import normalize, ofi, rolling, vpin
from orderloom.plans import views
from orderloom.sources import omd
from orderloom.sources.store import Store, schema_drift
from orderloom.streaming.bins import otr_stream

SENT = 1_770_000_000_000_000_000


def message(kind, body):
    return struct.pack("<HH", len(body) + 4, kind) + body


def record(sequence, *messages):
    body = b"".join(messages)
    return struct.pack(">H", 16 + len(body)) + b"\0\0" + struct.pack("<B", len(messages)) + b"\0" + struct.pack("<IQ", sequence, SENT + sequence) + body


def add(order, price, size, side, kind=330):
    return message(kind, struct.pack("<IQiIBBHI", 7, order, price, size, side, 0, 2, 1))


@pytest.fixture
def feed(tmp_path):
    definition = message(303, struct.pack("<I", 7) + b"HSIG6".ljust(32, b"\0") + b"\0" * 10)
    unknown = message(330, struct.pack("<IQiIBBHI", 9, 1, 1, 1, 0, 0, 2, 1))
    trade = message(350, struct.pack("<IQiQIBBHHxxQQ", 7, 1, 20000, 55, 0, 2, 1, 0, 0, 4, SENT))
    delete = message(332, struct.pack("<IQB", 7, 1, 0) + b"\0" * 3)
    short = message(330, b"\0" * 10)
    rows = [record(1, definition), record(2, add(1, 20000, 10, 0), unknown, short), b"\xff", record(3, trade), record(4, delete)]
    rows += [record(k, add(100 + k, 20000 + k, 1, k % 2)) for k in range(5, 400)]
    path = tmp_path / "channel.bin"
    path.write_bytes(b"".join(rows))
    return str(path)


def test_decode_and_translate(spark, feed):
    spark.dataSource.register(omd.OmdSource)
    read = lambda kind, n: spark.read.format("omd").option("kind", kind).option("stretchBytes", n).load(feed)
    known = omd.series(read("series", 1 << 20))
    assert [tuple(r) for r in known.collect()] == [(7, "HSIG6", "HSI")]
    whole = read("orders", 1 << 20)
    assert whole.count() == 398 and whole.where("orderbook_id = 9").count() == 1
    split = read("orders", 2000)
    assert split.rdd.getNumPartitions() > 5
    assert split.exceptAll(whole).isEmpty() and whole.exceptAll(split).isEmpty()
    with zipfile.ZipFile(feed + ".zip", "w") as archive:
        archive.write(feed, "channel.bin")
    assert spark.read.format("omd").option("kind", "orders").load(feed + ".zip").exceptAll(whole).isEmpty()
    assert omd.instruments(read("series", 1 << 20)).collect()[0]["class_code"] == "HSI"
    orders, trades = (omd.resolved(read(k, 1 << 20), known) for k in ("orders", "trades"))
    assert omd.with_printable(trades).first()["is_printable"]
    assert trades.select("quantity", "trade_id", "trade_time_ns").collect()[0] == (4, 55, SENT)
    events = normalize.hkex_translate(orders, trades, 2026).orderBy("seq_num", "msg_index", "sub_ord").collect()
    assert [(e.action, e.side, e.price, e.size) for e in events[:5]] == [
        ("ADD", "BID", 20000 * 10**9, 10), ("TRADE", "ASK", 20000 * 10**9, 4), ("FILL", "BID", 20000 * 10**9, 4), ("CANCEL", "BID", 20000 * 10**9, 4), ("CANCEL", "BID", 20000 * 10**9, 6),
    ]
    assert events[0].contract == "HSIG26"


def test_store(spark, tmp_path):
    m = views.mbo(spark, "/root/testdata/sf0.001").withColumns({"venue": F.lit("CME"), "product": F.lit("ES"), "publisher_id": F.lit(1), "instrument_id": F.lit(1).cast("long")})
    store = Store(spark, str(tmp_path))
    store.write(m.drop("session_date"), "mbo")
    assert store.read("mbo").count() == m.count()
    store.write(m.drop("session_date").where("contract = 'ESM24'"), "mbo")
    assert store.read("mbo").count() == m.count()
    first = store.dates("ES").first()[0]
    assert [r[0] for r in store.contracts("ES", first).collect()] == sorted(r[0] for r in m.where(F.col("session_date") == first).select("contract").distinct().collect())
    name = store.front_contract("ES", first)
    assert "_CAL_" not in name
    day = store.get_mbo(first, product="ES", columns=["ts_recv", "price"])
    assert day.columns == ["ts_recv", "price"] and day.count() == store.get_mbo(first, contract=name).count()
    plan = store.get_mbo(first, contract=name, columns=["price"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "PushedFilters" in plan
    assert store.get_mbo(first, first + dt.timedelta(days=3), contract=name, session="default").count() <= store.get_mbo(first, first + dt.timedelta(days=3), contract=name).count()
    assert store.product_stats("ES", first, first).count() <= 1 and store.overview().count() == 3
    assert schema_drift(spark, [store.path("mbo")]).where("column = 'price'").collect()[0]["type"] == "bigint"
    with pytest.raises(ValueError):
        store.load("mbo", first)


def test_stream_equals_batch(spark, tmp_path):
    m = views.mbo(spark, "/root/testdata/sf0.001").select("ts_event", "contract", "action", "ord")
    m.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(m.schema).parquet(str(tmp_path / "in"))
    q = otr_stream(stream, 60, "40 days").writeStream.outputMode("complete").format("memory").queryName("otr_bins").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("otr_bins").agg(F.sum("n_events")).first()[0] == m.count()


def test_catalog():
    assert catalog.product_of("FESXM25") == "FESX"
    assert catalog.rth_times(catalog.product("ES"), dt.date(2025, 7, 1)) == ("13:30:00", "20:00:00")
    assert catalog.rth_times(catalog.product("ES"), dt.date(2025, 1, 2)) == ("14:30:00", "21:00:00")
    assert catalog.rth_times(catalog.product("FDAX"), dt.date(2025, 1, 2)) == ("07:00:00", "21:00:00")
    assert catalog.rth_times(catalog.product("NIY"), dt.date(2025, 1, 2), "us") == ("13:30:00", "20:00:00")
    assert catalog.rth_bounds("HSI", "20250102")["lunch_start"] == timing.day_ns("2025-01-02") + 4 * 3600 * timing.SECOND
    for bad in (lambda: catalog.product("XX"), lambda: catalog.product_of("ZZ"), lambda: catalog.rth_times(catalog.product("ES"), dt.date(2025, 1, 2), "asia")):
        with pytest.raises(ValueError):
            bad()


def test_arguments(spark):
    q = views.mbp1(spark, "/root/testdata/sf0.001")
    for bad in (
        lambda: ofi.buckets(q, 0), lambda: ofi.buckets(q, 1, "up"), lambda: ofi.forward_returns(q, []), lambda: ofi.forward_returns(q, [1], 5), lambda: vpin.bars(q, 0), lambda: vpin.vpin(q, 0),
        lambda: ofi.events(q.drop("bid_px_00")), lambda: rolling.merge_products({}), lambda: rolling.rolling(q, metrics=("no",)), lambda: timing.time_bin(F.col("ts_event"), 7),
    ):
        with pytest.raises(ValueError):
            bad()
