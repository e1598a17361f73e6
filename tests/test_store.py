"""Days written in turn, tables replaced and registered, work lists, and the command line from feed to statistics."""

import datetime as dt
import struct

import duckdb
import pytest
from pyspark.sql import functions as F

from orderloom import __main__ as cli
from orderloom.plans import views
from orderloom.sources.store import Store, read_files, span_of, write_csv
from test_sources import SENT, message, record

SF = "/root/testdata/sf0.001"


def market(spark):
    own = {"venue": F.lit("CME"), "product": F.lit("ES"), "publisher_id": F.lit(1), "instrument_id": F.lit(1).cast("long")}
    return views.mbo(spark, SF).withColumns(own)


def test_days_written_in_turn_are_all_there(spark, tmp_path):
    m, store = market(spark).where("session_date < '2024-01-06'"), Store(spark, str(tmp_path))
    days = sorted(r[0] for r in m.select("session_date").distinct().collect())
    for n, day in enumerate(days, 1):
        store.write(m.where(F.col("session_date") == F.lit(day)).drop("session_date"), "mbo")
        assert [r[0] for r in store.dates("ES").collect()] == days[:n]
    assert store.read("mbo").count() == m.count() and len(days) == 5
    again = m.where(F.col("session_date") == F.lit(days[1])).where("contract = 'ESM24'").limit(3)
    store.write(again.drop("session_date"), "mbo")
    assert store.read("mbo").count() == m.count() - m.where(F.col("session_date") == F.lit(days[1])).where("contract = 'ESM24'").count() + 3
    before = store.read("mbo").count()
    store.write(again.drop("session_date"), "mbo", provider="other")
    assert store.read("mbo").count() == before + 3 and store.days().where("provider = 'other'").count() == 1


def test_query_over_a_written_store_equals_sql(spark, tmp_path):
    m, store = market(spark), Store(spark, str(tmp_path))
    store.write(m.drop("session_date"), "mbo")
    assert store.register("t_") == ["t_mbo"]
    got = spark.sql("SELECT contract, session_date, count(*) AS n, sum(size) AS size FROM t_mbo WHERE action = 'TRADE' GROUP BY contract, session_date").collect()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{SF}/events.parquet'")
    want = con.execute(f"{views.SQL} SELECT contract, session_date, count(*), sum(size)::BIGINT FROM mbo WHERE action = 'TRADE' GROUP BY ALL").fetchall()
    assert sorted(map(tuple, got)) == sorted(want)


def test_replace_keeps_the_old_table(spark, tmp_path):
    m, store = market(spark).where("session_date < '2024-01-04'"), Store(spark, str(tmp_path))
    store.write(m.drop("session_date"), "mbo")
    old = store.replace(store.read("mbo").where("action <> 'FILL'"), "mbo", "v1")
    assert store.read("mbo").count() == m.where("action <> 'FILL'").count()
    assert spark.read.parquet(old).count() == m.count() and old.endswith("mbo_old_v1")


def test_work_lists(spark, tmp_path):
    m, store = market(spark), Store(spark, str(tmp_path))
    store.write(m.drop("session_date"), "mbo")
    every = {(r.contract, r.session_date) for r in m.select("contract", "session_date").distinct().collect()}
    as_set = lambda df: {(r.contract, r.session_date) for r in df.collect()}
    assert as_set(store.work_list()) == as_set(store.work_list("2024")) == as_set(store.work_list("2024-01", products=["ES"])) == every
    assert as_set(store.work_list("2024-01-02", "20240103", contracts=["ESM24"])) == {x for x in every if x[0] == "ESM24" and dt.date(2024, 1, 2) <= x[1] <= dt.date(2024, 1, 3)}
    assert store.work_list("2023").count() == 0 and as_set(store.missing(store.work_list())) == every
    assert span_of("2024-02", "2024-02") == (dt.date(2024, 2, 1), dt.date(2024, 2, 29))
    info = store.info("ES")
    assert info["n_contracts"] == 3 and info["n_rows"] == m.count() and info["tick_size_pts"] == 0.25


def test_foreign_files_keep_the_date_of_their_name(spark, tmp_path):
    m = market(spark).where("session_date = '2024-01-02'").orderBy("ord").coalesce(1)
    m.drop("session_date", "ord").toPandas().to_parquet(tmp_path / "ESM24_20240102.parquet")
    got = read_files(spark, str(tmp_path), "mbo")
    assert {r.file_date for r in got.select("file_date").distinct().collect()} == {"20240102"}
    assert [r.ord for r in got.orderBy("ord").collect()] == list(range(m.count()))


def test_csv(spark, tmp_path):
    write_csv(spark.createDataFrame([(1, "a"), (2, None)], "n long, s string"), str(tmp_path / "out"))
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).count() == 2


def day_feed(path, day, order):
    """A channel of one day: a definition, two adds, a trade of the first and its delete."""
    sent = SENT + day * 86_400_000_000_000
    definition = message(303, struct.pack("<I", 7) + b"HSIG6".ljust(32, b"\0") + b"\0" * 10)
    add = lambda o, price, side: message(330, struct.pack("<IQiIBBHI", 7, o, price, 10, side, 0, 2, 1))
    trade = message(350, struct.pack("<IQiQIBBHHxxQQ", 7, order, 20000, 55, 0, 2, 1, 0, 0, 4, sent))
    rows = [record(1, definition), record(2, add(order, 20000, 0)), record(3, add(order + 1, 20010, 1)), record(4, trade), record(5, message(332, struct.pack("<IQB", 7, order, 0) + b"\0" * 3))]
    body = b"".join(rows)
    for k in range(1, 6):
        body = body.replace(struct.pack("<IQ", k, SENT + k), struct.pack("<IQ", k, sent + k))
    path.write_bytes(body)
    return (dt.datetime(1970, 1, 1) + dt.timedelta(microseconds=sent // 1000)).date()


@pytest.fixture
def run(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(cli.session, "build", lambda *a, **k: spark)
    monkeypatch.setattr(type(spark), "stop", lambda self: None)

    def call(*args):
        cli.main([*args, "--store", str(tmp_path / "store")])

    return call


def test_command_line(spark, tmp_path, run, capsys):
    days = [day_feed(tmp_path / f"day{k}.bin", k, 100 + k) for k in range(2)]
    store = Store(spark, str(tmp_path / "store"))
    for k, day in enumerate(days):
        run("ingest", str(tmp_path / f"day{k}.bin"), str(day))
    assert [r[0] for r in store.dates("HSI").collect()] == days
    run("reconstruct", "HSI", str(days[0]), str(days[0]))
    assert [r[0] for r in store.dates("HSI", kind="mbp1").collect()] == days[:1]
    first = store.read("mbp1").count()
    run("reconstruct", "HSI", str(days[0]), str(days[1]))
    assert [r[0] for r in store.dates("HSI", kind="mbp1").collect()] == days and store.read("mbp1").where(F.col("session_date") == F.lit(days[0])).count() == first > 0
    run("reconstruct", "HSI", str(days[0]), str(days[1]), "--overwrite")
    assert store.read("mbp1").count() == 2 * first
    run("stats", "HSI", str(days[0]), str(days[1]))
    assert capsys.readouterr().out.count("HSIG26") == 2
    run("overview")
    assert "HSIG26" in capsys.readouterr().out


def test_batch_goes_on_after_a_bad_day(spark, tmp_path, run, capsys):
    days = []
    for k in (0, 1):
        folder = tmp_path / "in" / f"d{k}"
        folder.mkdir(parents=True)
        day = day_feed(folder / "c.bin", k, 100)
        folder.rename(tmp_path / "in" / str(day).replace("-", ""))
        days.append(day)
    (tmp_path / "in" / "20260101").mkdir()
    (tmp_path / "in" / "20260101" / "c.bin").write_bytes(b"")
    with pytest.raises(SystemExit):
        run("batch", str(tmp_path / "in"))
    assert [r[0] for r in Store(spark, str(tmp_path / "store")).dates("HSI").collect()] == sorted(days)
    out = capsys.readouterr().out
    assert out.count("ok") == 2 and out.count("failed") == 1
    (tmp_path / "in" / "20260101" / "c.bin").unlink()
    (tmp_path / "in" / "20260101").rmdir()
    run("batch", str(tmp_path / "in"))
    assert capsys.readouterr().out.count("there") == 2
