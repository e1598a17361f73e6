"""Hand-written streams for the stateful operators, and results that don't depend on the number of partitions."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from orderloom.functions.schemas import F_LAST, F_SNAPSHOT, F_TOB, NO_PRICE, SCALE
from orderloom.operators import book, normalize, validate

DAY = dt.date(2025, 1, 2)
SCHEMA = "contract string, session_date date, ord long, ts_event long, ts_recv long, action string, side string, price long, size long, order_id long, flags int, sequence long"


def stream(spark, *rows, contract="ESH25"):
    """rows: (action, side, price in points, size, order id[, flags])"""
    out = []
    for k, (action, side, price, size, order, *flags) in enumerate(rows):
        fixed = NO_PRICE if price is None else int(price * SCALE)
        out.append((contract, DAY, k, 10**18 + k, 10**18 + k, action, side, fixed, size, order, flags[0] if flags else F_LAST, k))
    return spark.createDataFrame(out, SCHEMA)


def tops(df, **kw):
    return [(r.bid_px_00, r.bid_sz_00, r.bid_ct_00, r.ask_px_00, r.ask_sz_00, r.ask_ct_00) for r in book.reconstruct(df, **kw).orderBy("ord").collect()]


def test_adds_and_cancels(spark):
    got = tops(stream(spark, ("ADD", "BID", 10, 5, 1), ("ADD", "ASK", 11, 4, 2), ("ADD", "BID", 10, 3, 3), ("CANCEL", "BID", 10, 2, 1), ("CANCEL", "BID", 10, 3, 1), ("CANCEL", "ASK", 11, 4, 2)))
    assert got == [(10, 5, 1, None, None, None), (10, 5, 1, 11, 4, 1), (10, 8, 2, 11, 4, 1), (10, 6, 2, 11, 4, 1), (10, 3, 1, 11, 4, 1), (10, 3, 1, None, None, None)]


def test_modifies(spark):
    rows = [("ADD", "BID", 10, 5, 1), ("MODIFY", "BID", 10, 3, 1), ("MODIFY", "BID", 9, 7, 1), ("MODIFY", "ASK", 12, 2, 8), ("MODIFY", "BID", 9, 9, 1)]
    assert tops(stream(spark, *rows)) == [(10, 5, 1, None, None, None), (10, 3, 1, None, None, None), (9, 7, 1, None, None, None), (9, 7, 1, 12, 2, 1), (9, 9, 1, 12, 2, 1)]


def test_clear_snapshot_groups_and_top_of_book(spark):
    rows = [
        ("ADD", "BID", 10, 5, 1, F_LAST | F_SNAPSHOT),
        ("ADD", "ASK", 12, 1, 2, 0),
        ("TRADE", "BID", 10, 1, 0, F_LAST),
        ("TRADE", "BID", 10, 1, 0, F_LAST),
        ("NONE", "NONE", 10, 1, 0, F_LAST),
        ("ADD", "BID", 11, 7, 0, F_LAST | F_TOB),
        ("ADD", "BID", None, 0, 0, F_LAST | F_TOB),
        ("CLEAR", "NONE", 0, 0, 0, F_LAST),
    ]
    assert tops(stream(spark, *rows)) == [(10, 5, 1, 12, 1, 1), (10, 5, 1, 12, 1, 1), (11, 7, 0, 12, 1, 1), (None, None, None, 12, 1, 1), (None,) * 6]


def test_orphans_and_repair(spark):
    rows = [("CANCEL", "BID", 10, 1, 9), ("ADD", "BID", 10, 5, 1), ("CANCEL", "BID", 9, 5, 1), ("ADD", "BID", 8, 2, 1)]
    df = stream(spark, *rows)
    assert book.orphan_counts(df).collect()[0][2:] == (2, 0)
    assert tops(df)[-1][:3] == (10, 5, 1)
    assert tops(df, repair=True)[-1][:3] == (8, 2, 1)


def test_depth(spark):
    df = stream(spark, ("ADD", "BID", 10, 5, 1), ("ADD", "BID", 9, 4, 2), ("ADD", "ASK", 11, 1, 3))
    r = book.reconstruct(df, depth=2).orderBy("ord").collect()[-1]
    assert (r.bid_px_00, r.bid_px_01, r.bid_sz_01, r.ask_px_00, r.ask_px_01) == (10, 9, 4, 11, None)


@pytest.mark.parametrize("partitions", [1, 7])
def test_partitions_do_not_matter(spark, partitions):
    one = stream(spark, ("ADD", "BID", 10, 5, 1), ("CANCEL", "BID", 10, 5, 1), ("ADD", "ASK", 11, 5, 2))
    both = one.unionByName(one.withColumn("contract", F.lit("ESM25"))).repartition(partitions, "ord")
    got = book.reconstruct(both).groupBy("contract").count().orderBy("contract").collect()
    assert [tuple(r) for r in got] == [("ESH25", 3), ("ESM25", 3)]


def reasons(df):
    return [r.reject_reason for r in validate.validate(df).orderBy("ord").collect()]


def test_validation_reasons(spark):
    rows = [
        ("ADD", "BID", 10, 5, 1), ("ADD", "BID", 10, 5, 1), ("CANCEL", "ASK", 10, 5, 1), ("CANCEL", "BID", 10, 1, 1), ("ADD", "BID", 10, 5, 1), ("CLEAR", "NONE", 0, 0, 0), ("ADD", "BID", 10, 5, 1),
        ("ADD", "NONE", 10, 5, 2), ("ADD", "BID", 10, 5, 0), ("ADD", "BID", None, 5, 3), ("ADD", "BID", 0, 5, 3), ("ADD", "BID", -1, 5, 3), ("ADD", "BID", 1, 0, 3), ("BAD", "BID", 1, 1, 3), ("ADD", "UP", 1, 1, 3), ("CANCEL", "BID", 1, 1, 77), ("MODIFY", "BID", 1, 1, 78), ("MODIFY", "ASK", 1, 1, 78),
    ]
    none = None
    want = [none, "DUPLICATE_ADD", "SIDE_MISMATCH", none, none, none, none, "INVALID_SIDE_FOR_ACTION", "INVALID_ORDER_ID_ZERO", "MISSING_PRICE_FOR_ACTION", "INVALID_PRICE_ZERO", "INVALID_PRICE_NEGATIVE", "INVALID_SIZE_ZERO", "INVALID_ACTION", "INVALID_SIDE", none, none, "SIDE_MISMATCH"]
    assert reasons(stream(spark, *rows)) == want
    spread = stream(spark, ("ADD", "BID", -1, 5, 3), contract="ES_CAL_H25M25")
    assert reasons(spread) == [None]


def test_duplicates_and_modes(spark):
    twice = stream(spark, ("ADD", "BID", 10, 5, 1), ("ADD", "BID", 10, 5, 1)).withColumns({"ts_event": F.lit(5).cast("long"), "sequence": F.lit(1).cast("long")})
    checked = validate.validate(twice)
    assert [r.reject_reason for r in checked.orderBy("ord").collect()] == [None, "DUPLICATE_EVENT"]
    kept, rejected = validate.split(checked, "LOOSE")
    assert kept.count() == 2 and rejected.count() == 1 and kept.where("flags & 4 > 0").count() == 1
    assert validate.split(checked)[0].count() == 1
    with pytest.raises(ValueError):
        validate.split(checked, "SOFT")


RAW = "seq_num long, msg_index int, msg_type int, orderbook_id long, order_id long, side int, price int, quantity int"


def test_deletes(spark):
    rows = [
        (1, 0, 330, 7, 1, 0, 100, 10), (2, 0, 350, 7, 1, 2, 100, 4), (3, 0, 332, 7, 1, 0, 0, 0), (4, 0, 332, 7, 1, 0, 0, 0),
        (5, 0, 330, 7, 2, 1, 200, 3), (6, 0, 350, 7, 2, 3, 200, 3), (7, 0, 332, 7, 2, 1, 0, 0),
        (8, 0, 330, 8, 1, 0, 50, 9), (9, 0, 331, 8, 1, 0, 51, 6), (10, 0, 332, 8, 1, 0, 0, 0), (11, 0, 332, 8, 1, 1, 0, 0),
    ]
    got = normalize.resolve_deletes(spark.createDataFrame(rows, RAW)).where("msg_type = 332").orderBy("seq_num").collect()
    assert [(r.seq_num, r.price, r.quantity) for r in got] == [(3, 100, 6), (4, 0, 0), (7, 0, 0), (10, 51, 6), (11, 0, 0)]


def test_trades_become_three_events(spark):
    rows = spark.createDataFrame([(1, 0, 350, 7, 1, 2, 100, 4), (2, 0, 350, 7, 0, 2, 100, 4), (3, 0, 364, 7, 0, -1, 1, 1)], RAW)
    got = normalize.explode_trades(rows).orderBy("seq_num", "sub_ord").collect()
    assert [(r.action, r.side, r.flags) for r in got] == [("TRADE", "ASK", 132), ("FILL", "BID", 0), ("CANCEL", "BID", 132)]


def test_modify_from_neighbours(spark):
    df = stream(spark, ("CANCEL", "BID", 10, 5, 1), ("ADD", "BID", 11, 5, 1), ("CANCEL", "BID", 10, 5, 2), ("NONE", "NONE", 0, 0, 0), ("ADD", "BID", 11, 5, 2), ("CANCEL", "BID", 1, 1, 3), ("ADD", "BID", 2, 1, 3), ("FILL", "BID", 1, 1, 3))
    df = df.withColumn("sequence", F.when(F.col("ord") >= 5, 99).otherwise(F.col("sequence")).cast("long"))
    got = [(r.ord, r.action) for r in normalize.reconstitute_modifies(df).orderBy("ord").collect()]
    assert got == [(1, "MODIFY"), (2, "CANCEL"), (3, "NONE"), (4, "ADD"), (5, "CANCEL"), (6, "ADD"), (7, "FILL")]


def test_consolidated(spark):
    rows = [(1, 10.0, 5, 12.0, 1), (2, 11.0, 2, 12.0, 3), (1, 9.0, 1, 13.0, 1)]
    df = spark.createDataFrame([("X", DAY, k, k, *r) for k, r in enumerate(rows)], "contract string, session_date date, ord long, ts_recv long, publisher_id int, bid_px_00 double, bid_sz_00 long, ask_px_00 double, ask_sz_00 long")
    got = book.consolidated(df, [1, 2]).orderBy("ord").select("best_bid", "best_bid_sz", "best_ask", "best_ask_sz").collect()
    assert [tuple(r) for r in got] == [(10, 5, 12, 1), (11, 2, 12, 4), (11, 2, 12, 3)]
