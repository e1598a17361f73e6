"""Market-shaped views over the events table, in DataFrame and in SQL form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table with ns, nanoseconds since the epoch whatever the session's zone is."""
    raw = spark.read.parquet(f"{sf_dir}/events.parquet")
    ts = F.col("ts").cast("timestamp")
    if dict(raw.dtypes)["ts"] == "timestamp_ntz":
        ts = F.to_utc_timestamp(ts, F.current_timezone())
    return raw.withColumn("ns", F.unix_micros(ts) * 1000)


CONTRACT = "CASE WHEN user_id % 5 = 0 THEN 'ESH24' WHEN user_id % 5 = 1 THEN 'ES_CAL_H24M24' ELSE 'ESM24' END"
DAY_NS = 86_400_000_000_000
MBO_COLUMNS = f"""
    event_id AS ord, ns AS ts_event, ns AS ts_recv,
    CASE event_type WHEN 'view' THEN 'ADD' WHEN 'click' THEN 'MODIFY' WHEN 'signup' THEN 'CANCEL' WHEN 'purchase' THEN 'TRADE' ELSE 'FILL' END AS action,
    CASE WHEN event_id % 37 = 0 THEN 'NONE' WHEN event_id % 2 = 0 THEN 'BID' ELSE 'ASK' END AS side,
    6000000000000 + (event_id % 20) * 250000000 AS price, 1 + event_id % 7 AS size, user_id AS order_id,
    CASE WHEN event_id % 4 = 0 THEN 0 ELSE 128 END AS flags, event_id - event_id % 2 AS sequence,
    {CONTRACT} AS contract, CASE WHEN user_id % 3 = 0 THEN 'ES' WHEN user_id % 3 = 1 THEN 'NIY' ELSE 'HSI' END AS product"""
MBP1_COLUMNS = f"""
    event_id AS ord, ns AS ts_event, ns AS ts_recv,
    CASE event_type WHEN 'purchase' THEN 'TRADE' WHEN 'error' THEN 'CLEAR' ELSE 'ADD' END AS action,
    CAST(6000 AS DOUBLE) + (event_id % 13) * CAST(0.25 AS DOUBLE) AS price, event_id - event_id % 2 AS sequence, {CONTRACT} AS contract,
    CAST(6000 AS DOUBLE) + CAST(0.25 AS DOUBLE) * (CAST((event_id - event_id % 25) / 25 AS BIGINT) % 8) AS bid_px_00,
    CAST(6000 AS DOUBLE) + CAST(0.25 AS DOUBLE) * (CAST((event_id - event_id % 25) / 25 AS BIGINT) % 8) + CAST(0.25 AS DOUBLE) * (1 + CAST((event_id - event_id % 10) / 10 AS BIGINT) % 3) AS ask_px_00,
    1 + event_id % 9 AS bid_sz_00, 1 + (event_id * 7) % 11 AS ask_sz_00, 1 + event_id % 3 AS bid_ct_00, 1 + event_id % 4 AS ask_ct_00"""

#: What queries' SQL begins with.
SQL = f"""WITH e AS (SELECT *, epoch_us(ts) * 1000 AS ns, CAST(ts AS DATE) AS session_date FROM events),
mbo AS (SELECT {MBO_COLUMNS}, session_date FROM e),
mbp1 AS (SELECT {MBP1_COLUMNS}, session_date FROM e)"""


def _view(spark: SparkSession, sf_dir: str, columns: str) -> DataFrame:
    rows = events(spark, sf_dir).selectExpr(*[c.strip() for c in _split(columns)], f"date_add(DATE'1970-01-01', CAST((ns - pmod(ns, {DAY_NS})) / {DAY_NS} AS INT)) AS session_date")
    longs = {c: F.col(c).cast("long") for c, t in rows.dtypes if t in ("int", "bigint", "decimal(23,0)") or t.startswith("decimal")}
    return rows.withColumns(longs)


def _split(columns: str) -> list[str]:
    """Comma-separated columns, but for commas inside brackets."""
    out, depth, now = [], 0, ""
    for ch in columns:
        depth += (ch == "(") - (ch == ")")
        if ch == "," and not depth:
            out.append(now)
            now = ""
        else:
            now += ch
    return [*out, now]


def mbo(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, MBO_COLUMNS)


def mbp1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, MBP1_COLUMNS)


def reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second set of quotes: the first with some sizes and prices moved."""
    return mbp1(spark, sf_dir).where("ord % 11 <> 0").withColumn("bid_sz_00", F.expr("bid_sz_00 + CASE WHEN ord % 7 = 0 THEN 1 ELSE 0 END")).withColumn("ask_px_00", F.expr("ask_px_00 + CASE WHEN ord % 17 = 0 THEN 0.25D ELSE 0D END"))


REFERENCE_SQL = """ref AS (SELECT * REPLACE (bid_sz_00 + CASE WHEN ord % 7 = 0 THEN 1 ELSE 0 END AS bid_sz_00, ask_px_00 + CASE WHEN ord % 17 = 0 THEN 0.25::DOUBLE ELSE 0::DOUBLE END AS ask_px_00)
  FROM mbp1 WHERE ord % 11 <> 0)"""
