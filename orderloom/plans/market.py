"""Queries of sources, filters, front contracts, statistics and profiles, each with its SQL."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import catalog, timing
from ..operators import filters, front, profiles, quality, stats
from . import views
from .views import SQL, mbo, mbp1

DAY = "2024-01-10"
TICK_FP = 250_000_000
BIN = "strftime(make_timestamp((ts_event - ts_event % 1800000000000) // 1000), '%H:%M:%S') AS time_bin"
NS = "(epoch_us(TIMESTAMP '{}') * 1000)"
RTH = f"ts_recv >= {NS.format(DAY + ' 14:30:00')} AND ts_recv < {NS.format(DAY + ' 21:00:00')}"
COUNTS = ", ".join(f"count(*) FILTER (action = '{a}') AS n_{a.lower()}" for a in stats.COUNTED)
POSTED = "count(*) FILTER (action IN ('ADD', 'MODIFY'))"
RATIOS = f"""round((count(*) FILTER (action = 'CANCEL') - count(*) FILTER (action = 'FILL'))::DOUBLE / nullif({POSTED}, 0), 4) AS cancel_rate,
  round((count(*) FILTER (action = 'FILL'))::DOUBLE / nullif({POSTED}, 0), 4) AS fill_rate,
  round(({POSTED})::DOUBLE / nullif(count(*) FILTER (action = 'FILL'), 0), 2) AS order_to_trade_ratio"""
PRICES = """min(price) FILTER (action = 'TRADE') AS price_min, max(price) FILTER (action = 'TRADE') AS price_max,
  min(price) FILTER (action = 'TRADE') / 1e9::DOUBLE AS price_min_pts, max(price) FILTER (action = 'TRADE') / 1e9::DOUBLE AS price_max_pts,
  CAST(trunc((max(price) FILTER (action = 'TRADE') - min(price) FILTER (action = 'TRADE'))::DOUBLE / 250000000) AS BIGINT) AS price_range_ticks, 0.25::DOUBLE AS tick_size_pts"""
STATS = f"count(*) AS n_rows, {COUNTS}, {RATIOS}, {PRICES}"
FRONT = """fc AS (SELECT session_date, contract, count(*) FILTER (action = 'TRADE') AS n_trade FROM mbo WHERE contract NOT LIKE '%\\_CAL\\_%' ESCAPE '\\' GROUP BY ALL),
front AS (SELECT session_date, contract, n_trade FROM fc QUALIFY row_number() OVER (PARTITION BY session_date ORDER BY n_trade DESC, contract) = 1)"""
CHANGED = """ch AS (SELECT *, lag(bid_px_00) OVER w AS b0, lag(ask_px_00) OVER w AS a0, lag(bid_sz_00) OVER w AS bs0, lag(ask_sz_00) OVER w AS as0 FROM mbp1 WHERE {where}
  WINDOW w AS (PARTITION BY contract, session_date ORDER BY ts_event, ord)),
mv AS (SELECT * FROM ch WHERE bid_px_00 <> b0 OR ask_px_00 <> a0 OR bid_sz_00 <> bs0 OR ask_sz_00 <> as0 OR b0 IS NULL)"""
SPREAD = f"""{CHANGED.format(where='ask_px_00 > bid_px_00')},
sp AS (SELECT contract, session_date, {BIN}, avg((ask_px_00 - bid_px_00) / 0.25) AS spread_mean, round(stddev_samp((ask_px_00 - bid_px_00) / 0.25), 6) AS spread_std,
  min((ask_px_00 - bid_px_00) / 0.25) AS spread_min, max((ask_px_00 - bid_px_00) / 0.25) AS spread_max, count(*) AS n_obs FROM mv GROUP BY ALL)"""
DEPTH = f"""{CHANGED.format(where='bid_sz_00 > 0 AND ask_sz_00 > 0')},
dp AS (SELECT contract, session_date, {BIN}, avg(bid_sz_00) AS bid_depth_mean, round(stddev_samp(bid_sz_00), 6) AS bid_depth_std, avg(ask_sz_00) AS ask_depth_mean,
  round(stddev_samp(ask_sz_00), 6) AS ask_depth_std, avg(bid_sz_00 + ask_sz_00) AS total_depth_mean, count(*) AS n_obs FROM mv GROUP BY ALL)"""
VOLUME = f"vo AS (SELECT contract, session_date, {BIN}, count(*) FILTER (action = 'TRADE') AS n_trades, count(*) AS n_events FROM mbo GROUP BY ALL)"
OTR = f"""ot AS (SELECT contract, session_date, {BIN}, count(*) FILTER (action = 'ADD') AS n_add, count(*) FILTER (action = 'MODIFY') AS n_modify, count(*) FILTER (action = 'FILL') AS n_fill,
  count(*) AS n_events, ({POSTED})::DOUBLE / nullif(count(*) FILTER (action = 'FILL'), 0) AS otr FROM mbo GROUP BY ALL)"""


def rounded(df, *columns, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in columns})


def _across(name, metrics):
    parts = ", ".join(f"round(avg({m}), 6) AS {m}_mean, round(stddev_samp({m}), 6) AS {m}_std, count({m}) AS {m}_days" for m in metrics)
    return f"SELECT time_bin, {parts} FROM {name} GROUP BY time_bin"


def _across_df(df, metrics):
    return rounded(profiles.across_days(df, metrics), *(f"{m}_{k}" for m in metrics for k in ("mean", "std")))


def _spread(s, d):
    return rounded(profiles.spread(mbp1(s, d), 0.25), "spread_std")


def _depth(s, d):
    return rounded(profiles.depth(mbp1(s, d)), "bid_depth_std", "ask_depth_std")


def _in_rth(s, d):
    """All events in the session of their day: bounds of every day from the first to the last that there is."""
    m = mbo(s, d)
    first, last = m.agg(F.min("session_date"), F.max("session_date")).first()
    days = [] if first is None else [first + dt.timedelta(days=k) for k in range((last - first).days + 1)]
    return filters.in_rth(m, catalog.bounds_table(s, "ES", days)).select("ord", "ts_event", "contract", "action")


#: New York's summer time, from the first to before the last day.
SUMMER = "(session_date >= DATE '2024-03-10' AND session_date < DATE '2024-11-03') OR (session_date >= DATE '2025-03-09' AND session_date < DATE '2025-11-02')"


def _symbols(s, d):
    e = views.events(s, d)
    made = F.expr(
        "CASE event_id % 6 WHEN 0 THEN concat('ES', substr('FGHJKMNQUVXZ', CAST(1 + event_id % 12 AS INT), 1), CAST(event_id % 10 AS STRING)) WHEN 1 THEN 'ESM6-ESU6' "
        "WHEN 2 THEN concat('FDAX SI 2025', lpad(CAST(1 + event_id % 14 AS STRING), 2, '0'), '20 CS') WHEN 3 THEN 'FESX.S.JUN25.SEP25.SPD' WHEN 4 THEN concat('HSI', substr('GHJ', CAST(1 + event_id % 3 AS INT), 1), '6') ELSE 'SPX C5000' END"
    )
    return e.select("event_id", made.alias("symbol"))


SYMBOLS = """sy AS (SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'ES' || substr('FGHJKMNQUVXZ', CAST(1 + event_id % 12 AS INT), 1) || (event_id % 10)::VARCHAR WHEN 1 THEN 'ESM6-ESU6'
  WHEN 2 THEN 'FDAX SI 2025' || lpad((1 + event_id % 14)::VARCHAR, 2, '0') || '20 CS' WHEN 3 THEN 'FESX.S.JUN25.SEP25.SPD' WHEN 4 THEN 'HSI' || substr('GHJ', CAST(1 + event_id % 3 AS INT), 1) || '6' ELSE 'SPX C5000' END AS symbol FROM events)"""


def _yy(digit):
    c = f"(2020 + {digit}::INT)"
    return f"lpad(((CASE WHEN {c} < 2023 THEN {c} + 10 ELSE {c} END) % 100)::VARCHAR, 2, '0')"


def _x(p, k):
    return f"regexp_extract(symbol, '{p}', {k})"


_O, _S, _E = "^([A-Z]+)([FGHJKMNQUVXZ])(\\d)$", "^([A-Z]+)([FGHJKMNQUVXZ])(\\d)-[A-Z]+([FGHJKMNQUVXZ])(\\d)$", "^([A-Z]+)\\s+SI\\s+(\\d{4})(0[1-9]|1[0-2])\\d{2}\\s+CS$"
PARSED = f"""SELECT event_id, CASE WHEN regexp_matches(symbol, '{_O}') THEN {_x(_O, 1)} WHEN regexp_matches(symbol, '{_S}') THEN {_x(_S, 1)} WHEN regexp_matches(symbol, '{_E}') THEN {_x(_E, 1)}
  WHEN symbol = 'FESX.S.JUN25.SEP25.SPD' THEN 'FESX' END AS product,
  CASE WHEN regexp_matches(symbol, '{_O}') THEN {_x(_O, 1)} || {_x(_O, 2)} || {_yy(_x(_O, 3))}
  WHEN regexp_matches(symbol, '{_S}') THEN {_x(_S, 1)} || '_CAL_' || {_x(_S, 2)} || {_yy(_x(_S, 3))} || {_x(_S, 4)} || {_yy(_x(_S, 5))}
  WHEN regexp_matches(symbol, '{_E}') THEN {_x(_E, 1)} || substr('FGHJKMNQUVXZ', {_x(_E, 3)}::INT, 1) || substr({_x(_E, 2)}, 3, 2)
  WHEN symbol = 'FESX.S.JUN25.SEP25.SPD' THEN 'FESX_CAL_M25U25' END AS contract,
  CASE WHEN regexp_matches(symbol, '{_O}') OR regexp_matches(symbol, '{_E}') THEN FALSE WHEN regexp_matches(symbol, '{_S}') OR symbol LIKE '%.SPD' THEN TRUE END AS is_spread FROM sy"""

EVENT = "ord, ts_event, contract, action"
DIM = "(VALUES " + ", ".join(f"('{p.name}', {p.tick}::DOUBLE, {p.point_value}::DOUBLE, '{p.currency}', '{p.exchange}')" for p in catalog.PRODUCTS.values()) + ") AS dim(product, tick_size_pts, point_value, currency, exchange)"


def _daily(s, d):
    return rounded(stats.product_stats(mbo(s, d), TICK_FP))


QUERIES = {
    "volume_profile": (lambda s, d: profiles.volume(mbo(s, d)), f"{SQL}, {VOLUME} SELECT * FROM vo"),
    "otr_profile": (lambda s, d: profiles.otr(mbo(s, d)), f"{SQL}, {OTR} SELECT * FROM ot"),
    "spread_profile": (_spread, f"{SQL}, {SPREAD} SELECT * FROM sp"),
    "depth_profile": (_depth, f"{SQL}, {DEPTH} SELECT * FROM dp"),
    "volume_xday": (lambda s, d: _across_df(profiles.volume(mbo(s, d)), ["n_trades", "n_events"]), f"{SQL}, {VOLUME} {_across('vo', ['n_trades', 'n_events'])}"),
    "otr_xday": (lambda s, d: _across_df(profiles.otr(mbo(s, d)), ["otr"]), f"{SQL}, {OTR} {_across('ot', ['otr'])}"),
    "spread_xday": (lambda s, d: _across_df(_spread(s, d), ["spread_mean"]), f"{SQL}, {SPREAD} {_across('sp', ['spread_mean'])}"),
    "depth_xday": (lambda s, d: _across_df(_depth(s, d), ["total_depth_mean"]), f"{SQL}, {DEPTH} {_across('dp', ['total_depth_mean'])}"),
    "hourly_counts_24": (
        lambda s, d: profiles.hourly_counts(mbo(s, d)),
        f"{SQL} SELECT c.contract, h.hour::INTEGER AS hour, count(m.ord) AS n_events FROM (SELECT DISTINCT contract FROM mbo) c CROSS JOIN range(24) h(hour) LEFT JOIN mbo m ON m.contract = c.contract AND (m.ts_event % 86400000000000) // 3600000000000 = h.hour GROUP BY ALL",
    ),
    "contract_stats": (lambda s, d: stats.contract_stats(mbo(s, d), ("contract", "session_date"), TICK_FP), f"{SQL} SELECT contract, session_date, {STATS} FROM mbo GROUP BY ALL"),
    "product_stats_daily": (_daily, f"{SQL}, {FRONT} SELECT session_date, contract, {STATS} FROM mbo SEMI JOIN front USING (session_date, contract) GROUP BY ALL HAVING count(*) FILTER (action = 'TRADE') > 0"),
    "cross_market_summary": (
        lambda s, d: stats.cross_market(mbo(s, d), catalog.dim_product(s)),
        f"{SQL} SELECT product, contract, session_date, exchange, currency, count(*) AS n_rows, {', '.join(f'''count(*) FILTER (action = '{a}') AS n_{a.lower()}''' for a in ('ADD', 'CANCEL', 'MODIFY', 'TRADE'))}, {RATIOS}, min(price) FILTER (action = 'TRADE') / 1e9::DOUBLE AS price_min_pts, max(price) FILTER (action = 'TRADE') / 1e9::DOUBLE AS price_max_pts, tick_size_pts, point_value FROM mbo JOIN {DIM} USING (product) GROUP BY ALL",
    ),
    "period_totals": (
        lambda s, d: rounded(stats.contract_stats(mbo(s, d), ("product", "session_date"), TICK_FP).groupBy("product").agg(F.sum("n_rows").alias("n_rows"), F.sum("n_trade").alias("n_trade"), F.avg("n_rows").alias("rows_mean"), F.count(F.lit(1)).alias("n_days")), "rows_mean"),
        f"{SQL}, k AS (SELECT product, session_date, count(*) AS n, count(*) FILTER (action = 'TRADE') AS t FROM mbo GROUP BY ALL) SELECT product, sum(n)::BIGINT AS n_rows, sum(t)::BIGINT AS n_trade, round(avg(n), 6) AS rows_mean, count(*) AS n_days FROM k GROUP BY product",
    ),
    "otr_ranking": (
        lambda s, d: stats.contract_stats(mbo(s, d), ("product",), TICK_FP).select("product", F.rank().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("order_to_trade_ratio"))).cast("long").alias("place"), "order_to_trade_ratio"),
        f"{SQL}, k AS (SELECT product, {RATIOS} FROM mbo GROUP BY product) SELECT product, rank() OVER (ORDER BY order_to_trade_ratio DESC) AS place, order_to_trade_ratio FROM k",
    ),
    "available_dates": (lambda s, d: mbo(s, d).select("session_date").distinct(), f"{SQL} SELECT DISTINCT session_date FROM mbo"),
    "contracts_of_day": (lambda s, d: mbo(s, d).where(F.col("session_date") == F.lit(DAY).cast("date")).select("contract").distinct(), f"{SQL} SELECT DISTINCT contract FROM mbo WHERE session_date = DATE '{DAY}'"),
    "front_month_volume": (lambda s, d: front.by_volume(mbo(s, d)), f"{SQL}, {FRONT} SELECT * FROM front"),
    "front_month_expiry": (
        lambda s, d: front.by_expiry(mbo(s, d)),
        f"{SQL}, k AS (SELECT DISTINCT session_date, contract, (2000 + regexp_extract(contract, '^[A-Z]+([FGHJKMNQUVXZ])(\\d{{2}})$', 2)::INT) * 12 + strpos('FGHJKMNQUVXZ', regexp_extract(contract, '^[A-Z]+([FGHJKMNQUVXZ])(\\d{{2}})$', 1)) AS x FROM mbo WHERE contract NOT LIKE '%CAL%') SELECT session_date, arg_min(contract, (x, contract)) AS contract FROM k WHERE x >= year(session_date) * 12 + month(session_date) GROUP BY session_date",
    ),
    "month_codes": (lambda s, d: catalog.month_codes(s), "SELECT code, month::INTEGER AS month, name FROM (VALUES " + ", ".join(f"('{c}', {k + 1}, '{catalog.MONTH_NAMES[k]}')" for k, c in enumerate(catalog.MONTH_CODES)) + ") AS t(code, month, name)"),
    "rth_filter": (lambda s, d: filters.filter_rth(mbo(s, d), "ES", DAY).select("ord", "ts_event", "contract", "action"), f"{SQL} SELECT {EVENT} FROM mbo WHERE {RTH}"),
    "rth_lunch_filter": (
        lambda s, d: filters.filter_rth(mbo(s, d), "HSI", DAY).select("ord", "ts_event", "contract", "action"),
        f"{SQL} SELECT {EVENT} FROM mbo WHERE ts_recv >= {NS.format(DAY + ' 01:15:00')} AND ts_recv < {NS.format(DAY + ' 08:30:00')} AND NOT (ts_recv >= {NS.format(DAY + ' 04:00:00')} AND ts_recv < {NS.format(DAY + ' 05:00:00')})",
    ),
    "rth_range": (
        _in_rth,
        f"{SQL} SELECT {EVENT} FROM mbo WHERE ts_recv % 86400000000000 >= CASE WHEN {SUMMER} THEN 48600000000000 ELSE 52200000000000 END AND ts_recv % 86400000000000 < CASE WHEN {SUMMER} THEN 72000000000000 ELSE 75600000000000 END",
    ),
    "full_session_filter": (
        lambda s, d: mbo(s, d).where(catalog.full_session("FDAX", F.col("ts_recv"))).select("ord", "ts_event", "contract", "action"),
        f"{SQL} SELECT {EVENT} FROM mbo WHERE isodow(session_date) BETWEEN 1 AND 5 AND ts_recv % 86400000000000 >= 600000000000 AND ts_recv % 86400000000000 < 75600000000000",
    ),
    "maintenance_filter": (lambda s, d: mbo(s, d).where(catalog.full_session("ES", F.col("ts_recv"))).select("ord", "ts_event", "contract", "action"), f"{SQL} SELECT {EVENT} FROM mbo WHERE NOT (ts_recv % 86400000000000 >= 75600000000000 AND ts_recv % 86400000000000 < 79200000000000)"),
    "continuous_filter": (
        lambda s, d: mbp1(s, d).where(filters.continuous(F.col("ts_recv"), [(timing.day_ns(DAY) + a * timing.SECOND, timing.day_ns(DAY) + b * timing.SECOND) for a, b in ((4500, 14400), (18000, 30600))])).select("ord", "ts_event", "contract", "action"),
        f"{SQL} SELECT {EVENT} FROM mbp1 WHERE (ts_recv >= {NS.format(DAY + ' 01:20:00')} AND ts_recv < {NS.format(DAY + ' 03:55:00')}) OR (ts_recv >= {NS.format(DAY + ' 05:05:00')} AND ts_recv < {NS.format(DAY + ' 08:25:00')})",
    ),
    "range_scan_sorted": (lambda s, d: filters.date_range(mbo(s, d), "2024-01-05", "20240107").select("ord", "ts_recv", "price", "size"), f"{SQL} SELECT ord, ts_recv, price, size FROM mbo WHERE session_date BETWEEN DATE '2024-01-05' AND DATE '2024-01-07' ORDER BY ts_recv, ord"),
    "with_datetime": (lambda s, d: timing.with_datetime(mbo(s, d)).select("ord", F.unix_micros("ts_recv_dt").alias("us"), timing.clock(timing.second_of_day(F.col("ts_recv"))).alias("clock")), f"{SQL} SELECT ord, ts_recv // 1000 AS us, strftime(make_timestamp(ts_recv // 1000), '%H:%M:%S') AS clock FROM mbo"),
    "local_hours": (
        lambda s, d: mbo(s, d).groupBy(F.hour(timing.local_ts(F.col("ts_event"), "Asia/Tokyo")).alias("hour")).agg(F.count(F.lit(1)).alias("n")) if s.conf.get("spark.sql.session.timeZone") in ("UTC", "Etc/UTC") else mbo(s, d).groupBy(F.floor((F.col("ts_event") / 3_600_000_000_000 + 9) % 24).cast("int").alias("hour")).agg(F.count(F.lit(1)).alias("n")),
        f"{SQL} SELECT ((ts_event // 3600000000000 + 9) % 24)::INTEGER AS hour, count(*) AS n FROM mbo GROUP BY ALL",
    ),
    "symbol_parse": (lambda s, d: _symbols(s, d).select("event_id", catalog.parse_symbol(F.col("symbol"), F.lit(2025)).alias("p")).select("event_id", "p.*"), f"WITH {SYMBOLS} {PARSED}"),
    "hkex_symbol_parse": (
        lambda s, d: _symbols(s, d).select("event_id", catalog.parse_hkex_symbol(F.col("symbol"), F.lit(2026)).alias("p")).where("p is not null").select("event_id", "p.*"),
        f"WITH {SYMBOLS} SELECT event_id, regexp_extract(symbol, '^([A-Z]{{2,4}})([FGHJKMNQUVXZ])(\\d)$', 1) AS product, left(symbol, length(symbol) - 1) || lpad(((CASE WHEN 2020 + right(symbol, 1)::INT < 2024 THEN 2030 + right(symbol, 1)::INT ELSE 2020 + right(symbol, 1)::INT END) % 100)::VARCHAR, 2, '0') AS contract FROM sy WHERE regexp_matches(symbol, '^([A-Z]{{2,4}})([FGHJKMNQUVXZ])(\\d)$')",
    ),
    "action_distribution": (lambda s, d: stats.distribution(mbo(s, d), "action", ("contract",)), f"{SQL} SELECT contract, action, count(*) AS n, 100.0::DOUBLE * count(*) / (sum(count(*)) OVER (PARTITION BY contract))::DOUBLE AS pct FROM mbo GROUP BY contract, action"),
    "side_distribution": (lambda s, d: stats.distribution(mbo(s, d), "side"), f"{SQL} SELECT side, count(*) AS n, 100.0::DOUBLE * count(*) / (sum(count(*)) OVER ())::DOUBLE AS pct FROM mbo GROUP BY side"),
    "flags_decode": (
        lambda s, d: stats.flag_counts(mbo(s, d), ("contract",)),
        f"{SQL} SELECT contract, count(*) AS n, count(*) FILTER ((flags & 128) > 0) AS n_last, count(*) FILTER ((flags & 32) > 0) AS n_snapshot, count(*) FILTER ((flags & 4) > 0) AS n_bad_ts, count(*) FILTER ((flags & 1) > 0) AS n_tob, count(*) FILTER (price = 9223372036854775807) AS n_no_price, count(DISTINCT order_id) AS n_orders FROM mbo GROUP BY contract",
    ),
    "size_percentiles": (
        lambda s, d: stats.percentiles(mbo(s, d), "size", (0.5, 0.95, 0.99), ("action",)),
        f"{SQL} SELECT action, quantile_cont(size, 0.5)::DOUBLE AS p50, quantile_cont(size, 0.95)::DOUBLE AS p95, quantile_cont(size, 0.99)::DOUBLE AS p99 FROM mbo GROUP BY action",
    ),
    "order_fingerprint": (
        lambda s, d: rounded(stats.order_fingerprint(mbo(s, d)), "mean_size", "events_per_s", digits=9),
        f"{SQL} SELECT order_id, count(*) AS n_events, max(ts_event) - min(ts_event) AS lifetime_ns, max(price) - min(price) AS amplitude, round(avg(size), 9) AS mean_size, round(CASE WHEN max(ts_event) > min(ts_event) THEN count(*) / ((max(ts_event) - min(ts_event)) / 1e9::DOUBLE) END, 9) AS events_per_s FROM mbo GROUP BY order_id",
    ),
    "log_fit": (
        lambda s, d: rounded(stats.log_fit(s.read.parquet(f"{d}/lineitem.parquet"), "l_quantity", "l_extendedprice", ("l_returnflag",)), "slope", "intercept"),
        "SELECT l_returnflag, round(regr_slope(ln(l_extendedprice), ln(l_quantity)), 6) AS slope, round(regr_intercept(ln(l_extendedprice), ln(l_quantity)), 6) AS intercept, count(*) AS n FROM lineitem WHERE l_quantity > 0 AND l_extendedprice > 0 GROUP BY l_returnflag",
    ),
    "tick_violations": (lambda s, d: mbo(s, d).where(filters.off_tick(F.col("price"), 1_000_000_000)).groupBy("contract").agg(F.count(F.lit(1)).alias("n")), f"{SQL} SELECT contract, count(*) AS n FROM mbo WHERE price % 1000000000 <> 0 GROUP BY contract"),
    "unpaired_trades": (lambda s, d: filters.unpaired_trades(mbo(s, d).withColumn("ts_event", F.expr("ts_event - ts_event % 3600000000000"))).select("ord", "ts_event", "price"), f"{SQL}, h AS (SELECT * REPLACE (ts_event - ts_event % 3600000000000 AS ts_event) FROM mbo) SELECT ord, ts_event, price FROM h ANTI JOIN (SELECT * FROM h WHERE action = 'FILL') f USING (ts_event, price) WHERE action = 'TRADE'"),
    "clean_front": (
        lambda s, d: filters.clean(mbo(s, d), 500_000_000, 6_001_000_000_000, ["session_date"]).select("ord", "contract", "price"),
        f"{SQL}, k AS (SELECT session_date, contract FROM mbo GROUP BY session_date, contract QUALIFY row_number() OVER (PARTITION BY session_date ORDER BY count(*) DESC, contract) = 1) SELECT ord, contract, price FROM mbo SEMI JOIN k USING (session_date, contract) WHERE price % 500000000 = 0 AND price >= 6001000000000",
    ),
    "exclusion_rate": (
        lambda s, d: quality.exclusion_rate(mbo(s, d), filters.clean(mbo(s, d), 500_000_000, 6_001_000_000_000, ["session_date"])),
        f"{SQL}, k AS (SELECT session_date, contract FROM mbo GROUP BY session_date, contract QUALIFY row_number() OVER (PARTITION BY session_date ORDER BY count(*) DESC, contract) = 1), a AS (SELECT count(*) AS n_after FROM mbo SEMI JOIN k USING (session_date, contract) WHERE price % 500000000 = 0 AND price >= 6001000000000), b AS (SELECT count(*) AS n_before FROM mbo) SELECT n_before, n_after, 100.0::DOUBLE * (n_before - n_after) / n_before AS excluded_pct FROM a, b",
    ),
    "intraday_profile": (
        lambda s, d: rounded(profiles.intraday(mbo(s, d), mbp1(s, d), 0.25, min_rows=50, keys=("contract", "session_date")), "n_trades_mean", "n_trades_std", "n_events_mean", "n_events_std", "otr_mean", "otr_std", "spread_mean_mean", "spread_mean_std", "total_depth_mean_mean", "total_depth_mean_std"),
        None,
    ),
    "top_spread_pivot": (
        lambda s, d: rounded(quality.top_spread(mbo(s, d).withColumn("ts_recv", F.expr("ts_recv - ts_recv % 60000000000")), ("contract", "ts_recv")), "spread_pts"),
        f"{SQL}, k AS (SELECT contract, ts_recv - ts_recv % 60000000000 AS ts_recv, max(CASE WHEN side = 'BID' THEN price END) AS bid, min(CASE WHEN side = 'ASK' THEN price END) AS ask FROM mbo WHERE action = 'ADD' GROUP BY ALL) SELECT *, round((ask - bid) / 1e9::DOUBLE, 6) AS spread_pts FROM k WHERE bid IS NOT NULL AND ask IS NOT NULL",
    ),
}
