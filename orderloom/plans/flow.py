"""Queries of order flow, volume bars, rolling statistics, normalisation, validation, replay and quality, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import catalog
from ..operators import book, filters, front, normalize, ofi, quality, rolling, stats, validate, vpin
from .market import FRONT, RATIOS, TICK_FP, rounded
from .views import REFERENCE_SQL, SQL, mbo, mbp1, reference

OFI = """lg AS (SELECT *, lag(bid_px_00) OVER w AS b0, lag(ask_px_00) OVER w AS a0, lag(bid_sz_00) OVER w AS bs0, lag(ask_sz_00) OVER w AS as0 FROM mbp1
  WINDOW w AS (PARTITION BY contract, session_date ORDER BY ts_event, ord)),
oe AS (SELECT *, coalesce(CASE WHEN bid_px_00 = b0 THEN bid_sz_00 - bs0 END, 0)::DOUBLE - coalesce(CASE WHEN ask_px_00 = a0 THEN ask_sz_00 - as0 END, 0)::DOUBLE AS ofi FROM lg)"""


def _buckets(seconds, floor=False):
    place = f"ts_event::DOUBLE / ({seconds} * 1000000000::BIGINT)::DOUBLE"
    bucket = f"CAST(floor({place}) AS BIGINT)" if floor else f"CAST(round_even({place}, 0) AS BIGINT)"
    return f"""{OFI}, ob AS (SELECT contract, session_date, {bucket} AS bucket_id, {bucket} * {seconds} * 1000000000::BIGINT AS bucket_start_ns, sum(ofi) AS ofi, count(*) AS n_updates,
  arg_min((bid_px_00 + ask_px_00) / 2, ts_event) AS mid_start, arg_max((bid_px_00 + ask_px_00) / 2, ts_event) AS mid_end FROM oe GROUP BY ALL)"""


RETURNS = f"""{_buckets(300)}, fr AS (SELECT *, ln(lead(mid_end, 1) OVER w / mid_end) AS ret_300s, ln(lead(mid_end, 3) OVER w / mid_end) AS ret_900s FROM ob
  WINDOW w AS (PARTITION BY contract, session_date ORDER BY bucket_id))"""
IC = f"""{RETURNS}, st AS (SELECT contract, session_date, ofi, 300 AS horizon_s, ret_300s AS ret FROM fr UNION ALL SELECT contract, session_date, ofi, 900, ret_900s FROM fr),
ic AS (SELECT contract, session_date, horizon_s::INTEGER AS horizon_s, corr(ofi, ret) AS ic, count(*) AS n_obs FROM st WHERE ret IS NOT NULL GROUP BY ALL HAVING count(*) >= 20)"""
TRADES = """tr AS (SELECT *, CASE side WHEN 'ASK' THEN size WHEN 'BID' THEN -size END AS sv FROM mbo WHERE action = 'TRADE' AND side <> 'NONE')"""


def _bars(keys):
    return f"""{TRADES}, sz AS (SELECT *, CAST(trunc((sum(abs(sv)) OVER (PARTITION BY {keys}))::DOUBLE * 0.05::DOUBLE) AS BIGINT) AS bar_size,
  sum(abs(sv)) OVER (PARTITION BY {keys} ORDER BY ts_event, ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM tr),
ba AS (SELECT {keys}, CAST(upto // bar_size AS BIGINT) AS bucket_id_daily, max(ts_event) AS ts_last, coalesce(sum(sv) FILTER (sv > 0), 0)::BIGINT AS v_buy, coalesce(sum(-sv) FILTER (sv < 0), 0)::BIGINT AS v_sell,
  sum(abs(sv))::BIGINT AS v_total, count(*) AS n_trades FROM sz WHERE bar_size > 0 GROUP BY ALL)"""


VPIN = f"""{_bars('session_date')}, vp AS (SELECT *, abs(v_buy - v_sell)::DOUBLE / v_total AS order_imbalance,
  round(avg(abs(v_buy - v_sell)::DOUBLE / v_total) OVER (ORDER BY session_date, bucket_id_daily ROWS BETWEEN 49 PRECEDING AND CURRENT ROW), 9) AS vpin FROM ba),
os AS (SELECT session_date, coalesce(sum(count(*)) OVER (ORDER BY session_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS o FROM ba GROUP BY session_date)"""
DAILY = f"da AS (SELECT product, session_date, count(*) AS n_rows, count(*) FILTER (action = 'TRADE') AS n_trade, {RATIOS} FROM mbo GROUP BY ALL)"


def _daily(s, d):
    return stats.contract_stats(mbo(s, d), ("product", "session_date"), TICK_FP).select("product", "session_date", "n_rows", "n_trade", "cancel_rate", "fill_rate", "order_to_trade_ratio")


def _one_day(df):
    return df.where("session_date = DATE'2024-01-10'")


def _raw(s, d):
    """Exchange messages made of events: (orderbook_id, order_id, side) get adds, trades, deletes and modifies."""
    m = mbo(s, d)
    msg = F.expr("CASE ord % 5 WHEN 0 THEN 330 WHEN 1 THEN 350 WHEN 2 THEN 332 WHEN 3 THEN 350 ELSE CASE WHEN ord % 3 = 0 THEN 331 ELSE 330 END END")
    side = F.expr("CASE WHEN ord % 5 IN (1, 3) THEN 2 + order_id % 2 ELSE order_id % 2 END")
    return m.select(
        F.col("ord").alias("seq_num"), F.lit(0).alias("msg_index"), msg.alias("msg_type"), F.lit(7).cast("long").alias("orderbook_id"), "order_id",
        F.expr("CASE WHEN ord % 5 = 2 THEN 0 ELSE 20000 + ord % 50 END").alias("price"), F.expr("CASE WHEN ord % 5 = 2 THEN 0 WHEN ord % 5 IN (1, 3) THEN 1 + ord % 4 ELSE 5 + ord % 9 END").alias("quantity"), side.alias("side"),
    )


RAW = """rw AS (SELECT ord AS seq_num, CASE ord % 5 WHEN 0 THEN 330 WHEN 1 THEN 350 WHEN 2 THEN 332 WHEN 3 THEN 350 ELSE CASE WHEN ord % 3 = 0 THEN 331 ELSE 330 END END AS msg_type, 7::BIGINT AS orderbook_id, order_id,
  CASE WHEN ord % 5 = 2 THEN 0 ELSE 20000 + ord % 50 END AS price, CASE WHEN ord % 5 = 2 THEN 0 WHEN ord % 5 IN (1, 3) THEN 1 + ord % 4 ELSE 5 + ord % 9 END AS quantity,
  CASE WHEN ord % 5 IN (1, 3) THEN 2 + order_id % 2 ELSE order_id % 2 END AS side FROM mbo)"""
DELETES = f"""{RAW}, k AS (SELECT *, CASE WHEN msg_type = 350 THEN CASE side WHEN 2 THEN 'BID' ELSE 'ASK' END ELSE CASE side WHEN 0 THEN 'BID' ELSE 'ASK' END END AS s FROM rw),
x AS (SELECT d.seq_num, (SELECT max(a.seq_num) FROM k a WHERE a.order_id = d.order_id AND a.s = d.s AND a.msg_type IN (330, 331) AND a.seq_num < d.seq_num) AS a FROM k d WHERE d.msg_type = 332),
y AS (SELECT x.seq_num, x.a, d.order_id, d.s, a.price, a.quantity - coalesce((SELECT sum(t.quantity) FROM k t WHERE t.order_id = d.order_id AND t.s = d.s AND t.msg_type = 350 AND t.seq_num > x.a AND t.seq_num < x.seq_num), 0) AS rest,
  (SELECT count(*) FROM k z WHERE z.order_id = d.order_id AND z.s = d.s AND z.msg_type = 332 AND z.seq_num > x.a AND z.seq_num < x.seq_num) AS gone
  FROM x JOIN k d ON d.seq_num = x.seq_num LEFT JOIN k a ON a.seq_num = x.a)"""
REASON = """CASE WHEN ts_event = 0 THEN 'TS_EVENT_ZERO' WHEN ts_recv = 0 THEN 'TS_RECV_ZERO' WHEN action NOT IN ('ADD','CANCEL','MODIFY','CLEAR','TRADE','FILL','NONE') THEN 'INVALID_ACTION' WHEN side NOT IN ('BID','ASK','NONE') THEN 'INVALID_SIDE'
  WHEN action IN ('ADD','CANCEL','MODIFY') AND side = 'NONE' THEN 'INVALID_SIDE_FOR_ACTION' WHEN action IN ('ADD','CANCEL','MODIFY') AND order_id = 0 AND flags & 1 = 0 THEN 'INVALID_ORDER_ID_ZERO'
  WHEN action IN ('ADD','MODIFY') AND flags & 1 = 0 AND price = 9223372036854775807 THEN 'MISSING_PRICE_FOR_ACTION' WHEN action IN ('ADD','MODIFY') AND flags & 1 = 0 AND contract NOT LIKE '%CAL%' AND price = 0 THEN 'INVALID_PRICE_ZERO'
  WHEN action IN ('ADD','MODIFY') AND flags & 1 = 0 AND contract NOT LIKE '%CAL%' AND price < 0 THEN 'INVALID_PRICE_NEGATIVE' WHEN action IN ('ADD','MODIFY') AND size = 0 THEN 'INVALID_SIZE_ZERO' END"""
DIRTY = f"""di AS (SELECT * REPLACE (CASE WHEN ord % 53 = 0 THEN 9223372036854775807 WHEN ord % 41 = 0 THEN 0 WHEN ord % 43 = 0 THEN -price ELSE price END AS price, CASE WHEN ord % 47 = 0 THEN 0 ELSE size END AS size,
  CASE WHEN ord % 59 = 0 THEN 0 ELSE order_id END AS order_id, CASE WHEN ord % 61 = 0 THEN 0 ELSE ts_event END AS ts_event, CASE WHEN ord % 67 = 0 THEN 0 ELSE ts_recv END AS ts_recv,
  CASE WHEN ord % 71 = 0 THEN 'BAD' ELSE action END AS action, CASE WHEN ord % 73 = 0 THEN 'UP' ELSE side END AS side, CASE WHEN ord % 6 = 0 THEN flags | 1 ELSE flags END AS flags) FROM mbo), vr AS (SELECT *, {REASON} AS reject_reason FROM di)"""


def _dirty(s, d):
    return mbo(s, d).withColumns(
        {
            "price": F.expr("CASE WHEN ord % 53 = 0 THEN 9223372036854775807 WHEN ord % 41 = 0 THEN 0 WHEN ord % 43 = 0 THEN -price ELSE price END"),
            "size": F.expr("CASE WHEN ord % 47 = 0 THEN 0 ELSE size END"),
            "order_id": F.expr("CASE WHEN ord % 59 = 0 THEN 0 ELSE order_id END"),
            "ts_event": F.expr("CASE WHEN ord % 61 = 0 THEN 0 ELSE ts_event END"),
            "ts_recv": F.expr("CASE WHEN ord % 67 = 0 THEN 0 ELSE ts_recv END"),
            "action": F.expr("CASE WHEN ord % 71 = 0 THEN 'BAD' ELSE action END"),
            "side": F.expr("CASE WHEN ord % 73 = 0 THEN 'UP' ELSE side END"),
            "flags": F.expr("CASE WHEN ord % 6 = 0 THEN flags | 1 ELSE flags END"),
        }
    )


def _copies(df):
    """Times and sequences in blocks, so some events repeat."""
    return df.withColumns({"ts_event": F.expr("ts_event - ts_event % 36000000000000"), "sequence": F.lit(0).cast("long")})


COPIES = "co AS (SELECT * REPLACE (ts_event - ts_event % 36000000000000 AS ts_event, 0 AS sequence) FROM mbo)"


def _adds(m):
    """Events whose cancels always meet their own order at its price: the add of each id, then its cancel, with other ids between."""
    return m.select(
        F.lit("X").alias("contract"), F.lit("2024-01-01").cast("date").alias("session_date"), "ord", "ts_event", "ts_recv", F.expr("CASE WHEN ord % 4 = 3 THEN 'CANCEL' ELSE 'ADD' END").alias("action"),
        F.expr("CASE WHEN (ord - CASE WHEN ord % 4 = 3 THEN 3 ELSE 0 END) % 8 < 4 THEN 'BID' ELSE 'ASK' END").alias("side"),
        F.expr("CASE WHEN (ord - CASE WHEN ord % 4 = 3 THEN 3 ELSE 0 END) % 8 < 4 THEN 5990 ELSE 6010 END * 1000000000L + ((ord - CASE WHEN ord % 4 = 3 THEN 3 ELSE 0 END) % 7) * 250000000").alias("price"),
        F.expr("1 + (ord - CASE WHEN ord % 4 = 3 THEN 3 ELSE 0 END) % 5").alias("size"), F.expr("ord - CASE WHEN ord % 4 = 3 THEN 3 ELSE 0 END").alias("order_id"), F.lit(128).cast("short").alias("flags"), F.col("ord").alias("sequence"),
    )


def _keyed_adds(s, d):
    """All events so, fours of them dealt to five contracts, and 20,000 at most to a day."""
    return _adds(mbo(s, d)).withColumns({"contract": F.expr(f"concat('X', {CONTRACT_OF})"), "session_date": F.expr(f"date_add(DATE'2024-01-01', CAST({DAY_OF} AS INT))")})


CONTRACT_OF, DAY_OF = "CAST((ord - ord % 4) / 4 AS BIGINT) % 5", "CAST((ord - ord % 20000) / 20000 AS BIGINT)"
_BASE = "(ord - CASE WHEN ord % 4 = 3 THEN 3 ELSE 0 END)"
#: The running size of each side's seven prices: one pass over the events of a contract and day.
LEVELS = {f"{s[0].lower()}{k}": (s, p * 1_000_000_000 + k * 250_000_000) for s, p in (("BID", 5990), ("ASK", 6010)) for k in range(7)}
RUNNING = f"""ev AS (SELECT ord, {CONTRACT_OF} AS contract, {DAY_OF} AS session_date, CASE WHEN ord % 4 = 3 THEN -1 ELSE 1 END * (1 + {_BASE} % 5) AS delta, CASE WHEN {_BASE} % 8 < 4 THEN 'BID' ELSE 'ASK' END AS side,
  CASE WHEN {_BASE} % 8 < 4 THEN 5990 ELSE 6010 END * 1000000000::BIGINT + ({_BASE} % 7) * 250000000 AS price FROM mbo),
rs AS (SELECT ord, {", ".join(f"sum(CASE WHEN side = '{s}' AND price = {p} THEN delta ELSE 0 END) OVER w AS {n}" for n, (s, p) in LEVELS.items())} FROM ev WINDOW w AS (PARTITION BY contract, session_date ORDER BY ord))
SELECT ord, """ + ", ".join(
    f"(CASE {' '.join(f'WHEN {n} > 0 THEN {LEVELS[n][1]}' for n in names)} END / 1e9::DOUBLE) AS {c}_px_00, (CASE {' '.join(f'WHEN {n} > 0 THEN {n}' for n in names)} END)::BIGINT AS {c}_sz_00"
    for c, names in (("bid", [f"b{k}" for k in range(6, -1, -1)]), ("ask", [f"a{k}" for k in range(7)]))
) + " FROM rs"

ORDERED = "PARTITION BY contract, session_date ORDER BY ts_recv, sequence, CASE action WHEN 'TRADE' THEN 0 ELSE 1 END, ord"
NULLED = "nq AS (SELECT * REPLACE (CASE WHEN ord % 19 = 0 THEN NULL ELSE bid_px_00 END AS bid_px_00, CASE WHEN ord % 23 = 0 THEN NULL ELSE ask_px_00 END AS ask_px_00) FROM mbp1)"


def _nulled(s, d):
    return mbp1(s, d).withColumns({"bid_px_00": F.expr("CASE WHEN ord % 19 <> 0 THEN bid_px_00 END"), "ask_px_00": F.expr("CASE WHEN ord % 23 <> 0 THEN ask_px_00 END")})


def _coarse(df):
    """Times in seconds, so that keys of (ts_recv, sequence) repeat."""
    return df.withColumns({"ts_recv": F.expr("ts_recv - ts_recv % 600000000000"), "sequence": F.expr("ord % 3")})


COARSE = "cq AS (SELECT * REPLACE (ts_recv - ts_recv % 600000000000 AS ts_recv, ord % 3 AS sequence) FROM mbp1)"
MATCHED = f"""{REFERENCE_SQL}, ou AS (SELECT * REPLACE (ts_recv - ts_recv % 600000000000 AS ts_recv, ord % 3 AS sequence) FROM mbp1 QUALIFY count(*) OVER (PARTITION BY ts_recv - ts_recv % 600000000000, ord % 3) = 1),
ru AS (SELECT * REPLACE (ts_recv - ts_recv % 600000000000 AS ts_recv, ord % 3 AS sequence) FROM ref QUALIFY count(*) OVER (PARTITION BY ts_recv - ts_recv % 600000000000, ord % 3) = 1),
jo AS (SELECT ts_recv, sequence, {", ".join(f"ou.{c} AS our_{c}, ru.{c} AS ref_{c}" for c in quality.TOP)} FROM ou JOIN ru USING (ts_recv, sequence))"""
SAME = " AND ".join(f"our_{c} = ref_{c}" for c in quality.TOP)
COMPARED = f"""SELECT count(*) AS n_joined, {", ".join(f"count(*) FILTER (our_{c} = ref_{c}) AS {c[:6]}" for c in quality.TOP)}, count(*) FILTER ({SAME}) AS full_match, """ + ", ".join(
    f"count(*) FILTER (our_{s}_px_00 = ref_{s}_px_00 AND our_{s}_sz_00 > ref_{s}_sz_00) AS {s}_sz_over, count(*) FILTER (our_{s}_px_00 = ref_{s}_px_00 AND our_{s}_sz_00 < ref_{s}_sz_00) AS {s}_sz_under, "
    f"round(avg(CASE WHEN our_{s}_px_00 = ref_{s}_px_00 AND our_{s}_sz_00 <> ref_{s}_sz_00 THEN abs(our_{s}_sz_00 - ref_{s}_sz_00) END), 2) AS avg_{s}_sz_delta"
    for s in ("bid", "ask")
)

QUERIES = {
    "ofi_events": (lambda s, d: ofi.events(mbp1(s, d)).select("ord", "contract", "ofi"), f"{SQL}, {OFI} SELECT ord, contract, ofi FROM oe"),
    "ofi_buckets_nearest": (lambda s, d: ofi.buckets(mbp1(s, d), 60), f"{SQL}, {_buckets(60)} SELECT * FROM ob"),
    "ofi_buckets_floor": (lambda s, d: ofi.buckets(mbp1(s, d), 300, "floor"), f"{SQL}, {_buckets(300, True)} SELECT * FROM ob"),
    "ofi_forward_returns": (lambda s, d: rounded(ofi.forward_returns(ofi.buckets(mbp1(s, d), 300), [300, 900], 300), "ret_300s", "ret_900s", digits=9), f"{SQL}, {RETURNS} SELECT * REPLACE (round(ret_300s, 9) AS ret_300s, round(ret_900s, 9) AS ret_900s) FROM fr"),
    "ofi_forward_returns_time": (
        lambda s, d: rounded(ofi.forward_returns(ofi.buckets(mbp1(s, d), 300), [600], 300, "time"), "ret_600s", digits=9),
        f"{SQL}, {_buckets(300)} SELECT a.*, round(ln(b.mid_end / a.mid_end), 9) AS ret_600s FROM ob a LEFT JOIN ob b ON a.contract = b.contract AND a.session_date = b.session_date AND b.bucket_id = a.bucket_id + 2",
    ),
    "ofi_ic_daily": (lambda s, d: rounded(ofi.ic_decay(mbp1(s, d), [300, 900], 300, 20), "ic"), f"{SQL}, {IC} SELECT * REPLACE (round(ic, 6) AS ic) FROM ic"),
    "ofi_ic_summary": (lambda s, d: rounded(ofi.ic_summary(ofi.ic_decay(mbp1(s, d), [300, 900], 300, 20)), "ic_mean", "ic_std"), f"{SQL}, {IC} SELECT horizon_s, round(avg(ic), 6) AS ic_mean, round(stddev_samp(ic), 6) AS ic_std, count(ic) AS n_days FROM ic GROUP BY horizon_s"),
    "classify_trades": (lambda s, d: vpin.classify(mbo(s, d)).select("ord", "side", "size", "signed_volume"), f"{SQL}, {TRADES} SELECT ord, side, size, sv AS signed_volume FROM tr"),
    "dropped_trades": (lambda s, d: vpin.dropped_share(mbo(s, d)), f"{SQL} SELECT count(*) AS n_trades, count(*) FILTER (side = 'NONE') AS n_dropped FROM mbo WHERE action = 'TRADE'"),
    "volume_bars": (lambda s, d: vpin.bars(vpin.classify(mbo(s, d)), 0.05), f"{SQL}, {_bars('session_date')} SELECT * FROM ba"),
    "vpin_single_day": (
        lambda s, d: rounded(vpin.vpin(vpin.bars(vpin.classify(_one_day(mbo(s, d)))), 10), "vpin", digits=9),
        f"{SQL}, {_bars('session_date')} SELECT *, abs(v_buy - v_sell)::DOUBLE / v_total AS order_imbalance, round(avg(abs(v_buy - v_sell)::DOUBLE / v_total) OVER (ORDER BY bucket_id_daily ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), 9) AS vpin FROM ba WHERE session_date = DATE '2024-01-10'",
    ),
    "vpin_range": (lambda s, d: rounded(vpin.vpin_range(vpin.classify(mbo(s, d))), "vpin", digits=9), f"{SQL}, {VPIN} SELECT vp.*, o + bucket_id_daily AS bucket_id_global, o + bucket_id_daily < 49 AS is_warmup FROM vp JOIN os USING (session_date)"),
    "rolling_metrics": (
        lambda s, d: rounded(rolling.rolling(_daily(s, d), (5,), ("cancel_rate", "n_rows"), 2, ("product",)), "cancel_rate_roll5", "n_rows_roll5"),
        f"{SQL}, {DAILY} SELECT *, round(CASE WHEN count(cancel_rate) OVER w >= 2 THEN avg(cancel_rate) OVER w END, 6) AS cancel_rate_roll5, round(CASE WHEN count(n_rows) OVER w >= 2 THEN avg(n_rows::DOUBLE) OVER w END, 6) AS n_rows_roll5 FROM da WINDOW w AS (PARTITION BY product ORDER BY session_date ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)",
    ),
    "merge_products": (
        lambda s, d: rolling.merge_products({p: _daily(s, d).where(F.col("product") == p).drop("product") for p in ("ES", "NIY")}),
        f"{SQL}, {DAILY} SELECT * FROM da WHERE product IN ('ES', 'NIY')",
    ),
    "rolling_summary": (
        lambda s, d: rounded(rolling.summary(_daily(s, d).where("product = 'ES'"), "n_rows", (5,)), "mean", "std", "min", "max"),
        f"{SQL}, {DAILY}, r AS (SELECT n_rows::DOUBLE AS a, avg(n_rows::DOUBLE) OVER (ORDER BY session_date ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS b FROM da WHERE product = 'ES'), u AS (SELECT 'n_rows' AS series, a AS v FROM r UNION ALL SELECT 'n_rows_roll5', b FROM r) SELECT series, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std, round(min(v), 6) AS min, round(max(v), 6) AS max FROM u GROUP BY series",
    ),
    "otr_divergence": (
        lambda s, d: rounded(rolling.divergence(_daily(s, d).where("product = 'NIY'"), _daily(s, d).where("product = 'ES'")), "divergence", "divergence_roll20"),
        f"{SQL}, {DAILY} SELECT session_date, n.order_to_trade_ratio AS a, e.order_to_trade_ratio AS b, round(n.order_to_trade_ratio - e.order_to_trade_ratio, 6) AS divergence, round(avg(n.order_to_trade_ratio - e.order_to_trade_ratio) OVER (ORDER BY session_date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), 6) AS divergence_roll20 FROM (SELECT * FROM da WHERE product = 'NIY') n JOIN (SELECT * FROM da WHERE product = 'ES') e USING (session_date)",
    ),
    "vendor_translate": (
        lambda s, d: normalize.vendor_translate(
            mbo(s, d).select("ord", "session_date", F.expr("CASE ord % 3 WHEN 0 THEN 'ESZ5' WHEN 1 THEN 'ESM6-ESU6' ELSE 'SPX C1' END").alias("symbol"), F.expr("CASE ord % 8 WHEN 7 THEN 'X' ELSE substr('ACMRTFN', CAST(1 + ord % 8 AS INT), 1) END").alias("action"), F.substring("side", 1, 1).alias("side"), F.expr("ord % 16").alias("flags")),
            "glbx.mdp3",
        ).select("ord", "venue", "product", "contract", "action", "side", F.col("flags").cast("long").alias("flags")),
        f"{SQL} SELECT ord, 'CME' AS venue, 'ES' AS product, CASE ord % 3 WHEN 0 THEN 'ESZ25' ELSE 'ES_CAL_M26U26' END AS contract, ['ADD','CANCEL','MODIFY','CLEAR','TRADE','FILL','NONE'][1 + ord % 8] AS action, side, CASE WHEN (ord % 16) & 8 > 0 THEN ((ord % 16) - 8) | 4 ELSE ord % 16 END AS flags FROM mbo WHERE ord % 3 <> 2 AND ord % 8 <> 7",
    ),
    "orders_trades_union": (
        lambda s, d: normalize.merge_raw(_raw(s, d).where("msg_type <> 350"), _raw(s, d).where("msg_type = 350").drop("msg_type").withColumn("trade_id", F.col("seq_num"))).select("seq_num", F.col("msg_type").cast("long").alias("msg_type"), "source", "order_id", "trade_id"),
        f"{SQL}, {RAW} SELECT seq_num, msg_type::BIGINT AS msg_type, CASE WHEN msg_type = 350 THEN 'trade' ELSE 'order' END AS source, order_id, CASE WHEN msg_type = 350 THEN seq_num END AS trade_id FROM rw",
    ),
    "instrument_listing": (lambda s, d: normalize.instruments(mbo(s, d).select(F.expr("order_id % 7").alias("orderbook_id"), F.col("contract").alias("symbol"))), f"{SQL} SELECT DISTINCT order_id % 7 AS orderbook_id, contract AS symbol FROM mbo"),
    "contract_enrichment": (
        lambda s, d: normalize.with_product(mbo(s, d).select("ord", F.expr("CASE WHEN ord % 2 = 0 THEN contract ELSE 'ZZZ' END").alias("contract")), catalog.dim_product(s)),
        f"{SQL} SELECT ord, CASE WHEN ord % 2 = 0 THEN contract ELSE 'ZZZ' END AS contract, CASE WHEN ord % 2 = 0 THEN 'ES' END AS product, CASE WHEN ord % 2 = 0 THEN 250000000::BIGINT END AS tick_size_fp, CASE WHEN ord % 2 = 0 THEN 'USD' ELSE 'HKD' END AS currency FROM mbo",
    ),
    "trade_explode": (
        lambda s, d: normalize.explode_trades(_raw(s, d)).select("seq_num", F.col("sub_ord").cast("long").alias("sub_ord"), "action", "side", F.col("flags").cast("long").alias("flags")),
        f"{SQL}, {RAW} SELECT seq_num, sub_ord, CASE WHEN msg_type = 350 THEN ['TRADE', 'FILL', 'CANCEL'][sub_ord + 1] WHEN msg_type = 330 THEN 'ADD' WHEN msg_type = 331 THEN 'MODIFY' ELSE 'CANCEL' END AS action, CASE WHEN msg_type <> 350 THEN ['BID', 'ASK'][side + 1] WHEN (sub_ord = 0) = (side = 2) THEN 'ASK' ELSE 'BID' END AS side, CASE WHEN msg_type = 350 AND sub_ord = 1 THEN 0 ELSE 132 END::BIGINT AS flags FROM rw, range(3) r(sub_ord) WHERE (msg_type = 350 OR sub_ord = 0) AND NOT (msg_type = 350 AND order_id = 0)",
    ),
    "delete_resolution": (
        lambda s, d: normalize.resolve_deletes(_raw(s, d)).where("msg_type = 332").select("seq_num", F.col("price").cast("long").alias("price"), F.col("quantity").cast("long").alias("quantity")),
        f"{SQL}, {DELETES} SELECT seq_num, CASE WHEN a IS NOT NULL AND gone = 0 AND rest > 0 THEN price ELSE 0 END::BIGINT AS price, CASE WHEN a IS NOT NULL AND gone = 0 AND rest > 0 THEN rest ELSE 0 END::BIGINT AS quantity FROM y",
    ),
    "modify_reconstitution": (
        lambda s, d: normalize.reconstitute_modifies(mbo(s, d).withColumns({"order_id": F.expr("order_id % 2"), "side": F.lit("BID")})).select("ord", "contract", "action"),
        f"{SQL}, m AS (SELECT * REPLACE (order_id % 2 AS order_id, 'BID' AS side) FROM mbo), f AS (SELECT *, max((action = 'FILL')::INT) OVER (PARTITION BY contract, session_date, sequence) AS fl, lead(action) OVER w AS na, lead(order_id) OVER w AS no, lead(side) OVER w AS ns FROM m WINDOW w AS (PARTITION BY contract, session_date ORDER BY ord)), g AS (SELECT *, coalesce(action = 'CANCEL' AND order_id > 0 AND fl = 0 AND na = 'ADD' AND no = order_id AND ns = side, FALSE) AS gone FROM f), h AS (SELECT *, coalesce(lag(gone) OVER (PARTITION BY contract, session_date ORDER BY ord), FALSE) AS after FROM g) SELECT ord, contract, CASE WHEN after THEN 'MODIFY' ELSE action END AS action FROM h WHERE NOT gone",
    ),
    "warmup_end": (lambda s, d: normalize.warmup_end(mbo(s, d).withColumn("flags", F.expr("CASE WHEN ord % 300 < 100 THEN 32 ELSE 128 END"))), f"{SQL} SELECT contract, session_date, min(ord) FILTER (ord % 300 >= 100) AS first_live FROM mbo GROUP BY ALL"),
    "validate_structural": (lambda s, d: _dirty(s, d).withColumn("reject_reason", validate.structural_reason()).select("ord", "reject_reason"), f"{SQL}, {DIRTY} SELECT ord, reject_reason FROM vr"),
    "dedup_events": (
        lambda s, d: validate.stateless(_copies(mbo(s, d)), ("session_date",)).groupBy("reject_reason").agg(F.count(F.lit(1)).alias("n")),
        f"{SQL}, {COPIES}, r AS (SELECT *, {REASON} AS rr FROM co), q AS (SELECT *, row_number() OVER (PARTITION BY session_date, ts_event, sequence, order_id, action, price, size, rr IS NULL AND action IN ('ADD','CANCEL','MODIFY') ORDER BY ord) AS n FROM r) SELECT CASE WHEN rr IS NULL AND action IN ('ADD','CANCEL','MODIFY') AND n > 1 THEN 'DUPLICATE_EVENT' ELSE rr END AS reject_reason, count(*) AS n FROM q GROUP BY 1",
    ),
    "reject_breakdown": (
        lambda s, d: validate.breakdown(_dirty(s, d).withColumn("reject_reason", validate.structural_reason())),
        f"{SQL}, {DIRTY} SELECT reject_reason, session_date, ((ts_event % 86400000000000) // 3600000000000)::INTEGER AS hour, count(*) AS n FROM vr WHERE reject_reason IS NOT NULL GROUP BY ALL",
    ),
    "validate_stateful": (lambda s, d: validate.summary(validate.validate(_dirty(s, d))), None),
    "validate_loose": (
        lambda s, d: validate.split(_dirty(s, d).withColumn("reject_reason", validate.structural_reason()), "LOOSE")[0].select("ord", F.col("flags").cast("long").alias("flags")),
        f"{SQL}, {DIRTY} SELECT ord, CASE WHEN reject_reason IS NULL THEN flags ELSE flags | 4 END::BIGINT AS flags FROM vr",
    ),
    "mbp1_rebuild_adds": (lambda s, d: book.reconstruct(_keyed_adds(s, d)).select("ord", "bid_px_00", "ask_px_00", "bid_sz_00", "ask_sz_00"), f"{SQL}, {RUNNING}"),
    "mbp1_rebuild": (lambda s, d: book.reconstruct(mbo(s, d)), None),
    "depth_rebuild": (lambda s, d: book.reconstruct(mbo(s, d), depth=5, repair=True), None),
    "orphan_counts": (lambda s, d: book.orphan_counts(mbo(s, d)), None),
    "crossed_book": (lambda s, d: quality.crossed(_nulled(s, d)), f"{SQL}, {NULLED} SELECT contract, session_date, count(*) AS n_rows, count(*) FILTER (bid_px_00 IS NOT NULL AND ask_px_00 IS NOT NULL) AS n_both, count(*) FILTER (bid_px_00 >= ask_px_00) AS n_crossed FROM nq GROUP BY ALL"),
    "trade_outside_spread": (
        lambda s, d: quality.trades_outside(mbp1(s, d)),
        f"{SQL}, l AS (SELECT *, lag(bid_px_00) OVER w AS b, lag(ask_px_00) OVER w AS a FROM mbp1 WINDOW w AS ({ORDERED})) SELECT contract, session_date, count(*) AS n_trades, count(*) FILTER (price < b OR price > a) AS n_outside FROM l WHERE action = 'TRADE' GROUP BY ALL",
    ),
    "spread_percentiles": (
        lambda s, d: quality.spread_distribution(_nulled(s, d), 0.25),
        f"{SQL}, {NULLED}, k AS (SELECT contract, session_date, (ask_px_00 - bid_px_00) / 0.25::DOUBLE AS s FROM nq WHERE bid_px_00 IS NOT NULL AND ask_px_00 IS NOT NULL) SELECT contract, session_date, count(*) AS n_spread, count(*) FILTER (s < 1) AS n_locked, round(avg(s), 2) AS avg_spread, round(median(s), 2) AS med_spread, round(quantile_cont(s, 0.95), 2) AS p95_spread, round(quantile_cont(s, 0.99), 2) AS p99_spread, round(min(s), 2) AS min_spread, round(max(s), 2) AS max_spread FROM k GROUP BY ALL",
    ),
    "neg_sizes": (lambda s, d: quality.negative_sizes(mbp1(s, d).withColumn("bid_sz_00", F.expr("bid_sz_00 - 2"))), f"{SQL} SELECT contract, session_date, count(*) FILTER (bid_sz_00 < 2) AS n_neg_bid, count(*) FILTER (ask_sz_00 < 0) AS n_neg_ask FROM mbp1 GROUP BY ALL"),
    "null_drops": (
        lambda s, d: quality.null_drops(_nulled(s, d)),
        f"{SQL}, {NULLED}, l AS (SELECT *, lag(bid_px_00) OVER w AS b, lag(ask_px_00) OVER w AS a, lag(action) OVER w AS p FROM nq WINDOW w AS ({ORDERED})) SELECT contract, session_date, count(*) FILTER (b IS NOT NULL AND bid_px_00 IS NULL AND p <> 'CLEAR') AS bid_null_drops, count(*) FILTER (a IS NOT NULL AND ask_px_00 IS NULL AND p <> 'CLEAR') AS ask_null_drops FROM l GROUP BY ALL",
    ),
    "quote_verdict": (lambda s, d: quality.verdict(_nulled(s, d)), None),
    "burst_rate": (lambda s, d: quality.burst_rate(_coarse(mbp1(s, d))), f"{SQL}, {COARSE}, k AS (SELECT count(*) AS n FROM cq GROUP BY ts_recv, sequence) SELECT coalesce(sum(n) FILTER (n > 1), 0)::BIGINT AS n_burst, sum(n)::BIGINT AS n_rows, coalesce(sum(n) FILTER (n > 1), 0)::DOUBLE / sum(n)::DOUBLE AS burst_rate FROM k"),
    "burst_rows": (lambda s, d: quality.burst_rows(_coarse(mbp1(s, d))).select("ord", "ts_recv", "sequence"), f"{SQL}, {COARSE} SELECT ord, ts_recv, sequence FROM cq WHERE (ts_recv, sequence) IN (SELECT (ts_recv, sequence) FROM cq GROUP BY ts_recv, sequence HAVING count(*) > 1)"),
    "unique_key_match": (lambda s, d: quality.compare(_coarse(mbp1(s, d)), _coarse(reference(s, d))), f"{SQL}, {MATCHED} {COMPARED} FROM jo"),
    "match_mismatches_topn": (
        lambda s, d: quality.first_mismatches(_coarse(mbp1(s, d)), _coarse(reference(s, d)), 20),
        f"{SQL}, {MATCHED} SELECT * FROM jo WHERE NOT ({SAME.replace(' = ', ' IS NOT DISTINCT FROM ')}) ORDER BY ts_recv, sequence LIMIT 20",
    ),
    "fingerprint_metrics": (
        lambda s, d: quality.fingerprint(mbo(s, d), ["action", "side", "price", "size"]),
        f"{SQL} SELECT contract, session_date, count(*) AS row_count, min(ts_event) AS ts_min, max(ts_event) AS ts_max, min(price) AS price_min, max(price) AS price_max, sum(CAST('0x' || substr(md5(concat_ws('|', ord, action, side, price, size)), 1, 8) AS BIGINT))::BIGINT AS checksum FROM mbo GROUP BY ALL",
    ),
    "latency_percentiles": (
        lambda s, d: quality.latency(mbo(s, d).withColumn("ts_recv", F.expr("ts_event + ord % 1000"))),
        f"{SQL}, k AS (SELECT contract, ord % 1000 AS l FROM mbo) SELECT contract, quantile_cont(l, 0.5)::DOUBLE AS p50, quantile_cont(l, 0.95)::DOUBLE AS p95, quantile_cont(l, 0.99)::DOUBLE AS p99, max(l) AS max FROM k GROUP BY contract",
    ),
    "snapshot_boundary": (
        lambda s, d: quality.snapshot_boundary(mbo(s, d).withColumn("flags", F.expr("CASE WHEN ord % 300 < 100 THEN 32 ELSE 128 END"))),
        f"{SQL} SELECT contract, session_date, count(*) FILTER (ord % 300 < 100) AS n_snapshot, max(ord) FILTER (ord % 300 < 100) AS last_snapshot, min(ord) FILTER (ord % 300 >= 100) AS first_live FROM mbo GROUP BY ALL",
    ),
    "price_outliers": (
        lambda s, d: quality.sanity(mbo(s, d), 500_000_000, 0.0005),
        f"{SQL}, k AS (SELECT contract, session_date, median(price)::DOUBLE AS m FROM mbo GROUP BY ALL) SELECT contract, session_date, count(*) AS n_rows, count(*) FILTER (price = 9223372036854775807) AS n_no_price, count(*) FILTER (price % 500000000 <> 0) AS n_off_tick, count(*) FILTER (abs(price - m) > 0.0005::DOUBLE * m) AS n_outliers FROM mbo JOIN k USING (contract, session_date) GROUP BY ALL",
    ),
    "printable_trades": (lambda s, d: quality.printable(mbo(s, d).where("action = 'TRADE'").withColumn("deal_type", F.expr("ord % 4"))), f"{SQL} SELECT side, count(*) FILTER (ord % 2 = 1) AS n_printable, count(*) FILTER (ord % 2 = 0) AS n_other FROM mbo WHERE action = 'TRADE' GROUP BY side"),
    "front_events": (lambda s, d: front.front_events(mbo(s, d)).select("ord", "contract"), f"{SQL}, {FRONT} SELECT ord, contract FROM mbo SEMI JOIN front USING (session_date, contract)"),
    "unique_rows": (lambda s, d: filters.unique_by(_coarse(mbp1(s, d)), ["ts_recv", "sequence"]).select("ord"), f"{SQL}, {COARSE} SELECT ord FROM cq QUALIFY count(*) OVER (PARTITION BY ts_recv, sequence) = 1"),
}
