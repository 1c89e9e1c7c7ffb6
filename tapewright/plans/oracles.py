"""DuckDB SQL for the queries of the catalog, written from the definitions rather than from the Spark code."""

from __future__ import annotations

from tapewright.plans import catalog

CLICKS = "clicks AS (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)"


def _nth(names, index: str) -> str:
    items = ", ".join(f"'{n}'" for n in names)
    return f"([{items}])[CAST(({index}) % {len(names)} AS INTEGER) + 1]"


def _double(number: str) -> str:
    """The double nearest to a decimal: by way of its text, as a cast divides and rounds twice."""
    return f"CAST(CAST({number} AS VARCHAR) AS DOUBLE)"


_STATES = (
    "PRE_INITIALIZED", "READY", "RUNNING", "STOPPED", "DEGRADED",
    "FAULTED", "DISPOSED", "STARTING", "HIBERNATING", "STOPPING",
)
_ORDER_TYPES = (
    "OrderInitialized", "OrderSubmitted", "OrderAccepted", "OrderPendingUpdate", "OrderPendingCancel",
    "OrderReleased", "OrderEmulated", "OrderFilled", "OrderRejected", "OrderSplit",
)
_POSITION_TYPES = ("PositionOpened", "PositionChanged", "PositionClosed", "AccountState", "Signal")

OPS = (
    CLICKS
    + f""",
ops AS (
  SELECT event_id AS seq, ts, user_id, k, k % 10 AS m,
    CASE event_type
      WHEN 'purchase' THEN 'trader-T' || user_id || ':stream'
      WHEN 'view' THEN 'trader-T' || user_id || ':stream:events.position.V1'
      WHEN 'error' THEN 'trader-T' || user_id || ':stream:data.SignalSpread'
      WHEN 'signup' THEN 'ops:control:S' || user_id
      ELSE 'trader-T' || user_id || ':instruments:I' || (k % 5) END AS stream_key,
    CASE event_type
      WHEN 'purchase' THEN 'events.order.V1' WHEN 'view' THEN 'events.position.V1'
      WHEN 'error' THEN 'events.system.C1' WHEN 'signup' THEN 'ops.announce' ELSE 'data.quotes.V1' END AS topic,
    CASE event_type
      WHEN 'purchase' THEN {_nth(_ORDER_TYPES, "k // 10")}
      WHEN 'view' THEN {_nth(_POSITION_TYPES, "k // 10")}
      WHEN 'error' THEN 'ComponentStateChanged' WHEN 'signup' THEN 'Announced' ELSE 'QuoteTick' END AS stated,
    {_nth(_STATES, "k // 10")} AS named
  FROM clicks),
decoded AS (
  SELECT seq, ts, stream_key, topic, k,
    CASE m WHEN 0 THEN 'null' WHEN 1 THEN 'raw' ELSE 'json' END AS decode_status,
    CASE WHEN m < 3 THEN NULL WHEN m = 3 THEN '' ELSE stated END AS type,
    CASE WHEN m < 4 THEN list_extract(string_split(topic, '.'), -1) ELSE stated END AS event_type,
    CASE WHEN m = 3 OR m >= 6 THEN 'Cls-S' || user_id END AS strategy_id,
    CASE WHEN m >= 5 THEN named END AS state,
    CASE WHEN m = 1 THEN 'note ' || k END AS raw_text
  FROM ops),
forwarded AS (SELECT * FROM decoded WHERE topic <> 'data.quotes.V1'),
gated AS (
  SELECT * FROM forwarded
  WHERE NOT (coalesce(type, '') = 'ComponentStateChanged' AND coalesce(state, '') IN
      ('PRE_INITIALIZED', 'READY', 'DISPOSED', 'STARTING', 'STOPPING'))
    AND coalesce(type, '') NOT IN ('OrderInitialized', 'OrderSubmitted', 'OrderAccepted', 'OrderPendingUpdate',
      'OrderPendingCancel', 'OrderReleased', 'OrderEmulated', 'PositionChanged', 'AccountState'))"""
)

ANNOUNCES = (
    CLICKS
    + """,
announces AS (
  SELECT event_id AS seq, ts,
    CASE WHEN k % 50 <> 49 THEN 'S' || user_id END AS strategy_id,
    CASE WHEN k % 25 = 0 THEN NULL WHEN k % 7 = 0 THEN 'paper' WHEN k % 2 = 0 THEN 'live' ELSE 'sandbox' END AS mode,
    CASE WHEN k % 10 <> 9 THEN 'T' || (user_id % 40) END AS trader_id,
    CASE WHEN k % 4 = 0 THEN '1.226.0' WHEN k % 4 <> 3 THEN '1.227.0' END AS engine_version,
    CASE WHEN k % 3 = 2 THEN NULL WHEN k % 6 = 0 THEN '2' ELSE '1' END AS protocol_version
  FROM clicks WHERE event_type = 'signup'),
registry AS (
  SELECT strategy_id, arg_max(mode, seq) AS mode FROM announces
  WHERE strategy_id IS NOT NULL AND mode IS NOT NULL GROUP BY strategy_id)"""
)
OPS_ANNOUNCES = OPS + ANNOUNCES[len(CLICKS) :]

# Event ids here are 'Cls-' plus a handle without hyphens, so resolving them means cutting that prefix off.
ROUTED_OPS = """
routed AS (
  SELECT e.seq, e.topic, e.strategy_id,
    CASE WHEN e.strategy_id IS NULL THEN NULL WHEN r.strategy_id IS NULL THEN e.strategy_id ELSE r.strategy_id END AS handle,
    CASE WHEN e.topic LIKE 'ops.%' OR e.strategy_id IS NULL THEN 'logging'
         WHEN r.mode = 'live' THEN 'live' ELSE 'sandbox' END AS channel, e.event_type
  FROM {source} e LEFT JOIN registry r ON e.strategy_id = 'Cls-' || r.strategy_id)"""

ORDER_EVENTS = """
ev AS (
  SELECT o_orderkey AS k, 0 AS phase, o_orderdate AS happened, 0 AS line, 0 AS part, 0 AS supp, 'OrderInitialized' AS type,
    CASE WHEN o_orderkey % 2 = 0 THEN 'BUY' ELSE 'SELL' END AS side,
    CASE o_orderpriority WHEN '1-URGENT' THEN 'MARKET' WHEN '2-HIGH' THEN 'LIMIT' WHEN '3-MEDIUM' THEN 'STOP_MARKET'
      ELSE 'STOP_LIMIT' END AS order_type,
    CASE o_orderpriority WHEN '1-URGENT' THEN 'IOC' WHEN '5-LOW' THEN 'DAY' ELSE 'GTC' END AS tif,
    CASE WHEN o_orderkey % 40 = 3 THEN CAST(CAST(2 + o_orderkey % 10 * 2 AS HUGEINT) * 1000000000000000000000000 AS DECIMAL(38,11))
      ELSE CAST(20 + (o_orderkey % 10) * 20 AS DECIMAL(38,11)) END AS quantity, NULL AS last_qty, NULL AS last_px, NULL AS commission
  FROM orders
  UNION ALL
  SELECT l_orderkey, 1, l_shipdate, l_linenumber, l_partkey, l_suppkey, 'OrderFilled',
    CASE WHEN l_orderkey % 2 = 0 THEN 'BUY' ELSE 'SELL' END, NULL, NULL, NULL,
    CASE WHEN l_orderkey % 40 = 3 AND l_linenumber < 3
        THEN CAST(CAST(l_quantity AS HUGEINT) * CASE l_linenumber WHEN 1 THEN 1000000000000000000000000 ELSE 1000000000000000000 END AS DECIMAL(38,11))
      WHEN l_orderkey % 40 = 3 AND l_linenumber = 3 THEN CAST(l_quantity AS DECIMAL(14,0)) * 0.00000000001
      ELSE CAST(l_quantity AS DECIMAL(38,11)) END,
    CASE WHEN NOT (l_orderkey % 40 = 3 AND l_linenumber = 3) THEN CAST(l_extendedprice / l_quantity AS DECIMAL(28,8)) END,
    l_extendedprice * l_tax
  FROM lineitem
  UNION ALL
  SELECT o_orderkey, 2, o_orderdate, 0, 0, 0, 'OrderCanceled', NULL, NULL, NULL, NULL, NULL, NULL, NULL
  FROM orders WHERE o_orderstatus = 'F'),
paid AS (
  SELECT *, 'O' || k AS client_order_id, 'Cls-S' || (k % 200) AS strategy_id,
    'I' || (k % 50) || '.V' || (k % 5) AS instrument_id,
    CASE WHEN product < 1e16 THEN CAST(product AS DECIMAL(38,8)) ELSE CAST(CAST(product AS HUGEINT) AS DECIMAL(38,8)) END AS paid
  FROM (SELECT *, CAST(CAST(last_qty AS VARCHAR) AS DOUBLE) * CAST(last_px AS DOUBLE) AS product FROM ev))"""

RUNNING = (
    ORDER_EVENTS
    + f""",
run AS (
  SELECT *,
    last_value(quantity IGNORE NULLS) OVER w AS qty_total,
    coalesce(sum(last_qty) OVER w, 0) AS qty_filled,
    count(last_qty) OVER w AS fill_count,
    coalesce(sum(paid) OVER w, 0) AS notional,
    first_value(side IGNORE NULLS) OVER w AS known_side,
    first_value(order_type IGNORE NULLS) OVER w AS known_type,
    last_value(tif IGNORE NULLS) OVER w AS known_tif
  FROM paid
  WINDOW w AS (PARTITION BY client_order_id ORDER BY phase, happened, line, part, supp
               ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
progress AS (
  SELECT *, {_double("qty_total")} AS total, {_double("qty_filled")} AS filled,
    {_double("notional")} / nullif({_double("qty_filled")}, 0) AS vwap,
    {_double("qty_filled")} / nullif({_double("qty_total")}, 0) * 100 AS pct,
    qty_total IS NULL OR qty_filled >= qty_total AS is_complete,
    type = 'OrderFilled' AND fill_count > 1 AND coalesce(qty_filled - last_qty >= qty_total, false) AS after_complete
  FROM run)"""
)

FINAL = (
    ORDER_EVENTS
    + f""",
final AS (
  SELECT client_order_id, max(strategy_id) AS strategy_id, max(instrument_id) AS instrument_id,
    max(quantity) AS total, coalesce(sum(last_qty), 0) AS filled,
    {_double("max(quantity)")} AS qty_total, {_double("coalesce(sum(last_qty), 0)")} AS qty_filled,
    count(last_qty) AS fill_count,
    {_double("coalesce(sum(paid), 0)")} / nullif({_double("sum(last_qty)")}, 0) AS vwap,
    max(side) AS known_side, max(order_type) AS known_type, max(tif) AS known_tif,
    arg_max(type, phase) AS last_type
  FROM paid GROUP BY client_order_id)"""
)

# The ids of orders are 'Cls-S<n>'; only the handle 'S<n>' can fit.
ROUTED_FILLS = """
SELECT p.client_order_id, p.happened, CAST(p.line AS BIGINT) AS line, CAST(p.part AS BIGINT) AS part,
  CAST(p.supp AS BIGINT) AS supp, p.total AS qty_total, p.filled AS qty_filled, p.fill_count, p.vwap, p.known_side,
  p.known_tif, coalesce(r.strategy_id, p.strategy_id) AS handle,
  CASE WHEN r.mode = 'live' THEN 'live' ELSE 'sandbox' END AS channel
FROM progress p LEFT JOIN registry r ON p.strategy_id = 'Cls-' || r.strategy_id
WHERE p.type = 'OrderFilled' AND p.is_complete"""

SEQ_TEXT = (
    "phase || '-' || strftime(happened, '%Y%m%d%H%M%S') || '-' || lpad(CAST(line AS VARCHAR), 3, '0') || '-' || "
    "lpad(CAST(part AS VARCHAR), 15, '0') || '-' || lpad(CAST(supp AS VARCHAR), 15, '0')"
)

SHEET = """
sheet AS (
  SELECT o_orderkey AS k, 'O' || o_orderkey AS client_order_id, 'Cls-S' || (o_orderkey % 200) AS strategy_id,
    'I' || (o_orderkey % 50) || '.V' || (o_orderkey % 5) AS instrument_id,
    CASE WHEN o_orderkey % 2 = 0 THEN 'BUY' ELSE 'SELL' END AS side,
    CASE o_orderpriority WHEN '1-URGENT' THEN 'MARKET' WHEN '2-HIGH' THEN 'LIMIT' WHEN '3-MEDIUM' THEN 'STOP_MARKET'
      ELSE 'STOP_LIMIT' END AS order_type,
    CASE o_orderpriority WHEN '1-URGENT' THEN 'IOC' WHEN '5-LOW' THEN 'DAY' ELSE 'GTC' END AS tif,
    CAST(20 + (o_orderkey % 10) * 20 AS VARCHAR) AS quantity,
    CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) AS price_text, o_orderpriority AS priority, o_orderstatus AS status
  FROM orders)"""

POSITIONS = """
states AS (
  SELECT 'P' || o_custkey AS position_id, o_custkey AS c, o_orderdate AS happened, o_orderkey AS k, o_totalprice AS price,
    o_orderstatus = 'F' AS closed,
    CASE o_orderstatus WHEN 'F' THEN 'PositionClosed' WHEN 'O' THEN 'PositionOpened' ELSE 'PositionChanged' END AS type,
    'S' || (o_custkey % 200) AS strategy_id, 'I' || (o_custkey % 50) || '.V' || (o_custkey % 5) AS instrument_id,
    'V' || (o_custkey % 5) AS venue, CASE WHEN o_custkey % 2 = 0 THEN 'USDT' ELSE 'BTC' END AS currency,
    CASE WHEN o_orderstatus = 'F' THEN 'FLAT' WHEN o_orderkey % 2 = 0 THEN 'LONG' ELSE 'SHORT' END AS side,
    20 + (o_orderkey % 10) * 20 AS quantity, CAST(o_totalprice / 100 AS DECIMAL(18,4)) AS pnl,
    row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS age
  FROM orders)"""

INTEREST = "interest AS (SELECT 'I' || user_id AS instrument_id, event_id AS seq, ts, value FROM events)"
HOURS = (
    INTEREST
    + """,
floored AS (SELECT *, date_trunc('hour', ts) AS hour FROM interest)"""
)
POLLS = (
    INTEREST
    + f""",
span AS (
  SELECT instrument_id, date_trunc('hour', min(ts)) + INTERVAL {catalog.POLL_OFFSET_MINUTES} MINUTE AS a, max(ts) AS b
  FROM interest GROUP BY instrument_id),
polls AS (SELECT instrument_id, unnest(generate_series(a, b, INTERVAL 1 HOUR)) AS ts FROM span),
polled AS (
  SELECT p.instrument_id, p.ts, i.value FROM polls p
  ASOF LEFT JOIN interest i ON p.instrument_id = i.instrument_id AND p.ts >= i.ts)"""
)


def _bars(source: str, name: str) -> str:
    return f"""{name} AS (
  SELECT instrument_id, CASE WHEN ts = date_trunc('hour', ts) THEN ts ELSE date_trunc('hour', ts) + INTERVAL 1 HOUR END
    AS hour, arg_max(value, ts) AS value
  FROM {source} GROUP BY 1, 2)"""


def _grid(bars: str, name: str) -> str:
    n = catalog.THRESHOLD_BARS
    return f"""{name}_d AS (
  SELECT *, value - lag(value, 3) OVER (PARTITION BY instrument_id ORDER BY hour) AS oi_delta FROM {bars}),
{name}_t AS (
  SELECT *, CASE WHEN count(oi_delta) OVER w >= {n} THEN quantile_cont(oi_delta, 0.98) OVER w END AS threshold
  FROM {name}_d
  WINDOW w AS (PARTITION BY instrument_id ORDER BY hour ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)),
{name} AS (SELECT *, coalesce(oi_delta >= threshold, false) AS armed FROM {name}_t)"""


# After the first completing fill the order is forgotten: later fills count from zero, of an unknown total.
FORGETTING = (
    RUNNING
    + """,
closed AS (
  SELECT *, coalesce(sum(CASE WHEN type = 'OrderFilled' AND qty_total IS NOT NULL AND is_complete THEN 1 ELSE 0 END) OVER
    (PARTITION BY client_order_id ORDER BY phase, happened, line, part, supp ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
    0) > 0 AS anew
  FROM progress),
lived AS (
  SELECT phase, happened, line, part, supp, type, strategy_id, client_order_id,
    CASE WHEN NOT anew THEN total END AS qty_total, coalesce(sum(last_qty) OVER v, 0) AS filled,
    count(last_qty) OVER v AS fill_count, coalesce(sum(paid) OVER v, 0) AS notional, anew OR is_complete AS is_complete
  FROM closed
  WINDOW v AS (PARTITION BY client_order_id, anew ORDER BY phase, happened, line, part, supp
               ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""
)


ORACLES: dict[str, str] = {
    "topic_filter": f"WITH {OPS} SELECT stream_key, seq, topic FROM forwarded",
    "decode_events": f"""WITH {OPS}
SELECT seq, topic, decode_status, type, event_type, strategy_id, raw_text FROM forwarded""",
    "stream_inventory": f"""WITH {OPS}
SELECT stream_key, count(*) AS entries FROM ops WHERE stream_key NOT LIKE '%:instruments:%' GROUP BY 1""",
    "stream_discovery": f"""WITH {OPS_ANNOUNCES}
SELECT DISTINCT stream_key FROM ops WHERE stream_key LIKE 'trader-%' AND stream_key LIKE '%:stream'
  AND stream_key NOT IN (SELECT 'trader-' || trader_id || ':stream' FROM announces WHERE trader_id IS NOT NULL)""",
    "tail_cursor": f"""WITH {OPS},
tails AS (SELECT stream_key, max(seq) AS c FROM ops WHERE ts < TIMESTAMP '2024-01-16' GROUP BY 1)
SELECT o.stream_key, o.seq FROM ops o LEFT JOIN tails t USING (stream_key) WHERE o.seq > coalesce(t.c, -1)""",
    "incremental_announces": f"""WITH {ANNOUNCES}
SELECT seq, strategy_id, mode, coalesce(engine_version, '') AS engine_version,
  coalesce(protocol_version, '') AS protocol_version
FROM announces WHERE strategy_id IS NOT NULL AND mode IS NOT NULL
  AND seq > coalesce((SELECT max(seq) FROM announces WHERE ts < TIMESTAMP '2024-01-16'), -1)""",
    "retention_newest": f"""WITH {ANNOUNCES}
SELECT 'ops:announce' AS stream_key, seq, strategy_id FROM announces ORDER BY seq DESC LIMIT 1000""",
    "retention_age": f"""WITH {OPS}
SELECT stream_key, seq, ts FROM ops
QUALIFY ts >= max(ts) OVER (PARTITION BY stream_key) - INTERVAL 60 MINUTE""",
    "type_exclusion": """SELECT event_id, ts, CASE event_type WHEN 'purchase' THEN 'QuoteTick' WHEN 'signup' THEN 'TradeTick' END AS type
FROM events WHERE event_type IN ('purchase', 'view', 'signup')""",
    "stream_keys": f"""WITH {ANNOUNCES}
SELECT DISTINCT 'trader-' || trader_id || ':stream' AS stream_key FROM announces WHERE trader_id IS NOT NULL
UNION ALL SELECT DISTINCT 'ops:control:' || strategy_id FROM announces WHERE strategy_id IS NOT NULL""",
    "trader_ids": f"WITH {ANNOUNCES} SELECT DISTINCT trader_id FROM announces WHERE trader_id IS NOT NULL",
    "noisy_keys": f"""WITH {OPS}
SELECT seq, CASE WHEN m = 3 THEN 'strategy_id,type' ELSE 'state,strategy_id,type' END AS field_names FROM ops WHERE m >= 3""",
    "custom_messages": """
SELECT conv_id, turn, CASE WHEN turn % 4 <> 3 AND turn % 2 = 0 THEN role ELSE 'Notice' END AS title,
  CASE WHEN turn % 4 = 3 THEN 'note: ' || text ELSE text END AS text,
  CAST(CASE WHEN turn % 4 <> 3 AND turn % 3 = 0 THEN 255 END AS BIGINT) AS color
FROM conversations""",
    "safe_number": f"""WITH {CLICKS}
SELECT event_id, CASE k % 12 WHEN 0 THEN k || '_000' WHEN 1 THEN k || '__000' WHEN 2 THEN '  ' || k || ' '
    WHEN 3 THEN k || 'e3' WHEN 4 THEN 'nan' WHEN 5 THEN '-inf' WHEN 6 THEN 'x' || k WHEN 7 THEN ''
    WHEN 8 THEN k || '.0f' WHEN 9 THEN '0x' || k WHEN 10 THEN k || '.25' ELSE '-.' || k END AS text,
  CASE WHEN k % 12 IN (1, 6, 7, 8, 9) THEN 'none' WHEN k % 12 = 4 THEN 'nan' WHEN k % 12 = 5 THEN 'infinite'
    ELSE 'number' END AS kind,
  CASE k % 12 WHEN 0 THEN k * 1000.0 WHEN 2 THEN k * 1.0 WHEN 3 THEN k * 1000.0 WHEN 10 THEN CAST(k || '.25' AS DOUBLE)
    WHEN 11 THEN CAST('-0.' || k AS DOUBLE) END::DOUBLE AS number
FROM clicks""",
    "event_type_gates": f"WITH {OPS} SELECT seq, topic, type, state FROM gated",
    "order_progress_running": f"""WITH {RUNNING}
SELECT client_order_id, type, CAST(phase AS BIGINT) AS phase, happened, CAST(line AS BIGINT) AS line, CAST(part AS BIGINT) AS part,
  CAST(supp AS BIGINT) AS supp, total AS qty_total, filled AS qty_filled, {_double("qty_total - qty_filled")} AS remainder,
  pct, vwap, fill_count, known_side, known_type, known_tif, is_complete, after_complete
FROM progress""",
    "completing_fills": f"WITH {RUNNING}, {ANNOUNCES} {ROUTED_FILLS}",
    "forwarded_fills": f"WITH {RUNNING}, {ANNOUNCES} {ROUTED_FILLS}",
    "forwarded_log": f"""WITH {RUNNING}, {OPS_ANNOUNCES}, {ROUTED_OPS.format(source="gated")}
SELECT {SEQ_TEXT} AS seq, 'events.order.V1' AS topic, p.type AS event_type, p.strategy_id, p.client_order_id,
  coalesce(r.strategy_id, p.strategy_id) AS handle, CASE WHEN r.mode = 'live' THEN 'live' ELSE 'sandbox' END AS channel
FROM progress p LEFT JOIN registry r ON p.strategy_id = 'Cls-' || r.strategy_id
WHERE p.type = 'OrderCanceled' OR (p.type = 'OrderFilled' AND p.is_complete)
UNION ALL
SELECT lpad(CAST(seq AS VARCHAR), 20, '0'), topic, event_type, strategy_id, NULL, handle, channel FROM routed""",
    "live_forwarding": f"""WITH {FORGETTING}, {OPS_ANNOUNCES}, {ROUTED_OPS.format(source="gated")}
SELECT {SEQ_TEXT} AS seq, 'events.order.V1' AS topic, p.type AS event_type, p.strategy_id, p.client_order_id,
  coalesce(r.strategy_id, p.strategy_id) AS handle, CASE WHEN r.mode = 'live' THEN 'live' ELSE 'sandbox' END AS channel,
  p.qty_total, {_double("p.filled")} AS qty_filled, p.fill_count,
  {_double("p.notional")} / nullif({_double("p.filled")}, 0) AS vwap
FROM lived p LEFT JOIN registry r ON p.strategy_id = 'Cls-' || r.strategy_id
WHERE p.type = 'OrderCanceled' OR (p.type = 'OrderFilled' AND p.is_complete)
UNION ALL
SELECT lpad(CAST(seq AS VARCHAR), 20, '0'), topic, event_type, strategy_id, NULL, handle, channel, NULL, NULL, NULL, NULL
FROM routed""",
    "order_progress_final": f"""WITH {FINAL}
SELECT client_order_id, qty_total, qty_filled, fill_count, vwap, qty_filled / nullif(qty_total, 0) * 100 AS pct,
  {_double("total - filled")} AS remainder, known_side, known_type, known_tif,
  total IS NULL OR filled >= total AS is_complete, last_type
FROM final""",
    "order_remainder_on_cancel": f"""WITH {RUNNING}
SELECT client_order_id, total AS qty_total, filled AS qty_filled, {_double("qty_total - qty_filled")} AS remainder, pct,
  known_side AS side_shown, known_type FROM progress WHERE type = 'OrderCanceled'""",
    "order_instructions": f"""WITH {SHEET}
SELECT client_order_id, order_type || ' ' || tif || CASE WHEN k % 3 = 0 THEN ' post_only' ELSE '' END
  || CASE WHEN k % 4 = 0 THEN ' reduce_only' ELSE '' END AS instruction FROM sheet""",
    "option_prices": f"""WITH {SHEET}
SELECT client_order_id, CASE WHEN k % 7 = 2 THEN '0' WHEN k % 7 = 0 OR priority = '2-HIGH' THEN price_text END AS limit_price,
  CASE WHEN priority = '3-MEDIUM' THEN price_text END AS trigger_price,
  CASE WHEN priority = '3-MEDIUM' THEN 'LAST_PRICE' END AS trigger_type FROM sheet""",
    "rejections": f"""WITH {SHEET}
SELECT 'REFUSED_' || priority AS reason, strategy_id, instrument_id, side, order_type, quantity, client_order_id,
  CASE WHEN k % 2 = 0 THEN 'OrderDenied' ELSE 'OrderRejected' END AS type FROM sheet WHERE priority = '1-URGENT'""",
    "open_regular_orders": f"""WITH {SHEET}
SELECT client_order_id, side, true AS is_open, false AS is_emulated FROM sheet WHERE status <> 'F' AND k % 5 <> 0""",
    "event_labels": f"""WITH {CLICKS},
seen AS (
  SELECT event_id,
    {_nth(("OrderFilled", "OrderCanceled", "OrderDenied", "PositionOpened", "PositionClosed", "Signal", "OrderSplit"), "k")} AS type,
    {_nth(("BUY", "SELL", "LONG", "SHORT", "FLAT", "ODD"), "k")} AS side, {_nth(_STATES, "k")} AS state
  FROM clicks)
SELECT *,
  CASE type WHEN 'OrderFilled' THEN 'Order filled' WHEN 'OrderCanceled' THEN 'Order canceled' WHEN 'OrderDenied' THEN 'Order denied'
    WHEN 'PositionOpened' THEN 'Position opened' WHEN 'PositionClosed' THEN 'Position closed' WHEN 'Signal' THEN 'Signal'
    ELSE 'Order split' END AS title,
  upper(side[1]) || lower(side[2:]) AS side_label,
  CASE type WHEN 'OrderDenied' THEN 'error' WHEN 'OrderCanceled' THEN 'warning' ELSE 'info' END AS severity,
  CASE WHEN state = 'FAULTED' THEN 'error' WHEN state IN ('STOPPED', 'DEGRADED', 'DISPOSED', 'STOPPING') THEN 'warning'
    ELSE 'info' END AS state_severity
FROM seen""",
    "registry_latest": f"WITH {ANNOUNCES} SELECT * FROM registry",
    "registry_fallback": f"""WITH {ANNOUNCES}
SELECT strategy_id, mode FROM registry
UNION ALL SELECT DISTINCT 'S' || user_id, 'sandbox' FROM clicks WHERE event_type = 'signup'
  AND 'S' || user_id NOT IN (SELECT strategy_id FROM registry)""",
    "resolve_handle": """WITH reg AS (
  SELECT n_name AS h, CASE WHEN n_nationkey % 2 = 0 THEN 'live' ELSE 'sandbox' END AS mode FROM nation
  UNION ALL SELECT 'X-' || n_name, CASE WHEN n_nationkey % 2 = 0 THEN 'sandbox' ELSE 'live' END FROM nation
  WHERE n_nationkey % 3 = 0),
ids AS (
  SELECT DISTINCT 'C' || (c_custkey % 1000) || '-' || CASE c_custkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'X-'
    WHEN 2 THEN 'Y-Z-' ELSE 'X' END || 'NATION_' || c_nationkey AS strategy_id FROM customer)
SELECT strategy_id, coalesce(arg_max(h, length(h)), strategy_id) AS handle, arg_max(mode, length(h)) AS mode
FROM ids LEFT JOIN reg ON strategy_id = h OR ends_with(strategy_id, '-' || h) GROUP BY strategy_id""",
    "route_events": f"""WITH {OPS_ANNOUNCES}, {ROUTED_OPS.format(source="forwarded")}
SELECT seq, topic, strategy_id, handle, channel FROM routed""",
    "registry_intervals": f"""WITH {ANNOUNCES},
told AS (
  SELECT strategy_id, mode, seq, lag(mode) OVER (PARTITION BY strategy_id ORDER BY seq) AS earlier
  FROM announces WHERE strategy_id IS NOT NULL AND mode IS NOT NULL)
SELECT strategy_id, mode, seq AS from_seq, lead(seq) OVER (PARTITION BY strategy_id ORDER BY seq) AS to_seq
FROM told WHERE mode IS DISTINCT FROM earlier""",
    "route_events_asof": f"""WITH {OPS_ANNOUNCES},
told AS (SELECT strategy_id, mode, seq FROM announces WHERE strategy_id IS NOT NULL AND mode IS NOT NULL)
SELECT e.seq, e.topic, e.strategy_id, coalesce(r.strategy_id, e.strategy_id) AS handle,
  CASE WHEN e.topic LIKE 'ops.%' OR e.strategy_id IS NULL THEN 'logging'
       WHEN r.mode = 'live' THEN 'live' ELSE 'sandbox' END AS channel
FROM forwarded e ASOF LEFT JOIN told r ON e.strategy_id = 'Cls-' || r.strategy_id AND e.seq >= r.seq""",
    "channel_targets": f"""WITH {ANNOUNCES}
SELECT mode AS channel, strategy_id FROM registry WHERE mode IN ('live', 'sandbox')
UNION ALL SELECT 'logging', strategy_id FROM registry""",
    "fanout_targets": f"""WITH {ANNOUNCES}
SELECT strategy_id, max(seq) AS last_seq FROM announces WHERE strategy_id IS NOT NULL GROUP BY 1""",
    "protocol_drift": f"""WITH {ANNOUNCES}
SELECT DISTINCT strategy_id, coalesce(protocol_version, '') AS seen_protocol, '1' AS expected_protocol,
  coalesce(engine_version, '') AS seen_version, '1.226.0' AS expected_version
FROM announces WHERE strategy_id IS NOT NULL AND mode IS NOT NULL
  AND (coalesce(protocol_version, '') <> '1' OR coalesce(engine_version, '') <> '1.226.0')""",
    "open_positions": f"""WITH {POSITIONS}
SELECT position_id, strategy_id, instrument_id, side, quantity, price AS avg_px_open, CAST(NULL AS DOUBLE) AS avg_px_close,
  0.0::DOUBLE AS realized_pnl, CAST(pnl AS DOUBLE) AS unrealized_pnl FROM states WHERE age = 1 AND NOT closed""",
    "orders_report": f"""WITH {FINAL}
SELECT client_order_id, strategy_id, instrument_id, known_side AS side, known_type AS type, qty_total AS quantity,
  qty_filled AS filled_qty, vwap AS avg_px,
  CASE WHEN filled > 0 AND filled >= total THEN 'FILLED' WHEN last_type = 'OrderCanceled' THEN 'CANCELED'
    WHEN qty_filled > 0 THEN 'PARTIALLY_FILLED' ELSE 'ACCEPTED' END AS status FROM final""",
    "fills_report": f"""WITH {ORDER_EVENTS}
SELECT client_order_id, strategy_id, instrument_id, side AS order_side, {_double("last_qty")} AS last_qty,
  CAST(last_px AS DOUBLE) AS last_px, commission, happened AS ts_event FROM paid WHERE type = 'OrderFilled'""",
    "report_preview": f"""WITH {ORDER_EVENTS}
SELECT strategy_id, client_order_id, happened, CAST(line AS BIGINT) AS line, CAST(part AS BIGINT) AS part, CAST(supp AS BIGINT) AS supp,
  row_number() OVER (PARTITION BY strategy_id ORDER BY client_order_id, happened, line, part, supp) AS position,
  count(*) OVER (PARTITION BY strategy_id) AS row_count,
  greatest(count(*) OVER (PARTITION BY strategy_id) - 12, 0) AS remaining
FROM paid WHERE type = 'OrderFilled' QUALIFY position <= 12""",
    "report_summary": f"""WITH {POSITIONS}, {ANNOUNCES}
SELECT r.strategy_id, count(s.position_id) AS row_count FROM registry r
LEFT JOIN (SELECT * FROM states WHERE age = 1 AND NOT closed) s USING (strategy_id) GROUP BY 1""",
    "account_pnl": f"""WITH {POSITIONS}
SELECT venue, currency, CAST(sum(CASE WHEN closed THEN pnl ELSE 0 END) AS DOUBLE) AS realized,
  CAST(sum(CASE WHEN age = 1 AND NOT closed THEN pnl END) AS DOUBLE) AS unrealized,
  CAST(sum(CASE WHEN age = 1 AND NOT closed THEN CAST(price AS DECIMAL(18,2)) END) AS DOUBLE) AS net_exposure
FROM states GROUP BY 1, 2""",
    "daily_summary": f"""WITH {POSITIONS}, {OPS}, {FINAL}
SELECT (SELECT count(*) FROM states WHERE age = 1 AND NOT closed) AS positions_open,
  (SELECT count(*) FROM states WHERE age = 1 AND closed) AS positions_closed,
  (SELECT count(*) FROM final WHERE last_type <> 'OrderCanceled' AND NOT (filled > 0 AND filled >= total)) AS orders_open,
  (SELECT count(DISTINCT stream_key) FROM ops) AS streams_seen""",
    "periodic_snapshot": f"""WITH {POSITIONS},
span AS (SELECT CAST(date_trunc('day', min(happened)) AS TIMESTAMP) AS a, date_trunc('day', max(happened)) + INTERVAL 1 DAY AS b FROM states),
ticks AS (SELECT unnest(generate_series(a, CAST(b AS TIMESTAMP), INTERVAL {catalog.SNAPSHOT_EVERY_MINUTES} MINUTE)) AS snapshot_ts FROM span)
SELECT snapshot_ts, position_id, type, side, quantity FROM ticks JOIN states ON happened <= snapshot_ts
QUALIFY row_number() OVER (PARTITION BY snapshot_ts, position_id ORDER BY happened DESC, k DESC) = 1 AND NOT closed""",
    "balance_totals": """WITH entries AS (
  SELECT 'T' || (c_custkey % 40) AS trader_id, c_mktsegment AS venue, c_custkey AS seq, currency,
    CAST(c_acctbal * factor AS DECIMAL(18,2)) AS total
  FROM customer, (VALUES ('USDT', 1), ('BTC', 2), ('ETH', 3)) AS f(currency, factor))
SELECT trader_id, venue, currency, CAST(arg_max(total, seq) AS DOUBLE) AS total, 0.0::DOUBLE AS locked,
  CAST(arg_max(total, seq) AS DOUBLE) AS free FROM entries GROUP BY 1, 2, 3""",
    "balance_snapshot_parse": """WITH good AS (SELECT * FROM customer WHERE c_custkey % 10 <> 0 AND c_custkey % 17 <> 3)
SELECT 'T' || c_custkey AS trader_id, c_mktsegment AS venue, 'USDT' AS currency,
  CAST(CAST(CASE WHEN c_custkey % 7 = 0 THEN c_acctbal * 2 ELSE c_acctbal END AS DECIMAL(18,2)) AS DOUBLE) AS amount FROM good
UNION ALL
SELECT 'T' || c_custkey, c_mktsegment, 'BTC', CAST(CAST(c_acctbal * 3 AS DECIMAL(18,2)) AS DOUBLE)
FROM good WHERE c_custkey % 7 <> 0""",
    "top_balances": """SELECT 'T' || (c_custkey % 40) AS trader_id, c_mktsegment AS venue, c_custkey AS seq,
  'USDT,BTC' AS currencies, CAST(1 AS BIGINT) AS more FROM customer""",
    "command_audit": f"""WITH {ANNOUNCES},
sent AS (
  SELECT event_id AS seq, 'S' || user_id AS strategy_id, k,
    {_nth(("pause", "resume", "flatten", "ping", "report", "fills", "orders", "explode"), "k")} AS a,
    {_nth(("live", "sandbox", "logging"), "k")} AS channel
  FROM clicks WHERE event_type = 'click'),
parsed AS (
  SELECT *, CASE k % 11 WHEN 10 THEN '{{broken ' || k WHEN 8 THEN NULL ELSE a END AS action FROM sent),
judged AS (
  SELECT p.*, CASE WHEN r.mode = 'live' THEN 'live' ELSE 'sandbox' END AS effective_mode,
    CASE WHEN action IS NULL THEN 'malformed'
      WHEN action NOT IN ('pause', 'resume', 'flatten', 'ping', 'report', 'fills', 'orders') THEN 'unknown_action'
      WHEN action = 'ping' THEN 'ack' WHEN k % 13 = 0 THEN 'no_strategy' ELSE 'accepted' END AS status
  FROM parsed p LEFT JOIN registry r USING (strategy_id))
SELECT seq, strategy_id, channel, action, status, effective_mode,
  CASE WHEN channel = 'logging' OR channel <> effective_mode THEN 'rejected' ELSE 'ok' END AS verdict,
  CASE WHEN channel = 'logging' THEN 'logging is read-only; use sandbox or live'
    WHEN channel <> effective_mode THEN strategy_id || ' is ' || effective_mode || ', sent from ' || channel END AS reason
FROM judged""",
    "report_reply_match": f"""WITH {CLICKS},
sides AS (
  SELECT event_type, 'S' || user_id AS strategy_id, event_id AS seq, ts,
    {_nth(("ops.report.positions", "ops.report.fills", "ops.report.orders"), "k")} AS topic
  FROM clicks WHERE event_type IN ('click', 'view'))
SELECT q.topic, q.strategy_id, q.seq, q.ts, arg_min(r.seq, r.ts) AS reply_seq, min(r.ts) AS reply_ts,
  count(r.seq) > 0 AS answered
FROM sides q LEFT JOIN sides r ON r.event_type = 'view' AND r.topic = q.topic AND r.strategy_id = q.strategy_id
  AND r.ts >= q.ts AND r.ts <= q.ts + INTERVAL {catalog.REPLY_WINDOW_SECONDS} SECOND
WHERE q.event_type = 'click' GROUP BY 1, 2, 3, 4""",
    "spread_signal": f"""WITH {CLICKS},
wide AS (
  SELECT 'I' || user_id AS instrument_id, event_id AS seq, k % 10 AS step,
    lag(k % 10) OVER (PARTITION BY user_id ORDER BY event_id) AS before
  FROM clicks WHERE k % 10 > 1)
SELECT instrument_id, seq, CAST(CAST(step * 20000.0 / (4000 + step) AS DECIMAL(28,10)) AS DOUBLE) AS bps
FROM wide WHERE before IS NULL OR before <> step""",
    "tick_sample": f"""
SELECT 'I' || user_id AS instrument_id, event_id AS seq, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS tick
FROM events QUALIFY tick % {catalog.SAMPLE_EVERY} = 0""",
    "hour_floor_dedup": f"""WITH {HOURS}
SELECT 'first' AS rule, instrument_id, hour, seq, value FROM (
  SELECT *, max(hour) OVER (PARTITION BY instrument_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top
  FROM floored) WHERE top IS NULL OR hour > top
UNION ALL SELECT 'last', instrument_id, hour, max(seq), arg_max(value, seq) FROM floored GROUP BY 2, 3""",
    "asof_poll": f"WITH {POLLS} SELECT instrument_id, ts, value FROM polled",
    "hour_right_label": f"WITH {INTEREST}, {_bars('interest', 'bars')} SELECT * FROM bars",
    "oi_threshold": f"""WITH {INTEREST}, {_bars('interest', 'bars')}, {_grid('bars', 'grid')}
SELECT instrument_id, hour, oi_delta, round(threshold, 6) AS threshold, armed FROM grid""",
    "arm_flips": f"""WITH {POLLS},
live AS (SELECT instrument_id, date_trunc('hour', ts) AS ts, arg_max(value, ts) AS value FROM polled
  WHERE value IS NOT NULL GROUP BY 1, 2),
{_bars('interest', 'bars_a')}, {_grid('bars_a', 'grid_a')}, {_bars('live', 'bars_b')}, {_grid('bars_b', 'grid_b')}
SELECT a.instrument_id, CAST(sum(CAST(a.armed <> b.armed AS INTEGER)) AS BIGINT) AS flips, count(*) AS hours
FROM grid_a a JOIN grid_b b ON a.instrument_id = b.instrument_id AND a.hour = b.hour GROUP BY 1""",
}

# Streams give what their batch forms give.
ORACLES["live_replies"] = ORACLES["report_reply_match"]
ORACLES["live_snapshots"] = ORACLES["periodic_snapshot"]
