"""One named query per operator, over the event tables derived from the given ones.

Each takes ``(spark, sf_dir)`` and reads its tables whole. Exact numbers are shown as doubles.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tapewright.functions import values, vocab
from tapewright.operators import (
    balances,
    commands,
    gates,
    ingest,
    labels,
    orders,
    registry as reg,
    reports,
    signals,
)
from tapewright.plans import forwarding
from tapewright.session import run_dir, tune
from tapewright.sources import log as logs, tables
from tapewright.streaming.history import start_history
from tapewright.streaming.live import start_live
from tapewright.streaming.waiting import start_replies

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

POSITION_ON_LINE = ["seq.happened", "seq.line", "seq.part", "seq.supp"]

# Report requests of one strategy are hours apart in the click tables, so are their replies.
REPLY_WINDOW_SECONDS = 6 * 3600
SNAPSHOT_EVERY_MINUTES = 90 * 24 * 60
SAMPLE_EVERY = 10
THRESHOLD_BARS = 48
POLL_OFFSET_MINUTES = 2


def query(fn: Callable[[SparkSession, str], DataFrame]):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(tune(spark), sf_dir)

    QUERIES[fn.__name__] = run
    return fn


def doubles(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("double") for n in names})


def longs(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("bigint") for n in names})


# --- log and decoding ----------------------------------------------------------------------------


@query
def topic_filter(spark, d):
    return ingest.forwarded_topics(tables.ops_log(spark, d)).select("stream_key", "seq", "topic")


@query
def decode_events(spark, d):
    events = ingest.envelope(ingest.forwarded_topics(tables.ops_log(spark, d)))
    raw = F.when(F.col("decode_status") == "raw", F.col("body_raw"))
    return events.select("seq", "topic", "decode_status", "type", "event_type", "strategy_id", raw.alias("raw_text"))


@query
def stream_inventory(spark, d):
    return reports.stream_inventory(tables.ops_log(spark, d))


@query
def stream_discovery(spark, d):
    already_read = logs.external_streams(tables.announces(spark, d))
    return logs.discover_streams(tables.ops_log(spark, d), skip=already_read)


@query
def tail_cursor(spark, d):
    log = tables.ops_log(spark, d)
    seen = log.where(F.col("ts") < F.lit("2024-01-16").cast("timestamp_ntz"))
    return logs.read_after(log, logs.tail_cursors(seen)).select("stream_key", "seq")


@query
def incremental_announces(spark, d):
    announces = tables.announces(spark, d)
    seen = announces.where(F.col("ts") < F.lit("2024-01-16").cast("timestamp_ntz")).agg(F.max("seq")).first()[0]
    rows, _ = logs.read_announces(announces, cursor=logs.NO_CURSOR if seen is None else seen)
    return rows


@query
def retention_newest(spark, d):
    return logs.newest_entries(tables.announces(spark, d)).select("stream_key", "seq", "strategy_id")


@query
def retention_age(spark, d):
    return logs.recent_entries(tables.ops_log(spark, d)).select("stream_key", "seq", "ts")


@query
def type_exclusion(spark, d):
    return logs.without_types(tables.market_messages(spark, d))


@query
def stream_keys(spark, d):
    announces = tables.announces(spark, d)
    control = announces.where(F.col("strategy_id").isNotNull()).select(
        logs.control_stream_key(F.col("strategy_id")).alias("stream_key")
    )
    return logs.external_streams(announces).unionByName(control.distinct())


@query
def trader_ids(spark, d):
    return logs.trader_ids(tables.announces(spark, d))


@query
def noisy_keys(spark, d):
    events = ingest.without_noisy_keys(ingest.decode(tables.ops_log(spark, d)))
    names = F.array_join(F.sort_array(F.map_keys("fields")), ",")
    return events.where(F.col("fields").isNotNull()).select("seq", names.alias("field_names"))


@query
def custom_messages(spark, d):
    messages = labels.read_messages(ingest.decode(tables.message_log(spark, d)))
    return longs(messages.select("conv_id", "turn", "title", "text", "color"), "color")


@query
def safe_number(spark, d):
    parsed = tables.number_texts(spark, d).withColumn("parsed", values.safe_number("text"))
    kind = (
        F.when(F.col("parsed").isNull(), "none")
        .when(F.isnan("parsed"), "nan")
        .when(F.abs("parsed") == float("inf"), "infinite")
        .otherwise("number")
    )
    return parsed.select(
        "event_id", "text", kind.alias("kind"), F.when(kind == "number", F.col("parsed")).alias("number")
    )


# --- gates ---------------------------------------------------------------------------------------


@query
def event_type_gates(spark, d):
    events = ingest.envelope(ingest.forwarded_topics(tables.ops_log(spark, d)))
    return gates.type_gates(events.withColumn("state", gates.text_state())).select("seq", "topic", "type", "state")


# --- orders --------------------------------------------------------------------------------------


def _progress(spark, d) -> DataFrame:
    return orders.order_progress(tables.order_events(spark, d))


@query
def order_progress_running(spark, d):
    df = _progress(spark, d).select(
        "client_order_id",
        "type",
        F.col("seq.phase").cast("bigint").alias("phase"),
        *POSITION_ON_LINE,
        "qty_total",
        "qty_filled",
        "remainder",
        "pct",
        "vwap",
        "fill_count",
        "known_side",
        "known_type",
        "known_tif",
        "is_complete",
        "after_complete",
    )
    return longs(doubles(df, "qty_total", "qty_filled", "remainder"), "line", "fill_count")


@query
def completing_fills(spark, d):
    events = tables.order_events(spark, d)
    registry = reg.latest_registry(tables.announces(spark, d))
    fills = orders.completing_fills(orders.order_progress(events))
    return _fills_shown(reg.route(fills, registry, ids=events))


@query
def forwarded_fills(spark, d):
    """The same result from raw log entries: JSON payloads are decoded on the way."""
    log = tables.order_log(tables.order_events(spark, d))
    registry = reg.latest_registry(tables.announces(spark, d))
    return _fills_shown(forwarding.forwarded_fills(log, registry))


def _fills_shown(fills: DataFrame) -> DataFrame:
    df = fills.select(
        "client_order_id",
        *POSITION_ON_LINE,
        "qty_total",
        "qty_filled",
        "fill_count",
        "vwap",
        "known_side",
        "known_tif",
        "handle",
        "channel",
    )
    return longs(doubles(df, "qty_total", "qty_filled"), "line", "fill_count")


@query
def forwarded_log(spark, d):
    """The whole pipeline over the operations log and the order log together."""
    registry = reg.latest_registry(tables.announces(spark, d))
    events = forwarding.forwarded_events(tables.live_log(spark, d), registry)
    return forwarded_shown(events)


def forwarded_shown(events: DataFrame) -> DataFrame:
    df = events.select("seq", "topic", "event_type", "strategy_id", "client_order_id", "handle", "channel")
    return df


@query
def order_progress_final(spark, d):
    df = orders.final_progress(tables.order_events(spark, d)).select(
        "client_order_id",
        "qty_total",
        "qty_filled",
        "fill_count",
        "vwap",
        "pct",
        "remainder",
        "known_side",
        "known_type",
        "known_tif",
        "is_complete",
        "last_type",
    )
    return longs(doubles(df, "qty_total", "qty_filled", "remainder"), "fill_count")


@query
def order_remainder_on_cancel(spark, d):
    df = orders.canceled_remainders(_progress(spark, d)).select(
        "client_order_id", "qty_total", "qty_filled", "remainder", "pct", "side_shown", "known_type"
    )
    return doubles(df, "qty_total", "qty_filled", "remainder")


@query
def order_instructions(spark, d):
    sheet = tables.order_sheet(spark, d)
    # Orders of odd number state neither type nor time in force; what was known from before stands in.
    odd = F.col("o_orderkey") % 2 == 1
    sheet = sheet.select(
        "client_order_id",
        "post_only",
        "reduce_only",
        F.when(~odd, F.col("order_type")).alias("order_type"),
        F.when(~odd, F.col("time_in_force")).alias("time_in_force"),
        F.col("order_type").alias("known_type"),
        F.col("time_in_force").alias("known_tif"),
    )
    return sheet.select("client_order_id", F.array_join(orders.instruction(), " ").alias("instruction"))


@query
def option_prices(spark, d):
    return orders.option_prices(tables.order_sheet(spark, d)).select(
        "client_order_id", "limit_price", "trigger_price", "trigger_type"
    )


@query
def rejections(spark, d):
    df = orders.rejections(tables.order_sheet(spark, d))
    return df.select("reason", "strategy_id", "instrument_id", "side", "order_type", "quantity", "client_order_id", "type")


@query
def open_regular_orders(spark, d):
    return orders.open_regular_orders(tables.order_sheet(spark, d)).select("client_order_id", "side", "is_open", "is_emulated")


@query
def event_labels(spark, d):
    return labels.with_labels(tables.labelled(spark, d))


# --- registry and routing ------------------------------------------------------------------------


@query
def registry_latest(spark, d):
    return reg.latest_registry(tables.announces(spark, d))


@query
def registry_fallback(spark, d):
    return reg.with_fallback(reg.latest_registry(tables.announces(spark, d)), tables.ops_log(spark, d))


@query
def resolve_handle(spark, d):
    return reg.resolve_handles(tables.handle_users(spark, d), tables.handles(spark, d))


@query
def route_events(spark, d):
    events = ingest.envelope(ingest.forwarded_topics(tables.ops_log(spark, d)))
    registry = reg.latest_registry(tables.announces(spark, d))
    return reg.route(events, registry).select("seq", "topic", "strategy_id", "handle", "channel")


@query
def registry_intervals(spark, d):
    return reg.registry_intervals(tables.announces(spark, d))


@query
def route_events_asof(spark, d):
    """Each event by the mode its strategy had announced by then."""
    events = ingest.envelope(ingest.forwarded_topics(tables.ops_log(spark, d)))
    routed = reg.route_asof(events, tables.announces(spark, d))
    return routed.select("seq", "topic", "strategy_id", "handle", "channel")


@query
def channel_targets(spark, d):
    registry = reg.latest_registry(tables.announces(spark, d))
    parts = [
        reg.channel_targets(registry, c).select(F.lit(c).alias("channel"), "strategy_id") for c in tables.CHANNELS
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query
def fanout_targets(spark, d):
    return reg.fanout_targets(tables.announces(spark, d))


@query
def protocol_drift(spark, d):
    return reg.drift_warnings(tables.announces(spark, d), protocol="1", version="1.226.0")


# --- reports -------------------------------------------------------------------------------------


@query
def open_positions(spark, d):
    df = reports.open_positions(tables.position_states(spark, d))
    shown = reports.preferred_columns(df, vocab.POSITION_COLUMNS, ["position_id", "strategy_id"])
    return doubles(longs(shown, "quantity"), "realized_pnl", "unrealized_pnl")


@query
def orders_report(spark, d):
    return doubles(reports.orders_report(tables.order_events(spark, d)), "quantity", "filled_qty")


@query
def fills_report(spark, d):
    return doubles(reports.fills_report(tables.order_events(spark, d)).drop("seq"), "last_qty", "last_px")


@query
def report_preview(spark, d):
    fills = reports.fills_report(tables.order_events(spark, d))
    df = reports.preview(fills, [F.col("client_order_id"), F.col("seq")])
    shown = df.select("strategy_id", "client_order_id", *POSITION_ON_LINE, "position", "row_count", "remaining")
    return longs(shown, "line", "position", "remaining")


@query
def report_summary(spark, d):
    positions = reports.open_positions(tables.position_states(spark, d))
    return reports.report_summary(positions, reg.latest_registry(tables.announces(spark, d)))


@query
def account_pnl(spark, d):
    return doubles(reports.account_pnl(tables.position_states(spark, d)), *reports.PNL_KINDS)


@query
def daily_summary(spark, d):
    return reports.daily_summary(
        tables.position_states(spark, d), tables.order_events(spark, d), tables.ops_log(spark, d)
    )


def _whole_days(states: DataFrame) -> tuple[str, str]:
    day = F.date_trunc("day", F.min("ts")), F.date_trunc("day", F.max("ts")) + F.expr("interval 1 day")
    return tuple(states.agg(*[d.cast("string") for d in day]).first())


@query
def periodic_snapshot(spark, d):
    states = tables.position_states(spark, d)
    first, last = _whole_days(states)
    df = reports.periodic_snapshots(states, first, last, SNAPSHOT_EVERY_MINUTES)
    return longs(df.select("snapshot_ts", "position_id", "type", "side", "quantity"), "quantity")


# --- balances and commands -----------------------------------------------------------------------


@query
def balance_totals(spark, d):
    rebuilt = balances.rebuilt(balances.latest_totals(tables.account_events(spark, d)))
    return doubles(rebuilt, "total", "locked", "free")


@query
def balance_snapshot_parse(spark, d):
    return doubles(balances.parse_snapshots(tables.balance_snapshots(spark, d)), "amount")


@query
def top_balances(spark, d):
    shown = labels.shown_balances(tables.account_events(spark, d), n=2)
    currencies = F.array_join(F.transform("balances", lambda b: b["currency"]), ",")
    return shown.select("trader_id", "venue", "seq", currencies.alias("currencies"), "more")


@query
def command_audit(spark, d):
    parsed = commands.validate(commands.parse_actions(tables.commands(spark, d)))
    registry = reg.latest_registry(tables.announces(spark, d))
    return commands.authorize(parsed, registry).select(
        "seq", "strategy_id", "channel", "action", "status", "effective_mode", "verdict", "reason"
    )


@query
def report_reply_match(spark, d):
    return commands.match_replies(
        tables.report_requests(spark, d), tables.report_replies(spark, d), REPLY_WINDOW_SECONDS
    )


# --- signals -------------------------------------------------------------------------------------


@query
def spread_signal(spark, d):
    return doubles(signals.spread_signals(tables.quotes(spark, d)).select("instrument_id", "seq", "bps"), "bps")


@query
def tick_sample(spark, d):
    return signals.sampled_ticks(tables.quotes(spark, d), SAMPLE_EVERY).select("instrument_id", "seq", "tick")


@query
def hour_floor_dedup(spark, d):
    readings = tables.interest(spark, d)
    first = signals.monotonic_hours(readings).select(F.lit("first").alias("rule"), "instrument_id", "hour", "seq", "value")
    last = signals.last_per_hour(readings).select(F.lit("last").alias("rule"), "instrument_id", "hour", "seq", "value")
    return first.unionByName(last)


@query
def asof_poll(spark, d):
    readings = tables.interest(spark, d)
    return signals.poll_asof(signals.poll_grid(readings, POLL_OFFSET_MINUTES), readings)


@query
def hour_right_label(spark, d):
    return signals.hourly_bars(tables.interest(spark, d), order="seq")


def _grid(bars: DataFrame) -> DataFrame:
    return signals.threshold_grid(bars, threshold_bars=THRESHOLD_BARS)


@query
def oi_threshold(spark, d):
    grid = _grid(signals.hourly_bars(tables.interest(spark, d), order="seq"))
    return grid.select("instrument_id", "hour", "oi_delta", F.round("threshold", 6).alias("threshold"), "armed")


@query
def arm_flips(spark, d):
    readings = tables.interest(spark, d)
    full = _grid(signals.hourly_bars(readings, order="seq"))
    polled = _grid(signals.hourly_bars(signals.floored_polls(readings, POLL_OFFSET_MINUTES)))
    return signals.arm_flips(full, polled)


# --- streaming -----------------------------------------------------------------------------------


@query
def live_forwarding(spark, d):
    """The pipeline of ``forwarded_log`` as a stream. Here a completed order is forgotten at once."""
    path = run_dir(spark, "live")
    tables.live_log(spark, d).write.option("compression", "zstd").parquet(f"{path}/log")
    log = logs.stream_log(spark, f"{path}/log", schema=spark.read.parquet(f"{path}/log").schema)
    start_live(log, lambda: reg.latest_registry(tables.announces(spark, d)), f"{path}/out", available_now=True).awaitTermination()
    events = spark.read.parquet(f"{path}/out/events")
    return longs(
        doubles(
            events.select(
                "seq", "topic", "event_type", "strategy_id", "client_order_id", "handle", "channel",
                "qty_total", "qty_filled", "fill_count", "vwap",
            ),
            "qty_total",
            "qty_filled",
        ),
        "fill_count",
    )


@query
def live_replies(spark, d):
    """``report_reply_match`` as a stream: settled matches and those that later rows could change."""
    path = run_dir(spark, "replies")
    sides = {"asked": tables.report_requests(spark, d), "came": tables.report_replies(spark, d)}
    for name, side in sides.items():
        side.write.parquet(f"{path}/{name}")
    asked, came = (spark.readStream.schema(side.schema).parquet(f"{path}/{name}") for name, side in sides.items())
    running, waiting = start_replies(asked, came, f"{path}/out", seconds=REPLY_WINDOW_SECONDS, available_now=True)
    running.awaitTermination()
    return waiting.so_far().drop("settled")


@query
def live_snapshots(spark, d):
    """``periodic_snapshot`` from the history that a stream of position events leaves behind."""
    path = run_dir(spark, "history")
    states = tables.position_states(spark, d)
    states.write.parquet(f"{path}/events")
    first, last = _whole_days(states)
    events = spark.readStream.schema(states.schema).parquet(f"{path}/events")
    running, history = start_history(events, f"{path}/out", minutes=SNAPSHOT_EVERY_MINUTES, origin=first, available_now=True)
    running.awaitTermination()
    df = history.snapshots(first, last)
    return longs(df.select("snapshot_ts", "position_id", "type", "side", "quantity"), "quantity")
