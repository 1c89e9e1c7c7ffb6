"""Position, order, fill, PnL, balance and daily reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tapewright.functions import vocab
from tapewright.operators.orders import final_progress
from tapewright.operators.skew import top_per_key


def latest_positions(events: DataFrame, as_of: Column | None = None) -> DataFrame:
    """Last known state of every position, up to ``as_of`` if given."""
    if as_of is not None:
        events = events.where(F.col("ts") <= as_of)
    state = [c for c in events.columns if c not in ("position_id", "seq")]
    last = events.groupBy("position_id").agg(F.max_by(F.struct(*state), "seq").alias("last"))
    return last.select("position_id", "last.*")


def open_positions(events: DataFrame, as_of: Column | None = None) -> DataFrame:
    """Positions that are open now; those closed since are not listed."""
    return latest_positions(events, as_of).where(F.col("type") != "PositionClosed")


def preferred_columns(df: DataFrame, wanted: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """The wanted columns that exist, in the wanted order, behind the identifying ones."""
    return df.select(*keep, *[c for c in wanted if c in df.columns and c not in keep])


def order_status() -> Column:
    filled = F.col("qty_filled").cast("double")
    return (
        F.when((filled > 0) & F.col("qty_total").isNotNull() & F.col("is_complete"), "FILLED")
        .when(F.col("last_type") == "OrderCanceled", "CANCELED")
        .when(F.col("last_type").isin(*vocab.REJECTION_EVENTS), "REJECTED")
        .when(F.col("last_type") == "OrderExpired", "EXPIRED")
        .when(filled > 0, "PARTIALLY_FILLED")
        .otherwise("ACCEPTED")
    )


def orders_report(events: DataFrame) -> DataFrame:
    """One row per order, open and closed."""
    report = final_progress(events).select(
        "client_order_id",
        "strategy_id",
        "instrument_id",
        F.col("known_side").alias("side"),
        F.col("known_type").alias("type"),
        F.col("qty_total").alias("quantity"),
        F.col("qty_filled").alias("filled_qty"),
        F.col("vwap").alias("avg_px"),
        order_status().alias("status"),
    )
    return preferred_columns(report, vocab.ORDER_COLUMNS, ["client_order_id", "strategy_id"])


def fills_report(events: DataFrame) -> DataFrame:
    """One row per fill, over all orders."""
    fills = events.where(F.col("type") == "OrderFilled").withColumn("ts_event", F.col("ts"))
    return preferred_columns(fills, vocab.FILL_COLUMNS, ["client_order_id", "strategy_id", "seq"])


def preview(report: DataFrame, order: Sequence[Column], n: int = vocab.PREVIEW_ROWS) -> DataFrame:
    """First rows of each strategy's report in the given order, with the number of rows left out."""
    shown = top_per_key(report, ["strategy_id"], order, n, rank="position")
    counts = report.groupBy("strategy_id").agg(F.count(F.lit(1)).alias("row_count"))
    return shown.join(counts, "strategy_id").withColumn("remaining", F.greatest(F.col("row_count") - n, F.lit(0)))


def report_summary(report: DataFrame, registry: DataFrame) -> DataFrame:
    """Row count per known strategy; a strategy without rows has zero."""
    counts = report.groupBy("strategy_id").agg(F.count(F.lit(1)).alias("row_count"))
    joined = registry.select("strategy_id").join(counts, "strategy_id", "left")
    return joined.select("strategy_id", F.coalesce("row_count", F.lit(0)).alias("row_count"))


PNL_KINDS = ["realized", "unrealized", "net_exposure"]


def account_pnl(positions: DataFrame) -> DataFrame:
    """Realized and unrealized PnL and net exposure per venue and currency.

    A position's realized PnL is a running total that starts anew once it is closed: it counts as of each closing and,
    for positions still open, as of their latest state. The other two count the latest state of open positions.
    """
    latest = latest_positions(positions).where(F.col("type") != "PositionClosed")
    closed = positions.where(F.col("type") == "PositionClosed")
    totals = closed.select("venue", "currency", "realized_pnl").unionByName(latest.select("venue", "currency", "realized_pnl"))
    realized = totals.groupBy("venue", "currency").agg(F.sum("realized_pnl").alias("amount"))
    current = latest.groupBy("venue", "currency").agg(
        F.sum("unrealized_pnl").alias("unrealized"), F.sum("exposure").alias("net_exposure")
    )
    current = current.unpivot(["venue", "currency"], ["unrealized", "net_exposure"], "kind", "amount")
    long = realized.withColumn("kind", F.lit("realized")).unionByName(current)
    return long.groupBy("venue", "currency").pivot("kind", PNL_KINDS).agg(F.sum("amount"))


def account_pnl_map(pnl: DataFrame) -> DataFrame:
    """The same as one nested map per venue: kind -> currency -> amount. One entry per currency of a venue."""

    def by_currency(kind: str) -> Column:
        known = F.when(F.col(kind).isNotNull(), F.struct("currency", F.col(kind).cast("string")))
        return F.map_from_entries(F.collect_list(known))

    return pnl.groupBy("venue").agg(
        F.create_map(*[x for k in PNL_KINDS for x in (F.lit(k), by_currency(k))]).alias("account_pnl")
    )


def daily_summary(positions: DataFrame, orders: DataFrame, log: DataFrame, as_of: Column | None = None) -> DataFrame:
    """One row of counts: open and closed positions, open orders, streams seen."""
    if as_of is not None:
        orders, log = orders.where(F.col("ts") <= as_of), log.where(F.col("ts") <= as_of)
    is_closed = F.col("type") == "PositionClosed"
    by_state = latest_positions(positions, as_of).groupBy(is_closed.alias("closed")).agg(F.count(F.lit(1)).alias("n"))
    done = ["FILLED", "CANCELED", "REJECTED", "EXPIRED"]
    open_orders = orders_report(orders).where(~F.col("status").isin(*done)).agg(F.count(F.lit(1)).alias("n"))
    streams = log.agg(F.count_distinct("stream_key").alias("n"))
    counts = (
        by_state.select(F.when(F.col("closed"), "positions_closed").otherwise("positions_open").alias("metric"), "n")
        .unionByName(open_orders.select(F.lit("orders_open").alias("metric"), "n"))
        .unionByName(streams.select(F.lit("streams_seen").alias("metric"), "n"))
    )
    metrics = ["positions_open", "positions_closed", "orders_open", "streams_seen"]
    return counts.agg(
        *[F.coalesce(F.sum(F.when(F.col("metric") == m, F.col("n"))), F.lit(0)).alias(m) for m in metrics]
    )


STREAM_PATTERNS = ("trader-%:stream", "trader-%:stream:events.%", "trader-%:stream:data.Signal%", "ops:control:%")


def stream_inventory(log: DataFrame, contains: str | None = None) -> DataFrame:
    """Entries per stream key, for event streams (aggregate or per topic), signal streams and control streams."""
    wanted = F.lit(False)
    for pattern in STREAM_PATTERNS:
        wanted = wanted | F.col("stream_key").like(pattern)
    df = log.where(wanted)
    if contains:
        df = df.where(F.col("stream_key").contains(contains))
    return df.groupBy("stream_key").agg(F.count(F.lit(1)).alias("entries")).orderBy("stream_key")


def periodic_snapshots(events: DataFrame, start: str, end: str, minutes: int = vocab.SNAPSHOT_MINUTES) -> DataFrame:
    """Open positions at every tick between ``start`` and ``end``, ``minutes`` apart.

    Only the last state of a position before a tick matters, so states are first reduced to one per position
    and tick. Each then holds from its tick up to the next state's; no join with the ticks is needed.
    """
    step = int(minutes) * 60
    first, last = (F.unix_seconds(F.lit(t).cast("timestamp")) for t in (start, end))
    seconds = F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1_000_000)
    # Number of the first tick at or after the event; tick 0 takes all that happened before the start.
    tick = F.greatest(F.ceil((seconds - first) / step), F.lit(0)).cast("bigint")
    state = [c for c in events.columns if c not in ("position_id", "seq")]
    per_tick = (
        events.withColumn("_tick", tick)
        .groupBy("position_id", "_tick")
        .agg(F.max_by(F.struct(*state), "seq").alias("last"))
    )
    follow = F.lead("_tick").over(W.partitionBy("position_id").orderBy("_tick"))
    final = F.floor((last - first) / step)
    held = per_tick.withColumn("_until", F.coalesce(follow - 1, final)).withColumn("_until", F.least("_until", final))
    held = held.where((F.col("_until") >= F.col("_tick")) & (F.col("last.type") != "PositionClosed"))
    ticks = held.withColumn("_at", F.explode(F.sequence("_tick", "_until")))
    at = F.timestamp_seconds(first + F.col("_at") * step).cast("timestamp_ntz")
    return ticks.select(at.alias("snapshot_ts"), "position_id", "last.*")
