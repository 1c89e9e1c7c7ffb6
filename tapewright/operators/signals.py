"""Spread signals on quotes and the hourly open-interest threshold."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tapewright.functions import values, vocab
from tapewright.operators.asof import asof_join
from tapewright.operators.frames import moving_quantile
from tapewright.operators.skew import HOT_ROWS, Track, running

INSTRUMENT = ["instrument_id"]
# Bars of an instrument that one task holds at once, besides the frame before them.
BLOCK_BARS = 8192


def spread_signals(
    quotes: DataFrame, threshold_bps: float = vocab.SPREAD_THRESHOLD_BPS, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Quotes at which the spread is above the threshold and differs from the last one signalled."""
    wide = quotes.withColumn("bps", values.spread_bps("bid", "ask"))
    wide = wide.where(F.col("bps") > F.lit(str(threshold_bps)).cast("decimal(20,10)"))
    # Among the wide quotes the predecessor always carries the value last signalled.
    tracks = {"_last": Track("last", F.col("bps"))}
    seen = running(wide, INSTRUMENT, ["seq"], tracks, exclusive=True, hot_rows=hot_rows)
    return seen.where(F.col("_last").isNull() | (F.col("_last") != F.col("bps"))).drop("_last")


def sampled_ticks(quotes: DataFrame, every: int = vocab.SAMPLE_EVERY, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Every n-th quote of an instrument with its number."""
    tracks = {"tick": Track("count", F.lit(1))}
    numbered = running(quotes, INSTRUMENT, ["seq"], tracks, hot_rows=hot_rows)
    return numbered.where(F.col("tick") % every == 0)


def _per_hour(readings: DataFrame, pick: str) -> DataFrame:
    """One reading per instrument and hour of its timestamp: the first or last to arrive."""
    chosen = getattr(F, pick)(F.struct("seq", "ts", "value"), "seq")
    hours = readings.groupBy(*INSTRUMENT, values.floor_hour("ts").alias("hour")).agg(chosen.alias("_r"))
    return hours.select(*INSTRUMENT, "hour", "_r.*")


def monotonic_hours(readings: DataFrame) -> DataFrame:
    """Readings floored to the hour; one that does not move the hour forward in arrival order is dropped.

    Only the first arrival of an hour can be kept, so the readings shrink to one per hour before the scan.
    """
    first = _per_hour(readings, "min_by")
    earlier = W.partitionBy(*INSTRUMENT).orderBy("seq").rowsBetween(W.unboundedPreceding, -1)
    passed = F.max("hour").over(earlier)
    return first.withColumn("_passed", passed).where(F.col("_passed").isNull() | (F.col("hour") > F.col("_passed"))).drop("_passed")


def last_per_hour(readings: DataFrame) -> DataFrame:
    """Readings floored to the hour, the last one of each hour kept."""
    return _per_hour(readings, "max_by")


def poll_asof(
    polls: DataFrame, readings: DataFrame, by: Sequence[str] = INSTRUMENT, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """For every poll the value current at that time; polls before the first reading have none."""
    values_ = readings.select(*by, "ts", "seq", "value")
    return asof_join(polls, values_, by, take=["value"], hot_rows=hot_rows)


def poll_grid(readings: DataFrame, offset_minutes: float) -> DataFrame:
    """Hourly poll times per instrument: its first hour plus the offset, then every hour up to its last reading."""
    span = readings.groupBy(*INSTRUMENT).agg(F.min("ts").alias("_from"), F.max("ts").alias("_to"))
    offset = F.make_dt_interval(secs=F.lit(float(offset_minutes) * 60))
    start = values.floor_hour("_from") + offset
    times = F.when(start <= F.col("_to"), F.sequence(start, F.col("_to"), F.expr("interval 1 hour")))
    return span.select(*INSTRUMENT, F.explode(times).alias("ts"))


def floored_polls(readings: DataFrame, offset_minutes: float, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Hourly polls of the current value, stamped with their hour; of two in one hour the later stays."""
    polled = poll_asof(poll_grid(readings, offset_minutes), readings, hot_rows=hot_rows)
    polled = polled.where(F.col("value").isNotNull())
    hours = polled.groupBy(*INSTRUMENT, values.floor_hour("ts").alias("hour")).agg(F.max_by("value", "ts").alias("value"))
    return hours.select(*INSTRUMENT, F.col("hour").alias("ts"), "value")


def hourly_bars(readings: DataFrame, order: str = "ts") -> DataFrame:
    """Last value of every hour, labelled with the end of the hour."""
    bars = readings.groupBy(*INSTRUMENT, values.right_labelled_hour("ts").alias("hour"))
    return bars.agg(F.max_by("value", F.col(order) if order == "ts" else F.struct("ts", order)).alias("value"))


def threshold_grid(
    bars: DataFrame,
    delta_bars: int = vocab.OI_DELTA_BARS,
    threshold_bars: int = vocab.OI_THRESHOLD_BARS,
    percentile: float = vocab.OI_PERCENTILE,
) -> DataFrame:
    """Change over ``delta_bars`` bars, its rolling percentile, and whether the change reaches it.

    The threshold is unknown until the last ``threshold_bars`` changes are all there; NaN counts as missing. An
    instrument's bars are cut into blocks, each with the frame before it. A task takes its blocks in order, in Arrow
    batches, and answers all frames of a batch at once (``frames.moving_quantile``).
    """
    w = W.partitionBy(*INSTRUMENT).orderBy("hour")
    deltas = bars.withColumn("oi_delta", F.col("value") - F.lag("value", delta_bars).over(w))
    size = max(BLOCK_BARS, threshold_bars)
    number = F.row_number().over(w) - 1
    block = F.floor(F.col("_n") / size)
    tail = F.col("_n") % size > size - threshold_bars
    blocks = F.when(tail, F.array(block, block + 1)).otherwise(F.array(block))
    dealt = deltas.withColumn("_n", number).select("*", F.explode(blocks).alias("_block"))

    keys = [*INSTRUMENT, "_block"]
    lined = dealt.repartition(*keys).sortWithinPartitions(*keys, "_n")
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in lined.schema.fields)
    found = lined.mapInArrow(
        lambda batches: moving_quantile(batches, keys, "oi_delta", threshold_bars, percentile), f"{columns}, threshold double"
    )
    # A block's frame of earlier rows belongs to the block before.
    df = found.where(F.floor(F.col("_n") / size) == F.col("_block")).drop("_n", "_block")
    return df.withColumn("armed", armed("oi_delta", "threshold"))


def armed(delta: Column | str, threshold: Column | str) -> Column:
    delta, threshold = (F.col(c) if isinstance(c, str) else c for c in (delta, threshold))
    return F.coalesce((delta >= threshold) & ~F.isnan(threshold), F.lit(False))


def arm_flips(one: DataFrame, other: DataFrame) -> DataFrame:
    """Per instrument: hours both grids have, and how many of them are armed in only one."""
    left = one.select(*INSTRUMENT, "hour", F.col("armed").alias("_a"))
    right = other.select(*INSTRUMENT, "hour", F.col("armed").alias("_b"))
    both = left.join(right, [*INSTRUMENT, "hour"])
    return both.groupBy(*INSTRUMENT).agg(
        F.sum((F.col("_a") != F.col("_b")).cast("bigint")).alias("flips"), F.count(F.lit(1)).alias("hours")
    )
