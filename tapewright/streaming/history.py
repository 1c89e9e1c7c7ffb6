"""Positions through time, from a stream of their events: who held what at which tick, also at ticks without any event.

A batch turns its events into states that hold from one tick to another. States that were followed by another one are
finished and written once; the last one of every position is carried on, with no end yet. A snapshot at any tick is read
from both, so a timer needs no input to tick, and no tick is stored that nobody asks for. All folders follow from the number
of the batch: a batch that runs again reads what it read before and replaces what it wrote.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from tapewright.functions import vocab
from tapewright.operators.skew import HOT_ROWS, Track, running
from tapewright.session import shared_dir
from tapewright.streaming.states import delete, last_batch

KEY = "position_id"
CLOSED = "PositionClosed"
#: For this many ticks a closed position's last entry number is kept, so that a row older than it is late in any cut of the stream.
CLOSED_TICKS = 336
ORIGIN = "1970-01-01"

_TIE, _FROM = "_tie", "_reached"


class History:
    """Intervals of position states below ``path``; ``schema`` is that of the events (``position_id seq ts type`` and others).

    Ticks are ``minutes`` apart, counted from ``origin``; a state counts from the first tick at or after its time, and of several
    of one tick that with the largest entry number. A row that is not newer, by entry number, than the state its position had before
    the batch is late: it goes to the ``late`` folder and changes nothing. Rows without a time, a position or an entry
    number are late, too. A state never takes effect before the one it follows by entry number, so a log that comes in order
    has one history in any cut. Of several rows with one entry number and time one is taken, by its hash.
    """

    def __init__(
        self,
        spark: SparkSession,
        path: str,
        schema: StructType,
        minutes: int = vocab.SNAPSHOT_MINUTES,
        origin: str = ORIGIN,
        hot_rows: int = HOT_ROWS,
    ):
        self.spark, self.path, self.schema, self.hot_rows = spark, path, schema, hot_rows
        self.micros, self.origin = int(minutes) * 60_000_000, origin
        self.carried = StructType([*schema.fields]).add("from_tick", "long")
        self.held = StructType([*self.carried.fields]).add("until_tick", "long")

    def _folder(self, kind: str, batch: int) -> str:
        return f"{self.path}/{kind}/batch_id={batch}"

    def _tick(self, time: Column) -> Column:
        """Number of the first tick at or after a time."""
        passed = F.unix_micros(time.cast("timestamp")) - F.unix_micros(F.lit(self.origin).cast("timestamp"))
        return -F.floor(-passed / F.lit(self.micros)).cast("bigint")

    def _open(self, batch: int) -> DataFrame:
        if batch < 0:
            return self.spark.createDataFrame([], self.carried)
        return self.spark.read.schema(self.carried).parquet(self._folder("open", batch))

    def step(self, batch: DataFrame, batch_id: int) -> None:
        """Take the events of a batch."""
        batch = batch.select(*self.schema.names)
        before = self._open(batch_id - 1)
        known = before.select(KEY, F.col("seq").alias("_last"))
        late = F.coalesce(F.col("seq") <= F.col("_last"), F.lit(False)) | F.col(KEY).isNull() | F.col("seq").isNull() | F.col("ts").isNull()
        marked = batch.join(known, KEY, "left").withColumn("_late", late).checkpoint()
        marked.where("_late").select(*batch.columns).write.mode("overwrite").parquet(self._folder("late", batch_id))

        fresh = marked.where("not _late").withColumn("from_tick", self._tick(F.col("ts")))
        line = before.unionByName(fresh.select(*self.carried.names))
        rest = [c for c in self.schema.names if c != KEY]
        line = line.withColumn(_TIE, F.xxhash64(*rest))
        placed = running(line, [KEY], ["seq", _TIE], {_FROM: Track("max", F.col("from_tick"))}, hot_rows=self.hot_rows)
        newest = F.max_by(F.struct(*rest), F.struct("seq", _TIE))
        # Of the states of a tick all but one fall away before any shuffle; the window below sees one row a position and tick.
        states = placed.groupBy(KEY, F.col(_FROM).alias("from_tick")).agg(newest.alias("s")).select(KEY, "s.*", "from_tick")
        ends = F.lead("from_tick").over(W.partitionBy(KEY).orderBy("from_tick")) - 1
        states = states.withColumn("until_tick", ends).checkpoint()

        done = states.where(F.col("until_tick").isNotNull() & ~self._closed())
        done.select(*self.held.names).write.mode("overwrite").parquet(self._folder("held", batch_id))
        last = states.where("until_tick is null").select(*self.carried.names)
        latest = states.agg(F.max("from_tick")).first()[0]
        kept = ~self._closed() | (F.col("from_tick") >= F.lit(0 if latest is None else latest - CLOSED_TICKS))
        last.where(kept).write.mode("overwrite").parquet(self._folder("open", batch_id))
        # A batch that may run again reads the one before it; the one before that is read no more.
        delete(self.spark, self._folder("open", batch_id - 2))

    @staticmethod
    def _closed() -> Column:
        return F.coalesce(F.col("type") == CLOSED, F.lit(False))

    def intervals(self, last: int | None = None) -> DataFrame:
        """Every state up to batch ``last`` (the newest one) with its first and last tick, NULL for those that still hold."""
        last = last_batch(self.spark, f"{self.path}/open") if last is None else last
        done = self.spark.createDataFrame([], self.held)
        if last >= 0:
            stored = self.spark.read.schema(StructType([*self.held.fields]).add("batch_id", "integer")).parquet(f"{self.path}/held")
            done = stored.where(F.col("batch_id") <= last).drop("batch_id")
        now = self._open(last).where(~self._closed()).withColumn("until_tick", F.lit(None).cast("bigint"))
        return done.unionByName(now)

    def snapshots(self, start: str, end: str, last: int | None = None) -> DataFrame:
        """Open positions at every tick between two times."""
        first, final = self._tick(F.lit(start).cast("timestamp")), self._tick(F.lit(end).cast("timestamp") + F.expr("interval 1 microsecond")) - 1
        a, b = F.greatest("from_tick", first), F.least(F.coalesce("until_tick", final), final)
        at = F.timestamp_micros(F.unix_micros(F.lit(self.origin).cast("timestamp")) + F.col("_tick") * self.micros)
        ticks = self.intervals(last).where(a <= b).withColumn("_tick", F.explode(F.sequence(a, b)))
        return ticks.select(at.cast("timestamp_ntz").alias("snapshot_ts"), *self.schema.names)


def start_history(
    events: DataFrame,
    path: str,
    *,
    minutes: int = vocab.SNAPSHOT_MINUTES,
    origin: str = ORIGIN,
    available_now: bool = False,
    every: str = "1 minute",
) -> tuple[StreamingQuery, History]:
    """Keep the history of a stream of position events below ``path``, on storage that all executors reach."""
    shared_dir(events.sparkSession)
    history = History(events.sparkSession, path, events.schema, minutes, origin)
    writer = events.writeStream.foreachBatch(history.step).option("checkpointLocation", f"{path}/checkpoint")
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=every)
    return writer.start(), history
