"""Report requests that wait for their reply, matched batch by batch on one time line.

What may still change is kept between batches: requests without a settled answer, and replies that rows yet to come could
ask for. Both reach back no farther than the lateness and the time a request waits. A batch puts them on one line with what
is new and looks for the next reply of every request in one scan, so a busy strategy forms no pairs of requests and replies.
All folders follow from the number of the batch: a batch that runs again reads what it read before and replaces
what it wrote.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from tapewright.functions import vocab
from tapewright.operators.commands import match_replies
from tapewright.operators.skew import HOT_ROWS
from tapewright.session import shared_dir
from tapewright.streaming.states import delete, last_batch

LATENESS_SECONDS = 600
LINE = ["topic", "strategy_id", "seq", "ts"]
_MARK = "watermark bigint"


def _micros(column: str) -> Column:
    return F.unix_micros(F.col(column).cast("timestamp"))


class Waiting:
    """Requests and replies below ``path``; ``schema`` is that of ``LINE`` as SQL.

    A row older than the newest row of all earlier batches by more than ``lateness`` seconds is late: it goes to the ``late``
    folder and changes nothing. Other results are those of ``commands.match_replies`` over the whole log, in any cut of it. Requests
    without a time are never answered, replies without one answer nothing; rows without a topic or strategy belong together.
    """

    def __init__(
        self,
        spark: SparkSession,
        path: str,
        schema: str,
        seconds: int = vocab.REPLY_SECONDS,
        lateness: int = LATENESS_SECONDS,
        hot_rows: int = HOT_ROWS,
    ):
        self.spark, self.path, self.schema = spark, path, f"{schema}, is_reply boolean"
        self.seconds, self.lateness, self.hot_rows = int(seconds), int(lateness), hot_rows

    def _folder(self, kind: str, batch: int) -> str:
        return f"{self.path}/{kind}/batch_id={batch}"

    def _pending(self, batch: int) -> DataFrame:
        if batch < 0:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(self._folder("pending", batch))

    def _watermark(self, batch: int) -> int | None:
        return self.spark.read.schema(_MARK).parquet(self._folder("watermark", batch)).first()[0] if batch >= 0 else None

    def _matched(self, line: DataFrame) -> DataFrame:
        replies = line.where(F.col("is_reply") & F.col("ts").isNotNull())
        return match_replies(line.where(~F.col("is_reply")).select(*LINE), replies.select(*LINE), self.seconds, self.hot_rows)

    def step(self, batch: DataFrame, batch_id: int) -> None:
        """Take the rows of ``batch`` (``LINE`` and ``is_reply``) and write what is settled after it."""
        batch = batch.select(*LINE, "is_reply").checkpoint()
        before = self._watermark(batch_id - 1)
        newest = batch.agg(F.max(_micros("ts"))).first()[0]
        marks = [before, None if newest is None else newest - self.lateness * 1_000_000]
        after = max((m for m in marks if m is not None), default=None)
        late = F.lit(False) if before is None else F.coalesce(_micros("ts") < before, F.lit(False))
        batch.where(late).write.mode("overwrite").parquet(self._folder("late", batch_id))
        line = self._pending(batch_id - 1).unionByName(batch.where(~late))

        # Rows yet to come are not older than the watermark: they cannot answer earlier than a reply that is.
        passed = lambda micros: F.lit(False) if after is None else micros < after
        settled = F.when(F.col("answered"), passed(_micros("reply_ts"))).otherwise(passed(_micros("ts") + self.seconds * 1_000_000))
        found = self._matched(line).withColumn("_settled", F.coalesce(settled, F.lit(True))).checkpoint()
        found.where("_settled").drop("_settled").write.mode("overwrite").parquet(self._folder("settled", batch_id))
        open_requests = found.where("not _settled").select(*LINE, F.lit(False).alias("is_reply"))
        usable = line.where(F.col("is_reply") & ~passed(_micros("ts")) & F.col("ts").isNotNull())
        open_requests.unionByName(usable).write.mode("overwrite").parquet(self._folder("pending", batch_id))
        self.spark.range(1).select(F.lit(after).cast("bigint").alias("watermark")).write.mode("overwrite").parquet(self._folder("watermark", batch_id))
        # A batch that may run again reads the one before it; the one before that is read no more.
        for kind in ("pending", "watermark"):
            delete(self.spark, self._folder(kind, batch_id - 2))

    def so_far(self, last: int | None = None) -> DataFrame:
        """Every request up to batch ``last`` (the newest one) with its reply; ``settled`` tells whether it stays so."""
        last = last_batch(self.spark, f"{self.path}/watermark") if last is None else last
        now = self._matched(self._pending(last)).withColumn("settled", F.lit(False))
        if last < 0:
            return now
        done = self.spark.read.parquet(f"{self.path}/settled").where(F.col("batch_id") <= last).drop("batch_id")
        return done.withColumn("settled", F.lit(True)).unionByName(now)


def start_replies(
    requests: DataFrame,
    replies: DataFrame,
    path: str,
    *,
    seconds: int = vocab.REPLY_SECONDS,
    lateness: int = LATENESS_SECONDS,
    available_now: bool = False,
    every: str = "10 seconds",
) -> tuple[StreamingQuery, Waiting]:
    """Match two streams, ``LINE`` each, into ``path``, on storage that all executors reach."""
    spark = requests.sparkSession
    shared_dir(spark)
    schema = ", ".join(f"{c} {requests.schema[c].dataType.simpleString()}" for c in LINE)
    waiting = Waiting(spark, path, schema, seconds, lateness)
    both = requests.select(*LINE, F.lit(False).alias("is_reply")).unionByName(replies.select(*LINE, F.lit(True).alias("is_reply")))
    writer = both.writeStream.foreachBatch(waiting.step).option("checkpointLocation", f"{path}/checkpoint")
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=every)
    return writer.start(), waiting
