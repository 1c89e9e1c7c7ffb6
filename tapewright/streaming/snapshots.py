"""Open positions, written again at every tick of a timer."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from tapewright.functions import vocab
from tapewright.operators.reports import open_positions


def start_snapshots(
    events: DataFrame,
    path: str,
    *,
    minutes: int = vocab.SNAPSHOT_MINUTES,
    enabled: bool = True,
    available_now: bool = False,
) -> StreamingQuery | None:
    """Write the open positions of a stream of position events to ``path`` every ``minutes``.

    The state is the last event of each position; a tick that is written again replaces itself.
    """
    if not enabled:
        return None

    def write(snapshot: DataFrame, tick: int) -> None:
        at = snapshot.withColumn("snapshot_ts", F.current_timestamp())
        at.write.mode("overwrite").parquet(f"{path}/snapshots/tick={tick}")

    writer = open_positions(events).writeStream.outputMode("complete").foreachBatch(write)
    writer = writer.option("checkpointLocation", f"{path}/checkpoint")
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=f"{minutes} minutes")
    return writer.start()
