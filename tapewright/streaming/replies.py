"""Matching report requests with replies while both are still arriving."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tapewright.functions import vocab

LATENESS = "10 minutes"


def match_replies_stream(requests: DataFrame, replies: DataFrame, seconds: int = vocab.REPLY_SECONDS) -> DataFrame:
    """First reply of each request within ``seconds``, or none once the watermark has passed that time."""
    asked = requests.withWatermark("ts", LATENESS)
    came = replies.select(
        F.col("topic").alias("_topic"),
        F.col("strategy_id").alias("_strategy"),
        F.col("seq").alias("reply_seq"),
        F.col("ts").alias("reply_ts"),
    ).withWatermark("reply_ts", LATENESS)
    fits = (
        (F.col("topic") == F.col("_topic"))
        & (F.col("strategy_id") == F.col("_strategy"))
        & (F.col("reply_ts") >= F.col("ts"))
        & (F.col("reply_ts") <= F.col("ts") + F.expr(f"interval {int(seconds)} seconds"))
    )
    pairs = asked.join(came, fits, "left_outer")
    first = F.min(F.struct("reply_ts", "reply_seq"))
    return (
        pairs.groupBy("topic", "strategy_id", "seq", "ts")
        .agg(first.alias("_first"))
        .select(
            "topic",
            "strategy_id",
            "seq",
            "ts",
            "_first.reply_seq",
            "_first.reply_ts",
            F.col("_first.reply_seq").isNotNull().alias("answered"),
        )
    )
