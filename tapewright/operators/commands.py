"""Control commands: parsing, validation, authorization, and matching report requests with replies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tapewright.functions import vocab
from tapewright.operators import ingest
from tapewright.operators.asof import asof_join
from tapewright.operators.skew import HOT_ROWS


def command_topic(strategy_id: Column | str, action: Column | str) -> Column:
    return F.concat_ws(".", F.lit(vocab.COMMAND_TOPIC_PREFIX), strategy_id, action)


def parse_actions(log: DataFrame) -> DataFrame:
    """Add ``action``: the field of an object, or the text itself (JSON text or plain), trimmed.

    NULL means malformed: a missing payload, a list or number, or an object without an action. Text that only
    looks like an object is taken as it stands and will not be a known action.
    """
    decoded = ingest.decode(log)
    is_text = F.schema_of_variant("body") == "STRING"
    action = (
        F.when(F.col("decode_status") == "raw", F.trim("body_raw"))
        .when(ingest.is_object(), ingest.field("$.action"))
        .when(is_text, F.trim(ingest.field("$")))
    )
    return decoded.withColumn("action", action).drop("body", "body_raw", "decode_status")


def validate(commands: DataFrame) -> DataFrame:
    """Add ``status``. A ping is answered even where no strategy is loaded; other actions need one."""
    known = F.col("action").isin(*vocab.COMMAND_ACTIONS)
    status = (
        F.when(F.col("action").isNull(), "malformed")
        .when(~known, "unknown_action")
        .when(F.col("action") == "ping", "ack")
        .when(~F.coalesce("has_strategy", F.lit(False)), "no_strategy")
        .otherwise("accepted")
    )
    return commands.withColumn("status", status)


def authorize(commands: DataFrame, registry: DataFrame) -> DataFrame:
    """Add ``verdict`` and ``reason``: a command has to come from the channel of its strategy's mode.

    A strategy nobody knows, and any mode but live, counts as sandbox. Nothing may be sent from logging.
    """
    joined = commands.join(registry.select("strategy_id", "mode"), "strategy_id", "left")
    effective = F.when(F.col("mode") == vocab.LIVE, vocab.LIVE).otherwise(vocab.SANDBOX)
    read_only = F.col("channel") == vocab.LOGGING
    crossed = F.coalesce(F.col("channel") != effective, F.lit(True))
    reason = F.when(read_only, F.lit("logging is read-only; use sandbox or live")).when(
        crossed, F.concat(F.col("strategy_id"), F.lit(" is "), effective, F.lit(", sent from "), F.col("channel"))
    )
    return joined.select(
        *commands.columns,
        effective.alias("effective_mode"),
        F.when(read_only | crossed, "rejected").otherwise("ok").alias("verdict"),
        reason.alias("reason"),
    )


def match_replies(
    requests: DataFrame, replies: DataFrame, seconds: int = vocab.REPLY_SECONDS, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """For each request the first reply on its topic and strategy within ``seconds``; NULL where it is missing.

    A reply answers every request that waits for it. Found as the next reply on the time line, so busy
    strategies do not produce pairs of requests and replies.
    """
    found = asof_join(
        requests,
        replies.select("topic", "strategy_id", "ts", F.col("seq").alias("reply_seq"), F.col("ts").alias("reply_ts")),
        ["topic", "strategy_id"],
        seq="reply_seq",
        direction="forward",
        take=["reply_seq", "reply_ts"],
        hot_rows=hot_rows,
    )
    in_time = F.coalesce(F.col("reply_ts") <= F.col("ts") + F.expr(f"interval {int(seconds)} seconds"), F.lit(False))
    return found.select(
        *requests.columns,
        *[F.when(in_time, F.col(c)).alias(c) for c in ("reply_seq", "reply_ts")],
        in_time.alias("answered"),
    )
