"""Display names and severities of events, and custom messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tapewright.functions import vocab
from tapewright.functions.values import truthy
from tapewright.operators import ingest


def spoken(name: Column | str) -> Column:
    """A name in words: parts of a compound and words in capitals become words, the first one capitalised."""
    name = F.col(name) if isinstance(name, str) else name
    parts = F.regexp_replace(F.regexp_replace(name, "([a-z0-9])([A-Z])", "$1 $2"), "_", " ")
    return F.concat(F.upper(F.substring(parts, 1, 1)), F.lower(F.substring(parts, 2, 2**31 - 1)))


def severity(name: Column | str) -> Column:
    """Severity by what a name says of the outcome: failures, lapses, everything else. NULL stays NULL."""
    name = F.upper(F.col(name) if isinstance(name, str) else name)
    failed = name.rlike("REJECT|DENIED|FAULT|ERROR")
    lapsed = name.rlike("CANCEL|EXPIRE|DEGRAD|STOP|DISPOS")
    return F.when(failed, "error").when(lapsed, "warning").when(name.isNotNull(), "info")


def with_labels(events: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """Add ``title``, ``side_label``, ``severity`` and ``state_severity`` from ``type``, ``side`` and ``state``.

    ``names`` (``name``, ``label``, one row per name) holds a reader's own titles; other types are spelled out.
    """
    titled = events
    own = F.lit(None).cast("string")
    if names is not None:
        titled = events.join(names.select(F.col("name").alias("type"), F.col("label").alias("_label")), "type", "left")
        own = F.col("_label")
    return titled.select(
        *events.columns,
        F.coalesce(own, spoken("type")).alias("title"),
        spoken("side").alias("side_label"),
        severity("type").alias("severity"),
        severity("state").alias("state_severity"),
    )


def custom_message(title: Column | str, text: Column | str, color: Column | None = None) -> tuple[Column, Column]:
    """Topic and payload of a custom message, ready to append to a log."""
    title, text = (F.col(c) if isinstance(c, str) else c for c in (title, text))
    fields = [title.alias("title"), text.alias("text")]
    if color is not None:
        fields.append(color.alias("color"))
    return F.lit(vocab.MESSAGE_TOPIC), F.to_json(F.struct(*fields))


def read_messages(decoded: DataFrame) -> DataFrame:
    """Custom messages with their whole text; a body that is no object is the text itself. ``color`` is NULL unless sent."""
    messages = decoded.where(F.col("topic") == vocab.MESSAGE_TOPIC)
    is_object = ingest.is_object()
    scalar = F.coalesce(ingest.field("$"), F.col("body_raw"))
    text = F.when(is_object, F.coalesce(ingest.field("$.text"), F.lit(""))).otherwise(scalar)
    return messages.select(
        *[c for c in decoded.columns if c != "body"],
        F.coalesce(F.when(is_object, ingest.field("$.title")), F.lit(vocab.DEFAULT_MESSAGE_TITLE)).alias("title"),
        text.alias("text"),
        F.when(is_object, ingest.field("$.color", "bigint")).alias("color"),
    )


def shown_balances(accounts: DataFrame, n: int = vocab.BALANCES_SHOWN) -> DataFrame:
    """The first balances of an account event, in the order they were sent, and how many more there are."""
    more = F.greatest(F.size("balances") - n, F.lit(0)).cast("bigint")
    return accounts.withColumn("more", more).withColumn("balances", F.slice("balances", 1, n))


def signal_text(value: Column | str = "value") -> Column:
    return F.coalesce(truthy(value), F.lit("?"))
