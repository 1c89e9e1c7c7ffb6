"""The registry ``strategy handle -> mode`` kept from announces, and what is looked up in it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tapewright.functions import vocab
from tapewright.functions.values import truthy
from tapewright.operators.asof import asof_join
from tapewright.operators.skew import HOT_ROWS, Track, running, top_per_key
from tapewright.session import shared_dir


def latest_registry(announces: DataFrame) -> DataFrame:
    """Latest mode of every strategy; announces without id or mode are skipped."""
    usable = announces.where(F.col("strategy_id").isNotNull() & F.col("mode").isNotNull())
    return usable.groupBy("strategy_id").agg(F.max_by("mode", "seq").alias("mode"))


def registry_intervals(announces: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """The registry through time: ``(strategy_id, mode, from_seq, to_seq)``, each mode from its first announce up to, not
    including, the announce that changes it; the mode in force has no ``to_seq``.

    Announces that repeat the mode make no new interval. Announces without id, mode or ``seq`` are skipped; of several
    modes at one entry number the largest text counts.
    """
    changes = _mode_changes(announces, hot_rows)
    after = {"to_seq": Track("last", F.col("seq"))}
    ended = running(changes, ["strategy_id"], ["seq"], after, exclusive=True, reverse=True, hot_rows=hot_rows)
    return ended.select("strategy_id", "mode", F.col("seq").alias("from_seq"), "to_seq")


def _mode_changes(announces: DataFrame, hot_rows: int) -> DataFrame:
    """Announces that change a mode, as files in the shared folder: scans that follow read these few rows several times."""
    shared_dir(announces.sparkSession)
    usable = announces.where(F.col("strategy_id").isNotNull() & F.col("mode").isNotNull() & F.col("seq").isNotNull())
    once = usable.groupBy("strategy_id", "seq").agg(F.max("mode").alias("mode"))
    before = {"_before": Track("last", F.col("mode"))}
    told = running(once, ["strategy_id"], ["seq"], before, exclusive=True, hot_rows=hot_rows)
    return told.where(F.col("_before").isNull() | (F.col("_before") != F.col("mode"))).drop("_before").checkpoint()


def control_handles(log: DataFrame) -> DataFrame:
    """Strategies that have a control stream. The whole text behind the prefix is the handle, colons included."""
    prefix = vocab.CONTROL_KEY_PREFIX
    keys = log.where(F.col("stream_key").startswith(prefix)).select("stream_key").distinct()
    return keys.select(F.substring("stream_key", len(prefix) + 1, 2**31 - 1).alias("strategy_id"))


def with_fallback(registry: DataFrame, log: DataFrame) -> DataFrame:
    """Add strategies that were only ever seen on a control stream, as sandbox; known ones are not touched."""
    unknown = control_handles(log).join(registry, "strategy_id", "left_anti")
    return registry.unionByName(unknown.withColumn("mode", F.lit(vocab.SANDBOX)))


def _with_suffixes(ids: DataFrame) -> DataFrame:
    """Each id with every handle it could stand for: the id itself and what follows one of its hyphens."""
    parts = F.split("strategy_id", "-")
    suffixes = F.transform(
        F.sequence(F.lit(1), F.size(parts)),
        lambda i: F.array_join(F.slice(parts, i, F.size(parts) - i + 1), "-"),
    )
    return ids.select("*", F.explode(suffixes).alias("handle"))


def resolve_handles(ids: DataFrame, registry: DataFrame) -> DataFrame:
    """Map event ids to registry handles: ``(strategy_id, handle, mode)``, one row per distinct id.

    A handle fits when it is the id itself or what follows one of its hyphens; the longest one wins. Without
    a fit the id stands for itself and has no mode. The suffixes of an id are looked up by equality.
    """
    distinct = ids.select("strategy_id").where(truthy("strategy_id").isNotNull()).distinct()
    candidates = _with_suffixes(distinct)
    known = registry.select(F.col("strategy_id").alias("handle"), "mode", F.lit(True).alias("_known"))
    # Only candidates that are a handle go on: a suffix that many ids share is looked up, not gathered.
    matched = candidates.join(known, "handle")
    rank = F.when(F.col("_known"), F.length("handle"))
    found = matched.groupBy("strategy_id").agg(
        F.max_by("handle", rank).alias("handle"),
        F.max_by("mode", rank).alias("mode"),
    )
    best = distinct.join(found, "strategy_id", "left")
    return best.withColumn("handle", F.coalesce("handle", "strategy_id"))


def channel_targets(registry: DataFrame, channel: str | None) -> DataFrame:
    """Strategies a report request from ``channel`` is meant for; any other channel sees all."""
    if channel in (vocab.LIVE, vocab.SANDBOX):
        registry = registry.where(F.col("mode") == channel)
    return registry.select("strategy_id")


def fanout_targets(announces: DataFrame, limit: int | None = None) -> DataFrame:
    """Distinct strategies of all announces, or of the ``limit`` newest, newest first."""
    newest = announces.select("seq", "strategy_id")
    if limit is not None:
        newest = top_per_key(newest, [], [F.desc("seq")], limit)
    seen = newest.where(F.col("strategy_id").isNotNull()).groupBy("strategy_id").agg(F.max("seq").alias("last_seq"))
    return seen.orderBy(F.desc("last_seq"))


def protocol_drift(announces: DataFrame, protocol: str, version: str) -> DataFrame:
    """Announces whose protocol or engine version differs from ours; a missing version differs."""
    own = F.coalesce("protocol_version", F.lit(""))
    engine = F.coalesce("engine_version", F.lit(""))
    usable = announces.where(F.col("strategy_id").isNotNull() & F.col("mode").isNotNull())
    return usable.where((own != protocol) | (engine != version)).select(
        "strategy_id",
        own.alias("seen_protocol"),
        F.lit(protocol).alias("expected_protocol"),
        engine.alias("seen_version"),
        F.lit(version).alias("expected_version"),
    )


def drift_warnings(announces: DataFrame, protocol: str, version: str) -> DataFrame:
    """One warning per strategy and pair of versions, however often it announces itself."""
    return protocol_drift(announces, protocol, version).dropDuplicates(["strategy_id", "seen_protocol", "seen_version"])


def route(events: DataFrame, registry: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """Add ``handle`` and ``channel``.

    Operations topics and events without a strategy go to logging, strategies whose mode is live to live,
    everything else to sandbox. ``ids`` may name a cheaper source of the strategy ids than ``events`` itself.
    """
    # Ids are looked up once each; AQE broadcasts them by their bytes, or splits a busy strategy's rows.
    resolved = resolve_handles(events if ids is None else ids, registry)
    joined = events.join(resolved, "strategy_id", "left")
    return joined.withColumn("channel", _channel()).drop("mode")


def _channel() -> Column:
    unscoped = F.col("topic").startswith(vocab.OPERATIONS_TOPIC_PREFIX) | truthy("strategy_id").isNull()
    return F.when(unscoped, vocab.LOGGING).when(F.col("mode") == vocab.LIVE, vocab.LIVE).otherwise(vocab.SANDBOX)


def resolve_asof(events: DataFrame, announces: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Handle and mode of every ``(strategy_id, seq)`` of the events by what was announced up to that entry number.

    A handle takes part from its first announce on (an announce with the event's own number counts); of those known at
    the time the longest wins. Pairs that nothing known fits are left out. Each event meets the time lines of the few
    handles its id can stand for, one scan for all of them; an id's events and a handle's changes are never paired.
    """
    told = _mode_changes(announces, hot_rows).withColumnRenamed("strategy_id", "handle")
    probes = events.select("strategy_id", "seq").where(truthy("strategy_id").isNotNull() & F.col("seq").isNotNull())
    # A handle's names are looked up once for each id, not for each event.
    handles = told.select("handle").distinct()
    stands_for = _with_suffixes(probes.select("strategy_id").distinct()).join(handles, "handle", "left_semi")
    # The scan reads its input for counts, splitters and totals too: events are decoded once for all of these.
    asked = probes.join(stands_for, "strategy_id").checkpoint()
    found = asof_join(asked, told, ["handle"], on="seq", take=["mode"], hot_rows=hot_rows)
    rank = F.length("handle")
    known = found.where(F.col("mode").isNotNull()).groupBy("strategy_id", "seq")
    return known.agg(F.max_by("handle", rank).alias("handle"), F.max_by("mode", rank).alias("mode"))


def route_asof(events: DataFrame, announces: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Like :func:`route`, by the registry as of each event's ``seq``: a later change of mode does not move older events.

    Events before the first announce of their strategy, or without ``seq``, keep their id as handle and go to sandbox.
    """
    known = resolve_asof(events, announces, hot_rows)
    joined = events.join(known, ["strategy_id", "seq"], "left")
    handle = F.coalesce("handle", truthy("strategy_id"))
    return joined.withColumns({"handle": handle, "channel": _channel()}).drop("mode")
