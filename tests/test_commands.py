import random
from datetime import datetime, timedelta

import pytest

from tapewright.operators import commands


def test_parse_and_validate(spark):
    payloads = [
        ('{"action":"pause","ts":1}', "pause", "accepted"),
        ("pause", "pause", "accepted"),
        ('"resume"', "resume", "accepted"),
        ("  flatten ", "flatten", "accepted"),
        ('{"action":"explode"}', "explode", "unknown_action"),
        ('{"note":1}', None, "malformed"),
        ("{broken", "{broken", "unknown_action"),
        ("[1]", None, "malformed"),
        (None, None, "malformed"),
    ]
    df = spark.createDataFrame([(i, p, True) for i, (p, *_) in enumerate(payloads)], "seq long, payload string, has_strategy boolean")
    got = sorted(commands.validate(commands.parse_actions(df)).collect(), key=lambda r: r.seq)
    assert [(r.action, r.status) for r in got] == [(a, s) for _, a, s in payloads]


def test_ping_needs_no_strategy(spark):
    df = spark.createDataFrame([("ping", False), ("report", False), ("report", None), ("report", True)], "action string, has_strategy boolean")
    assert [r.status for r in commands.validate(df).collect()] == ["ack", "no_strategy", "no_strategy", "accepted"]


@pytest.mark.parametrize(
    "strategy, channel, ok",
    [
        ("LIVE-001", "live", True),
        ("SBX-001", "sandbox", True),
        ("SBX-001", "live", False),
        ("LIVE-001", "sandbox", False),
        ("GHOST-001", "sandbox", True),
        ("GHOST-001", "live", False),
        ("PAPER-001", "sandbox", True),
        ("LIVE-001", "logging", False),
        ("SBX-001", "logging", False),
        ("SBX-001", None, False),
    ],
)
def test_authorization(spark, strategy, channel, ok):
    registry = spark.createDataFrame([("LIVE-001", "live"), ("SBX-001", "sandbox"), ("PAPER-001", "paper")], "strategy_id string, mode string")
    df = spark.createDataFrame([(strategy, channel)], "strategy_id string, channel string")
    assert commands.authorize(df, registry).first().verdict == ("ok" if ok else "rejected")


@pytest.mark.parametrize("hot_rows", [5, 10**9])
def test_replies(spark, hot_rows):
    rng, t0 = random.Random(2), datetime(2024, 1, 1)

    def rows(n):
        return [(rng.choice(["f", "o"]), rng.choice(["A", "A", "B"]), i, t0 + timedelta(seconds=rng.randrange(3000))) for i in range(n)]

    schema = "topic string, strategy_id string, seq long, ts timestamp_ntz"
    asked, came = rows(60), rows(40)
    got = commands.match_replies(spark.createDataFrame(asked, schema), spark.createDataFrame(came, schema), hot_rows=hot_rows)
    want = {}
    for topic, sid, seq, ts in asked:
        fits = [(t, s) for a, b, s, t in came if (a, b) == (topic, sid) and ts <= t <= ts + timedelta(seconds=120)]
        want[seq] = min(fits)[1] if fits else None
    assert {r.seq: r.reply_seq for r in got.collect()} == want
    assert any(v is None for v in want.values()) and any(v is not None for v in want.values())
