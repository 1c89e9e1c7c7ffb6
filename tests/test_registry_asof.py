"""The registry through time, against a plain replay of the log."""

import random

import pytest

from tapewright.operators import registry as reg

ANNOUNCE = "seq long, strategy_id string, mode string"
EVENT = "seq long, strategy_id string, topic string, note string"
HANDLES = ["A", "X-A", "B", "Y-B", "Z-Y-B", "C"]
IDS = ["A", "Q-A", "Q-X-A", "X-A", "Y-B", "T-Z-Y-B", "C", "D", "", None]


def replay(announces, events):
    """Row by row, as a reader of the log keeps its registry."""
    out = []
    for seq, id_, topic, note in events:
        known = {}
        for n, handle, mode in sorted((a for a in announces if None not in a), key=lambda a: (a[0], a[2])):
            if seq is not None and n <= seq:
                known[handle] = mode
        fits = [h for h in known if id_ and (id_ == h or id_.endswith("-" + h))]
        handle = max(fits, key=len) if fits else (id_ or None)
        mode = known.get(handle) if fits else None
        channel = "logging" if topic.startswith("ops.") or not id_ else "live" if mode == "live" else "sandbox"
        out.append((seq, id_, topic, note, handle, channel))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def rows():
    draw = random.Random(5)
    announces = [(draw.randrange(400), draw.choice(HANDLES), draw.choice(["live", "sandbox", "paper"])) for _ in range(150)]
    announces += [(7, None, "live"), (8, "A", None), (None, "A", "live"), announces[0]]
    events = [(draw.randrange(420), draw.choice(IDS), draw.choice(["events.order.V1", "ops.control"]), f"n{i}") for i in range(600)]
    events += [(None, "A", "events.order.V1", "no number"), events[0]]
    return announces, events


@pytest.mark.parametrize("hot_rows", [20, 10**6])
def test_routes_as_a_reader_of_the_log(spark, rows, hot_rows):
    announces, events = rows
    got = reg.route_asof(spark.createDataFrame(events, EVENT).repartition(5), spark.createDataFrame(announces, ANNOUNCE), hot_rows)
    got = got.select("seq", "strategy_id", "topic", "note", "handle", "channel").collect()
    assert sorted((tuple(r) for r in got), key=repr) == replay(announces, events)


@pytest.mark.parametrize("hot_rows", [10, 10**6])
def test_intervals_follow_one_another(spark, rows, hot_rows):
    got = reg.registry_intervals(spark.createDataFrame(rows[0], ANNOUNCE), hot_rows).collect()
    for handle in HANDLES:
        line = sorted((r for r in got if r.strategy_id == handle), key=lambda r: r.from_seq)
        assert [r.to_seq for r in line] == [*[r.from_seq for r in line[1:]], None]
        assert all(a.mode != b.mode for a, b in zip(line, line[1:]))
    latest = {r.strategy_id: r.mode for r in got if r.to_seq is None}
    by_seq = sorted((a for a in rows[0] if None not in a), key=lambda a: (a[0], a[2]))
    assert latest == {handle: mode for _, handle, mode in by_seq}


def test_a_later_change_moves_nothing(spark):
    announces = spark.createDataFrame([(10, "S", "sandbox"), (20, "S", "live")], ANNOUNCE)
    events = spark.createDataFrame([(n, "K-S", "events.order.V1", "") for n in (9, 10, 19, 20, 21)], EVENT)
    got = {r.seq: (r.handle, r.channel) for r in reg.route_asof(events, announces).collect()}
    assert got == {9: ("K-S", "sandbox"), 10: ("S", "sandbox"), 19: ("S", "sandbox"), 20: ("S", "live"), 21: ("S", "live")}


def test_empty_tables(spark):
    none, events = spark.createDataFrame([], ANNOUNCE), spark.createDataFrame([(1, "S", "events.order.V1", "")], EVENT)
    assert [(r.handle, r.channel) for r in reg.route_asof(events, none).collect()] == [("S", "sandbox")]
    assert reg.route_asof(events.limit(0), none).count() == 0 and reg.registry_intervals(none).count() == 0
