"""Lifecycles in event-time order over files that arrive out of order."""

from __future__ import annotations

import random
from collections import defaultdict
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from traceless.operators.stores import ACTIONS, STAGES
from traceless.streaming import jobs as K

START = datetime(2024, 1, 1)
SCHEMA = "request_id long, ts timestamp, event_id long, action string"


def plain(events, until, keep=None):
    """Outcome of every event up to ``until`` by (time, id)."""
    found, lines = set(), {}
    for request, ts, event, action in sorted(events, key=lambda e: (e[1], e[2])):
        if ts > until:
            continue
        stage, last = lines.get(request, (0, ts))
        if keep is not None and stage == len(ACTIONS) and ts >= last + keep:
            stage = 0
        legal = stage < len(ACTIONS) and action == ACTIONS[stage]
        stage += legal
        lines[request] = (stage, ts)
        found.add((request, event, STAGES[stage], legal))
    return found


def streamed(spark, tmp_path, batches, delay, keep=None):
    """Rows of the stream that reads one file per micro-batch."""
    folder = str(tmp_path / "events")
    for batch in batches:
        spark.createDataFrame(batch, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    events = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)
    with K.rocksdb_state(spark):
        return {tuple(r) for r in K.run_available(K.stream_ordered_lifecycle(events, delay, keep), "ordered").collect()}


def test_order_over_micro_batches(spark, tmp_path):
    rng = random.Random(3)
    events = []
    for request in range(6):
        names = list(ACTIONS)
        rng.shuffle(names) if request % 3 == 0 else None
        names.insert(rng.randrange(5), rng.choice(ACTIONS))
        events += [(request, START + timedelta(minutes=3 * k + request, microseconds=rng.randrange(5)), a) for k, a in enumerate(names)]
    events = [(r, ts, n, a) for n, (r, ts, a) in enumerate(events)]
    events.append((99, START + timedelta(hours=5), 1000, "create-request"))
    late_first = sorted(events[:-1], key=lambda e: (-e[1].minute // 6, e[2]))
    cuts = [late_first[:15], late_first[15:30], late_first[30:], events[-1:]]
    got = streamed(spark, tmp_path, cuts, "2 hours")
    assert got == plain(events, START + timedelta(hours=3))
    assert len(got) == len(events) - 1


def test_finished_requests_are_forgotten(spark, tmp_path):
    line = [(7, START + timedelta(minutes=k), k, a) for k, a in enumerate(ACTIONS)]
    soon = [(7, START + timedelta(minutes=10), 20, "create-request")]
    tick = [(8, START + timedelta(hours=3), 30, "probe")]
    again = [(7, START + timedelta(hours=4), 40, "create-request")]
    end = [(9, START + timedelta(hours=9), 50, "probe")]
    got = streamed(spark, tmp_path, [line, soon, tick, again, end], "1 minute", "1 hour")
    want = plain(line + soon + tick + again, START + timedelta(hours=8), timedelta(hours=1))
    assert got == want and (7, 40, "REQUESTED", True) in got and (7, 20, "VERIFIED", False) in got
    counts = defaultdict(int)
    for request, *_ in got:
        counts[request] += 1
    assert counts == {7: 8, 8: 1}
