"""Stateful streams over several micro-batches: equal results, bounded state."""

import datetime
import random

import pytest

from quarrymill.streaming import events as st

SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
START = datetime.datetime(2024, 1, 1)


@pytest.fixture
def replay(spark, tmp_path):
    """Twelve files of a stream in order of time, and their rows."""
    rng, rows, at = random.Random(3), [], 0
    for n in range(1200):
        at += rng.choice([1, 5, 30, 2000])
        rows.append((n, START + datetime.timedelta(seconds=at), rng.randrange(6), "view", 1.0, None))
    for k in range(12):
        spark.createDataFrame(rows[100 * k : 100 * (k + 1)], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "events.parquet"))
    return str(tmp_path), rows


def by_fold(rows, most, idle):
    out = []
    for user in range(6):
        own = [(ts, n) for n, ts, u, *_ in rows if u == user]
        sessions = []
        for ts, n in own:
            if sessions and (ts - sessions[-1][-1][0]).total_seconds() <= idle:
                sessions[-1].append((ts, n))
            else:
                sessions.append([(ts, n)])
        for k, session in enumerate(sessions):
            for flush in range(0, len(session), most):
                part = session[flush : flush + most]
                out.append((user, session[0][0], flush // most, len(part), part[0][1], part[-1][1], "full" if len(part) == most else "idle", k == len(sessions) - 1))
    return out


def test_flushes_over_many_batches(spark, replay):
    folder, rows = replay
    stream = st.event_stream(spark, folder, files_each=1)
    flushed = st.flushed_buffers(stream, "user_id", 4, 900, "1 minute")
    query = flushed.writeStream.outputMode("append").format("memory").queryName("flushed").trigger(availableNow=True).start()
    query.awaitTermination()
    got = {tuple(r) for r in spark.table("flushed").collect()}
    want = by_fold(rows, 4, 900)
    assert {w[:7] for w in want if not w[7] or w[6] == "full"} <= got <= {w[:7] for w in want}
    states = [p.stateOperators[0].numRowsTotal for p in query.recentProgress if p.stateOperators]
    assert len(states) >= 12 and max(states) <= 6, "one small state for each user, however long the replay"


def test_closed_sessions_leave_the_state(spark, replay):
    folder, rows = replay
    sessions = st.session_counts(st.event_stream(spark, folder, files_each=1), "15 minutes")
    query = sessions.writeStream.outputMode("append").format("memory").queryName("closed").trigger(availableNow=True).start()
    query.awaitTermination()
    got = {(r.user_id, r.start, r.n) for r in spark.table("closed").collect()}
    starts = {}
    for user, start, _, n, *_ in by_fold(rows, 10**6, 900 - 1e-6):
        starts[user, start] = n
    assert got <= {(user, start, n) for (user, start), n in starts.items()}
    assert all(start + datetime.timedelta(days=1, hours=1) > rows[-1][1] for user, start, _ in {(u, s, n) for (u, s), n in starts.items()} - got)
