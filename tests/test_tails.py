"""The context of arriving plays from state, against that from a stored history."""

import random
from datetime import datetime, timedelta

import pandas as pd
import pytest

from moodstream.operators.mood_dataset import PLAY_ORDER, SESSION, sample_columns, scoring_context
from moodstream.schemas import FEATURES
from moodstream.session import fresh_dir
from moodstream.streaming import streams, tails
from moodstream.streaming.tails import stream_context

SCHEMA = "listener_id string, session_id bigint, played_at timestamp, track_id string, mood_cluster_id int, " + ", ".join(
    f"{f} double" for f in FEATURES
)


def _plays():
    rng, rows = random.Random(2), []
    for who, count in (("hot", 60), ("a", 12), ("b", 1)):
        at, session = datetime(2024, 1, 1, 8), 0
        for i in range(count):
            step = rng.choice([0, 3, 9, 50])
            at, session = at + timedelta(minutes=step), session + (step == 50)
            values = [None if rng.random() < 0.1 else rng.random() for _ in FEATURES]
            rows.append((who, session, at, f"t{i:03}", None if rng.random() < 0.1 else rng.randint(0, 4), *values))
    return sorted(rows, key=lambda r: (r[2], r[3]))


def _rows(frame):
    columns = [*SESSION, *PLAY_ORDER, "mood_cluster_id", "ready", *sample_columns()]
    return sorted(
        [tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in frame.select(*columns).collect()],
        key=lambda r: (r[0], r[2], r[3]),
    )


@pytest.mark.parametrize("cuts", [[], [20, 21, 50]])
def test_any_cut_gives_the_stored_context(spark, cuts):
    rows = _plays()
    folder, sink, state = (fresh_dir(spark, f"tails-{k}") for k in ("in", "out", "state"))
    for start, end in zip([0, *cuts], [*cuts, len(rows)], strict=True):
        part = spark.createDataFrame(rows[start:end], SCHEMA)
        part.write.mode("append").parquet(folder)
        context = stream_context(streams.play_stream(spark, folder, part.schema), gap_minutes=10, delay="1 hour")
        streams.to_parquet(context, sink, state).awaitTermination()
    plays = spark.createDataFrame(rows, SCHEMA)
    assert _rows(spark.read.parquet(sink)) == _rows(scoring_context(plays, plays.limit(0)))


class _State:
    """State of one shard as the stream keeps it."""

    def __init__(self):
        self.get, self.timeout, self.now, self.hasTimedOut = None, None, 0, False

    exists = property(lambda self: self.get is not None)

    def getCurrentWatermarkMs(self):
        return self.now

    def update(self, value):
        self.get = value

    def remove(self):
        self.get = None

    def setTimeoutTimestamp(self, at):
        self.timeout = at


def test_a_call_serves_many_sessions():
    def plays(*rows):
        out = pd.DataFrame([(w, s, pd.Timestamp(2024, 1, 1, 0, m), f"t{m}", float(m)) for w, s, m in rows], columns=[*SESSION, *PLAY_ORDER, "mood_cluster_id"])
        return out.assign(**{f: 0.5 for f in FEATURES})

    follow, state = tails._follow(3, 10), _State()
    got = next(follow((0,), iter([plays(("a", 0, 2), ("b", 0, 30)), plays(("a", 0, 1), ("a", 1, 40))]), state))
    assert got[["listener_id", "session_id", "_pos", "_mood_cluster_id_2"]].fillna(-1).values.tolist() == [["a", 0, 0, -1], ["a", 0, 1, 1], ["a", 1, 0, -1], ["b", 0, 0, -1]]
    first = int(pd.Timestamp(2024, 1, 1).timestamp() * 1000)
    assert state.timeout == first + 12 * 60_000 + 1
    state.now, state.hasTimedOut = first + 20 * 60_000, True
    assert list(follow((0,), iter([]), state)) == [] and list(zip(*state.get[:2])) == [("a", 1), ("b", 0)]
    state.hasTimedOut = False
    got = next(follow((0,), iter([plays(("b", 0, 35), ("c", 0, 36))]), state))
    assert got[["_pos", "_mood_cluster_id_2"]].fillna(-1).values.tolist() == [[1, 30], [0, -1]]
    state.now, state.hasTimedOut = first + 600 * 60_000, True
    assert list(follow((0,), iter([]), state)) == [] and not state.exists
