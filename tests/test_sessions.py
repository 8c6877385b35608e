import random

from conftest import START

from moodstream.operators.sessions import (
    continue_sessions,
    extended_tails,
    history_counts,
    listener_tails,
    play_gaps,
    session_days,
    session_facts,
    sessionise,
    start_hours,
)
from moodstream.operators.skew import chunked, lookup_join, numbered
from pyspark.sql import functions as F


def brute(rows, gap):
    """Session id per (listener, seconds, track)."""
    out, last = {}, {}
    for listener, seconds, track in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        before, sid = last.get(listener, (None, 0))
        if before is not None and seconds - before > gap * 60:
            sid += 1
        last[listener] = (seconds, sid)
        out[(listener, seconds, track)] = sid
    return out


def as_dict(frame):
    return {
        (r["listener_id"], (r["played_at"].timestamp() - START.timestamp()), r["track_id"]): r["session_id"]
        for r in frame.collect()
    }


def random_rows(seed, n=400, hot=0.7):
    rng = random.Random(seed)
    rows = set()
    for i in range(n):
        listener = 1 if rng.random() < hot else rng.randint(2, 6)
        rows.add((listener, rng.randint(0, 200_000), f"t{rng.randint(0, 20)}"))
    return list(rows)


def test_pause_of_exactly_the_gap_stays(make_plays):
    rows = [(1, 0, "a"), (1, 1800, "b"), (1, 3600.000001, "c"), (1, 3600.000001 + 1800.000001, "d"), (2, 5, "a")]
    ids = {r["track_id"]: r["session_id"] for r in sessionise(make_plays(rows)).filter("listener_id = 1").collect()}
    assert ids == {"a": 0, "b": 0, "c": 1, "d": 2}


def test_ids_do_not_depend_on_slices(make_plays):
    rows = random_rows(1)
    want = brute(rows, 30)
    for minutes in (1, 7, 60, 1_000_000):
        assert as_dict(sessionise(make_plays(rows), 30, slice_minutes=minutes)) == want


def test_one_listener_with_all_plays(make_plays):
    rows = random_rows(2, hot=1.0)
    assert as_dict(sessionise(make_plays(rows), 10)) == brute(rows, 10)


def test_gap_crosses_empty_slices(make_plays):
    got = {r["track_id"]: r["gap_minutes"] for r in play_gaps(make_plays([(1, 0, "a"), (1, 36_000, "b")])).collect()}
    assert got == {"a": None, "b": 600.0}


def test_continued_ids_equal_full_numbering(make_plays):
    rows = random_rows(3)
    plays = make_plays(rows)
    edge = F.lit(START.timestamp() + 120_000).cast("timestamp")
    old, new = plays.filter(F.col("played_at") < edge), plays.filter(F.col("played_at") >= edge)
    # A listener that history does not know.
    new = new.unionByName(make_plays([(99, 150_000, "z"), (99, 190_000, "y")]))
    done = continue_sessions(new, sessionise(old))
    want = brute(rows + [(99, 150_000, "z"), (99, 190_000, "y")], 30)
    got = as_dict(done)
    assert got and all(want[k] == v for k, v in got.items())


def test_tails_grow_with_each_batch(make_plays):
    rows = random_rows(6)
    full_history = sessionise(make_plays(rows))
    edge = F.lit(START.timestamp() + 120_000).cast("timestamp")
    old, new = full_history.filter(F.col("played_at") < edge), full_history.filter(F.col("played_at") >= edge)
    got = {r["listener_id"]: r for r in extended_tails(listener_tails(old), new).collect()}
    want = {r["listener_id"]: r for r in listener_tails(full_history).collect()}
    assert got == want and len(want) == 6


def test_facts_from_session_days_are_the_same(make_plays):
    history = sessionise(make_plays(random_rows(7)))
    days = session_days(history)
    for derive in (session_facts, history_counts, start_hours):
        assert sorted(derive(days).collect()) == sorted(derive(history).collect())


def test_single_play_and_day_crossing(make_plays):
    late = 86_400 - 600
    history = sessionise(make_plays([(1, late, "a"), (1, late + 1200, "b"), (1, late + 90_000, "c")]))
    facts = {r["session_id"]: r for r in session_facts(history).collect()}
    assert facts[0]["duration_minutes"] == 20.0 and facts[0]["hour"] == 23 and facts[1]["duration_minutes"] == 0.0
    assert session_days(history).count() == 3
    assert history_counts(history).first().asDict() == {"num_tracks": 3, "num_sessions": 2}


def test_two_sessions_in_one_hour_count_once(make_plays):
    history = sessionise(make_plays([(1, 0, "a"), (1, 1900, "b")]), 30)
    assert history.select("session_id").distinct().count() == 2
    assert start_hours(history).count() == 1


def test_numbering_and_chunks_match_brute_force(make_plays):
    rows = random_rows(4, n=200)
    placed = numbered(make_plays(rows), ["listener_id"], ["played_at", "track_id"], slice_minutes=13)
    got = {(r["listener_id"], r["played_at"].timestamp() - START.timestamp(), r["track_id"]): r for r in placed.collect()}
    for listener in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == listener), key=lambda r: (r[1], r[2]))
        for i, row in enumerate(own):
            assert (got[row]["_pos"], got[row]["_size"]) == (i, len(own))
    chunks = chunked(placed, 2, 1, size=3).collect()
    assert sum(r["_owned"] for r in chunks) == len(rows)
    by_chunk = {}
    for r in chunks:
        by_chunk.setdefault((r["listener_id"], r["_chunk"]), set()).add(r["_pos"])
    for r in chunks:
        if r["_owned"]:
            near = {p for p in range(r["_pos"] - 2, r["_pos"] + 2) if 0 <= p < r["_size"]}
            assert near <= by_chunk[(r["listener_id"], r["_chunk"])]


def test_lookup_join_equals_left_join(spark, make_plays):
    rows = make_plays(random_rows(5, n=300, hot=0.9))
    table = spark.createDataFrame([(1, "hot"), (3, "cold"), (50, "absent"), (4, None)], "listener_id long, v string")
    want = sorted(map(tuple, rows.join(table, "listener_id", "left").select("listener_id", "track_id", "v").collect()), key=repr)
    # Hot keys with and without an entry, cold keys, and rows without a key.
    rows = rows.unionByName(make_plays([(None, 5, "n"), (None, 6, "m")] + [(77, i, "h") for i in range(40)]))
    want = sorted(map(tuple, rows.join(table, "listener_id", "left").select("listener_id", "track_id", "v").collect()), key=repr)
    for hot in (1, 2, 1000):
        got = lookup_join(rows, table, ["listener_id"], hot).select("listener_id", "track_id", "v").collect()
        assert sorted(map(tuple, got), key=repr) == want


def test_empty_history(make_plays):
    empty = make_plays([(1, 0, "a")]).filter("track_id = 'none'")
    assert sessionise(empty).count() == 0
    assert history_counts(sessionise(empty)).first().asDict() == {"num_tracks": 0, "num_sessions": 0}
