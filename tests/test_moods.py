import random

import pytest
from conftest import FEATURE_TYPES, START
from pyspark.sql import functions as F

from moodstream.functions.scalar import mood_label
from moodstream.operators import moods
from moodstream.operators.mood_dataset import latest_window, mood_samples, scoring_context
from moodstream.schemas import FEATURES
from moodstream.session import fresh_dir
from moodstream.sources import moods as mood_store

HISTORY_TYPES = {**FEATURE_TYPES, "session_id": "long", "mood_cluster_id": "int"}


def point(cluster_id, value):
    return {"cluster_id": cluster_id, **{n: value for n in FEATURES}}


def test_nearest_and_ties(make_plays):
    rows = [(1, 0, "tie", *[0.5] * 6), (1, 1, "low", *[0.1] * 6), (1, 2, "none", 0.5, None, 0.5, 0.5, 0.5, 0.5)]
    plays = make_plays(rows, **FEATURE_TYPES)
    points = [point(5, 0.75), point(2, 0.25)]
    got = {r["track_id"]: (r["nearest_cluster_id"], r["distance"]) for r in moods.with_nearest(plays, points).collect()}
    assert got["tie"][0] == 2 and got["low"][0] == 2 and got["none"] == (None, None)
    assert got["low"][1] == pytest.approx((6 * 0.15**2) ** 0.5)


def test_a_mood_at_hand_stays_and_not_a_number_has_the_lowest_id(make_plays):
    nan = float("nan")
    rows = [(1, 0, "known", *[0.1] * 6, 7), (1, 1, "new", *[0.8] * 6, None), (1, 2, "nan", nan, *[0.8] * 5, None), (1, 3, "none", None, *[0.8] * 5, None)]
    plays = make_plays(rows, **FEATURE_TYPES, mood_cluster_id="int")
    points = [point(5, 0.75), point(2, 0.25)]
    got = {r["track_id"]: r["mood_cluster_id"] for r in moods.assign_moods(plays, points).collect()}
    assert got == {"known": 7, "new": 5, "nan": 2, "none": None}
    assert {r["track_id"] for r in moods.assign_moods(plays, points[:1]).filter("mood_cluster_id = 5").collect()} == {"new", "nan"}


@pytest.mark.parametrize("step, column", [(moods.assign_moods, "mood_cluster_id"), (moods.with_nearest, "nearest_cluster_id")])
def test_a_filter_on_the_mood_does_not_repeat_the_distances(make_plays, step, column):
    """The centroid's coordinate stands in one operator of the plan, though mood and filter both need it."""
    plays = make_plays([(1, 0, "a", *[0.5] * 6)], **FEATURE_TYPES)
    found = step(plays, [point(0, 0.123456), point(1, 0.75)]).filter(F.col(column).isNotNull())
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert sum("0.123456" in line for line in plan.splitlines()) == 1


def test_labels_at_the_edges(spark):
    rows = spark.createDataFrame(
        [(0.6, 0.6, 0.5), (0.61, 0.61, 0.51), (0.4, 0.4, 0.5), (0.39, 0.39, 0.9)], "v double, e double, a double"
    )
    got = [r[0] for r in rows.select(mood_label(F.col("v"), F.col("e"), F.col("a"))).collect()]
    assert got == [
        "Medium energy, neutral",
        "High energy, positive, acoustic",
        "Medium energy, neutral",
        "Low energy, negative, acoustic",
    ]


def test_store_round_trip_and_bound(spark):
    rows = [(i, *[i / 20] * 6) for i in range(16)]
    table = moods.labelled(spark.createDataFrame(rows, moods._CENTROIDS))
    with pytest.raises(ValueError):
        mood_store.save_moods(table, fresh_dir(spark, "moods"))
    path = fresh_dir(spark, "moods")
    mood_store.save_moods(table.filter("cluster_id < 12"), path)
    back = mood_store.load_moods(spark, path)
    assert [r["cluster_id"] for r in back.collect()] == list(range(12))
    assert mood_store.mood_points(back)[11]["tempo_norm"] == pytest.approx(11 / 20)


def test_elbow():
    assert moods.elbow([3, 4, 5, 6], [10.0, 4.0, 3.0, 2.5]) == 4
    assert moods.elbow([3, 4], [10.0, 4.0]) == 4


def test_kmeans_finds_separate_groups(spark, make_plays):
    rng = random.Random(1)
    rows = []
    for i in range(120):
        base = (0.1, 0.5, 0.9)[i % 3]
        rows.append((1, i, f"t{i}", *[base + rng.uniform(-0.03, 0.03) for _ in FEATURES]))
    plays = make_plays(rows, **FEATURE_TYPES)
    table = moods.fit_moods(plays, k_range=(3, 5), starts=2)
    assert sorted(round(r["valence"], 1) for r in table.collect()) == [0.1, 0.5, 0.9]
    done = moods.rebuild_moods(plays, mood_store.mood_points(table))
    assert sorted(r["count"] for r in done.groupBy("mood_cluster_id").count().collect()) == [40, 40, 40]
    with pytest.raises(ValueError):
        moods.fit_moods(plays.limit(2))


def random_history(seed, n=150):
    rng = random.Random(seed)
    rows, clock = [], 0
    for i in range(n):
        clock += rng.randint(1, 900)
        values = [None if rng.random() < 0.04 else round(rng.random(), 3) for _ in FEATURES]
        mood = None if rng.random() < 0.05 else rng.randint(0, 3)
        rows.append((rng.choice([1, 1, 1, 2]), clock, f"t{i}", *values, clock // 20_000, mood))
    return rows


def std(values):
    mean = sum(values) / len(values)
    return (sum((v - mean) ** 2 for v in values) / len(values)) ** 0.5


def brute_samples(rows, size):
    """(listener, seconds of the window's last play) -> facts."""
    out = {}
    known = [r for r in rows if r[-1] is not None]
    for key in {(r[0], r[-2]) for r in known}:
        own = sorted((r for r in known if (r[0], r[-2]) == key), key=lambda r: r[1])
        for i in range(len(own) - size):
            window, after = own[i : i + size], own[i + size]
            if any(v is None for r in window for v in r[3:9]):
                continue
            last = window[-1]
            out[(last[0], last[1])] = {
                "moods": [r[-1] for r in window],
                "valence_std": std([r[3] for r in window]),
                "energy_mean": sum(r[4] for r in window) / size,
                "position": i + size,
                "length": len(own),
                "minutes": (last[1] - own[0][1]) / 60,
                "target": after[-1],
            }
    return out


@pytest.mark.parametrize(("size", "chunk"), [(3, 4096), (3, 3), (2, 5), (5, 7)])
def test_samples_match_brute_force(make_plays, size, chunk):
    rows = random_history(size)
    got = mood_samples(make_plays(rows, **HISTORY_TYPES), size, chunk).collect()
    want = brute_samples(rows, size)
    assert len(got) == len(want) > 10
    for r in got:
        w = want[(r["listener_id"], r["played_at"].timestamp() - START.timestamp())]
        assert [r[f"mood_cluster_{i}"] for i in range(size)] == w["moods"]
        assert r["valence_std"] == pytest.approx(w["valence_std"], abs=1e-9)
        assert r["energy_mean"] == pytest.approx(w["energy_mean"])
        assert (r["session_position"], r["session_length"]) == (w["position"], w["length"])
        assert r["time_since_session_start"] == pytest.approx(w["minutes"])
        assert r["target_mood_cluster"] == w["target"]


@pytest.mark.parametrize("chunk", [4096, 3])
def test_context_is_strictly_before(make_plays, chunk):
    rows = random_history(9)
    edge = rows[90][1]
    old, new = [r for r in rows if r[1] < edge], [r for r in rows if r[1] >= edge]
    got = scoring_context(make_plays(new, **HISTORY_TYPES), make_plays(old, **HISTORY_TYPES), 3, chunk).collect()
    assert len(got) == len(new)
    for r in got:
        seconds = r["played_at"].timestamp() - START.timestamp()
        before = sorted(
            (x for x in rows if x[0] == r["listener_id"] and x[-2] == r["session_id"] and x[1] < seconds),
            key=lambda x: x[1],
        )
        last = before[-3:]
        assert r["ready"] == (len(last) == 3 and all(x[-1] is not None for x in last))
        assert r["session_position"] == len(before) + 1
        if r["ready"]:
            assert [r[f"mood_cluster_{i}"] for i in range(3)] == [x[-1] for x in last]
            known = [x[3] for x in last if x[3] is not None]
            assert r["valence_mean"] == pytest.approx(sum(known) / len(known) if known else 0.0)


def test_latest_window(make_plays):
    half = [0.5] * 6
    rows = [
        (1, 0, "a", *half, 0, 1), (1, 10, "b", *half, 0, 2), (1, 20, "c", *half, 0, 3), (1, 5000, "d", *half, 1, 0),
        (2, 0, "a", *half, 0, 1), (2, 60, "b", *half, 0, 2), (2, 120, "c", *half, 0, 3), (2, 180, "d", *half, 0, 0),
        (3, 0, "a", *half, 0, 2),
    ]
    history = make_plays(rows, **HISTORY_TYPES)
    got = {r["listener_id"]: r for r in latest_window(history).collect()}
    # A latest session of one play is filled up from the one before.
    assert [got[1][f"mood_cluster_{i}"] for i in range(3)] == [2, 3, 0] and got[1]["session_length"] == 3
    assert [got[2][f"mood_cluster_{i}"] for i in range(3)] == [2, 3, 0] and got[2]["session_length"] == 4
    assert got[3]["mood_cluster_0"] == 2 and got[3]["session_length"] == 1
    assert got[2]["time_since_session_start"] == 0.0
    exact = {r["listener_id"]: r for r in latest_window(history, exact=True).collect()}
    assert exact[2]["time_since_session_start"] == 3.0
