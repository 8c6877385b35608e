import random
from datetime import date, timedelta

import pytest
from conftest import FEATURE_TYPES
from pyspark.sql import functions as F

from moodstream.operators import export, splits
from moodstream.operators.sessions import sessionise
from moodstream.plans.dashboard import sanitised, write_dashboard
from moodstream.schemas import FEATURES
from moodstream.session import fresh_dir
from moodstream.sources import metrics_log
from moodstream.sources.history import staged


@pytest.fixture
def hours(spark):
    rows = [(i % 7, date(2024, 3, 1) + timedelta(days=i // 50), i % 24, i % 3) for i in range(503)]
    return spark.createDataFrame(rows, "listener_id long, date date, hour int, y int").withColumn(
        "id", F.monotonically_increasing_id()
    )


def test_time_split_is_exact_and_in_order(hours):
    got = splits.time_split(hours).collect()
    train = [r for r in got if r["part"] == "train"]
    assert (len(train), len(got)) == (int(503 * 0.8), 503)
    assert len({r["id"] for r in got}) == 503
    late = min((r["date"], r["hour"]) for r in got if r["part"] == "val")
    assert max((r["date"], r["hour"]) for r in train) <= late


def test_time_split_inside_one_hour(spark):
    rows = spark.createDataFrame([(i, date(2024, 3, 1), 5) for i in range(100)], "listener_id long, date date, hour int")
    got = splits.time_split(rows).filter("part = 'train'").collect()
    assert sorted(r["listener_id"] for r in got) == list(range(80))


def test_splits_read_their_input_at_most_three_times(spark, hours, tmp_path):
    path = str(tmp_path / "rows")
    hours.withColumn("listener_id", F.col("id")).write.parquet(path)
    rows = spark.read.parquet(path)
    for split in (splits.time_split(rows), splits.random_split(rows, ["id"]), splits.stratified_split(rows, "y", ["id"])):
        plan = split._jdf.queryExecution().optimizedPlan().toString()
        # Counting is one pass, made already; the other two are in the plan, beside the stored counts (which hold _range).
        reads = [line for line in plan.splitlines() if "Relation [" in line]
        assert sum("_range" not in line for line in reads) <= 2 and "Union" not in plan


def test_split_with_rare_classes_nulls_and_repeats(spark):
    rows = [(k, None if k % 5 == 0 else k % 3, k) for k in range(200)] + [(900, 7, 1), (901, None, 2)]
    frame = spark.createDataFrame(rows, "id long, y long, n long")
    got = splits.stratified_split(frame, "y", ["id"]).collect()
    assert len(got) == len(rows)
    for label in {y for _, y, _ in rows}:
        mine = [r.part for r in got if r.y == label]
        assert mine.count("train") == int(len(mine) * 0.8 + 1e-9)
    assert splits.stratified_split(frame.limit(0), "y", ["id"]).count() == splits.random_split(frame.limit(0), ["id"]).count() == 0
    one = splits.random_split(frame.limit(1), ["id"]).collect()
    assert [r.part for r in one] == ["val"]


def test_stratified_split_keeps_shares_and_repeats(hours):
    first = {r["id"]: r["part"] for r in splits.stratified_split(hours, "y", ["id"]).collect()}
    again = {r["id"]: r["part"] for r in splits.stratified_split(hours.repartition(3), "y", ["id"]).collect()}
    assert first == again and len(first) == 503
    sizes = splits.stratified_split(hours, "y", ["id"]).groupBy("y", "part").count().collect()
    assert {(r["y"], r["part"]): r["count"] for r in sizes} == {
        (0, "train"): 134, (0, "val"): 34, (1, "train"): 134, (1, "val"): 34, (2, "train"): 133, (2, "val"): 34,
    }


def test_random_split_and_coverage(hours):
    got = splits.random_split(hours, ["id"])
    assert got.filter("part = 'train'").count() == int(503 * 0.8)
    lacking = hours.withColumn("part", F.when(F.col("y") == 2, "val").otherwise("train"))
    moved = splits.cover_classes(lacking, "y", ["id"]).filter("y = 2 and part = 'train'").collect()
    assert [r["id"] for r in moved] == [lacking.filter("y = 2").agg(F.min("id")).first()[0]]


def test_filled_features(spark):
    rows = spark.createDataFrame([(1.5, float("nan"), None)], "a double, b double, c double")
    assert splits.filled(rows, ["a", "b", "c", "d"]).first().asDict() == {"a": 1.5, "b": 0.0, "c": 0.0, "d": 0.0}


def test_last_days(hours):
    newest = hours.agg(F.max("date")).first()[0]
    assert {r["date"] for r in splits.last_days(hours, 2).collect()} == {newest - timedelta(days=i) for i in range(3)}


def test_top_hours_ties(spark):
    rows = spark.createDataFrame([(1, h, 0.5 if h > 2 else 0.1) for h in range(24)], "listener_id long, hour int, probability double")
    assert [r["hour"] for r in export.top_hours(rows).orderBy("place").collect()] == [3, 4, 5]


def test_actual_hours(make_plays):
    history = sessionise(make_plays([(1, 0, "a"), (1, 86_400, "b"), (1, 90_000, "c")]))
    got = {r["hour"]: r["share"] for r in export.actual_hours(history).collect()}
    assert len(got) == 24 and (got[0], got[1], got[2]) == (1.0, 0.5, 0.0)


def test_trajectory_fills_missing_features(make_plays):
    values = [(1, 0, "a", *[None] * 6), (1, 1000, "b", *[0.2] * 6), (1, 1001, "c", *[0.4] * 6)]
    rows = make_plays(values, **FEATURE_TYPES)
    as_of = F.lit("2024-03-01 12:00:00").cast("timestamp")
    got = export.mood_trajectory(rows, as_of).orderBy("time").collect()
    assert [round(r["valence"], 6) for r in got] == [0.5, 0.3]
    later = F.lit("2024-03-02 00:16:40").cast("timestamp")
    assert [r["valence"] for r in export.mood_trajectory(rows, later).collect()] == [pytest.approx(0.3)]


def test_recommendations_match_brute_force(make_plays):
    rng = random.Random(3)
    features = {f"t{i:03}": [round(rng.random(), 3) for _ in FEATURES] for i in range(60)}
    rows = [
        (rng.choice([1, 2]), i * 60, t, *features[t], rng.randint(0, 1))
        for i, t in enumerate(rng.choice(list(features)) for _ in range(300))
    ]
    history = make_plays(rows, **FEATURE_TYPES, mood_cluster_id="int")
    points = [{"cluster_id": c, **dict.fromkeys(FEATURES, v)} for c, v in ((0, 0.3), (1, 0.97))]
    wanted = history.select("listener_id", "mood_cluster_id").distinct()
    got = {}
    for r in export.recommend(history, wanted, points).collect():
        got[(r["listener_id"], r["mood_cluster_id"], r["variant"])] = r["track_id"]
    want = {}
    for listener in (1, 2):
        for point in points:
            own = [r for r in rows if r[0] == listener and r[-1] == point["cluster_id"]]
            seeds = list(dict.fromkeys(r[2] for r in sorted(own, key=lambda r: -r[1])))[:5]
            used = set()
            for variant, shift in enumerate(export.QUERY_SHIFTS):
                q = [min(1.0, max(0.0, point[n] + shift.get(n, 0.0))) for n in FEATURES]
                played = {r[2] for r in rows} - set(seeds)
                best = min(played, key=lambda t: (sum((a - b) ** 2 for a, b in zip(features[t], q)) ** 0.5, t))
                if best not in used:
                    want[(listener, point["cluster_id"], variant)] = best
                used.add(best)
    assert got == want


def test_unknown_mood_label(spark):
    rows = spark.createDataFrame([(1, 0), (2, 9)], "listener_id long, mood_cluster_id int")
    table = spark.createDataFrame([(0, "calm")], "cluster_id int, label string")
    got = {r["listener_id"]: r["mood_label"] for r in export.with_label(rows, table).collect()}
    assert got == {1: "calm", 2: "Cluster 9"}


def test_sanitised_document(spark):
    rows = spark.sql(
        "SELECT 1L AS listener_id, double('NaN') AS a, array(named_struct('b', double('Infinity'), 'c', 1.5D)) AS list,"
        " cast(null AS string) AS name"
    )
    assert sanitised(rows).first()["list"][0].asDict() == {"b": None, "c": 1.5}
    path = fresh_dir(spark, "document")
    write_dashboard(rows, path, null_mark="NaN")
    assert spark.read.text(path).first()[0] == (
        '{"listener_id":1,"a":"NaN","list":[{"b":"NaN","c":1.5}],"name":"NaN"}'
    )


def test_metrics_log_carries_models_forward(spark):
    path = fresh_dir(spark, "metrics")

    def entry(day, mood=None):
        row = (date(2024, 3, day), day, 1, mood, None, None)
        rows = spark.createDataFrame([row], "d date, num_tracks long, num_sessions long, mood_model struct<{}>, a int, b int".format(
            ",".join(f"{f}:double" for f in metrics_log.MOOD_METRICS.fieldNames())
        ))
        return rows.select(
            F.col("d").cast("timestamp").alias("run_at"), "num_tracks", "num_sessions", "mood_model",
            F.lit(None).cast(metrics_log.SESSION_METRICS).alias("session_model"),
            F.lit(None).cast(metrics_log.DRIFT).alias("drift"),
        )

    metrics_log.append_entry(spark, path, entry(1))
    metrics_log.append_entry(spark, path, entry(2, (0.9, 0.8, None, None, None, None)))
    metrics_log.append_entry(spark, path, entry(3))
    log = metrics_log.append_entry(spark, path, entry(4, (0.5, 0.4, None, None, None, None)))
    got = {r["num_tracks"]: r["mood_model"] and r["mood_model"]["val_accuracy"] for r in log.collect()}
    assert got == {1: None, 2: 0.8, 3: 0.8, 4: 0.4}
    view = {r["num_tracks"]: r["kind"] for r in export.metric_view(log.withColumn("k", F.lit(0)), ["k"], 2).collect()}
    assert view == {4: "latest", 3: "history", 2: "history"}


def test_only_the_cut_is_broadcast(spark):
    """A table that packs well is small by its files, which must not lead to a broadcast of all its rows."""
    rows = staged(spark.range(20_000).selectExpr("id % 50 as listener_id", "date_add(date'2024-01-01', int(id div 1200)) as date", "int(id % 24) as hour"))
    record = splits._thresholds(rows.withColumn("_shard", F.col("listener_id") % 8), [], ["date", "hour", "_shard"], ["listener_id"], 0.8)
    plan = record._jdf.queryExecution().executedPlan().toString()
    assert "BuildRight" in plan and "BuildLeft" not in plan
