import json
from datetime import datetime

import pytest
from conftest import FEATURE_TYPES
from pyspark.sql import functions as F

from moodstream.functions import scalar as S
from moodstream.operators import ingest
from moodstream.operators.arrivals import prepared_batch
from moodstream.schemas import FEATURES, HISTORY
from moodstream.session import fresh_dir
from moodstream.sources import history as store
from moodstream.sources import payloads


def texts(spark, *documents):
    rows = [(i, d if isinstance(d, str) else json.dumps(d)) for i, d in enumerate(documents)]
    return spark.createDataFrame(rows, "payload_no long, payload string")


def feature(value, **ids):
    return {**ids, "valence": value, "energy": 0.1, "danceability": 0.1, "acousticness": 0.1, "instrumentalness": 0.1,
            "tempo": 100.0}


def test_feature_envelopes_and_ids(spark):
    rows = texts(
        spark,
        {"content": [feature(0.1, href="https://open.spotify.com/track/aaa?x=1"), feature(0.2, track_id="b")]},
        {"audioFeatures": [feature(0.3, spotifyId="c"), feature(0.35, spotifyId="", spotify_id="d")]},
        {"data": [feature(0.4, trackId="e", href="https://example.org/track/zzz")]},
        [feature(0.5, href="https://open.spotify.com/track/f/more")],
        {"content": None, "data": [feature(0.6, track_id="hidden")]},
        {"content": [], "audioFeatures": [feature(0.6, track_id="hidden")]},
        {"other": [feature(0.6, track_id="hidden")]},
        {"content": [feature(0.7, track_id="b"), feature(0.8, track_id="b"), feature(0.9)]},
        {"content": [feature(0.9, href="https://open.spotify.com/track/?x", spotify_id="g")]},
    )
    got = {r["track_id"]: r["valence"] for r in payloads.feature_payload(rows).collect()}
    assert got == {"aaa": 0.1, "b": 0.8, "c": 0.3, "d": 0.35, "e": 0.4, "f": 0.5, "g": 0.9}


def test_requested_ids_only(spark):
    rows = texts(spark, [feature(0.1, track_id="a"), feature(0.2, track_id="b")])
    wanted = spark.createDataFrame([("b",), ("b",), ("x",)], "track_id string")
    assert [r["track_id"] for r in payloads.feature_payload(rows, wanted).collect()] == ["b"]


def test_play_payload(spark):
    stamp = "2024-03-01T10:00:00.123Z"
    rows = texts(
        spark,
        {"items": [
            {"played_at": stamp, "track": {"id": "a", "name": "A", "artists": [{"name": "x"}, {"name": "y"}]}},
            {"played_at": stamp, "track": None},
            {"played_at": None, "track": {"id": "b", "name": "B"}},
            {"played_at": stamp, "track": {"id": "", "name": "B"}},
            {"played_at": stamp, "track": {"id": "c"}},
        ]},
        {"items": []},
    )
    got = {r["track_id"]: (r["track_name"], r["artist_name"]) for r in payloads.play_payload(rows).collect()}
    assert got == {"a": ("A", "x, y"), "c": ("", "")}


def test_track_payload(spark):
    def images(*pairs):
        return {"images": [{"url": u, "width": w} for u, w in pairs]}

    rows = texts(
        spark,
        {"tracks": [
            {"id": "a", "name": "A", "artists": [], "album": images(("big", 640), ("mid", 300))},
            None,
            {"id": "b", "name": "B", "artists": [{"name": "x"}], "album": images(("big", 640))},
            {"id": "c", "name": "C", "album": images()},
        ]},
    )
    got = {r["track_id"]: (r["artist_name"], r["image_url"]) for r in payloads.track_payload(rows).collect()}
    assert got == {"a": ("", "mid"), "b": ("x", "big"), "c": ("", None)}


def test_tempo_of_known_and_unknown_tracks(spark, make_plays):
    plays = make_plays([(1, 0, "slow"), (1, 1, "fast"), (1, 2, "blank"), (1, 3, "unknown")])
    table = spark.createDataFrame(
        [("slow", 50.0), ("fast", 400.0), ("blank", None)], "track_id string, tempo double"
    ).withColumns({n: F.lit(0.5) for n in FEATURES[:5]})
    got = {r["track_id"]: (r["tempo_norm"], r["valence"]) for r in ingest.with_features(plays, table).collect()}
    assert got == {"slow": (0.2, 0.5), "fast": (1.0, 0.5), "blank": (0.0, 0.5), "unknown": (None, None)}


def test_metadata_without_artwork_clears_it(spark, make_plays):
    plays = make_plays([(1, 0, "a", "pa", "aa"), (1, 1, "b", "pb", "ab")], track_name="string", artist_name="string")
    meta = spark.createDataFrame([("a", "ma", "", None)], "track_id string, track_name string, artist_name string, image_url string")
    got = {r["track_id"]: (r["track_name"], r["artist_name"], r["image_url"]) for r in ingest.with_metadata(plays, meta).collect()}
    assert got == {"a": ("ma", "", None), "b": ("pb", "ab", None)}


def test_high_water_and_unseen(make_plays):
    history = make_plays([(1, 0, "a"), (1, 100, "b")])
    new = make_plays([(1, 100, "b"), (1, 100, "c"), (1, 50, "d"), (1, 101, "e"), (2, 0, "f")])
    assert {r["track_id"] for r in ingest.after_high_water(new, history).collect()} == {"e", "f"}
    assert {r["track_id"] for r in ingest.unseen(new, history).collect()} == {"c", "d", "e", "f"}


def test_copies_inside_a_batch(make_plays):
    rows = make_plays([(1, 0, "a", 2), (1, 0, "a", 1), (1, 0, "b", 3)], n="int")
    assert {r["n"] for r in ingest.one_per_key(rows, [F.asc("n")]).collect()} == {1, 3}


def full(make_plays, rows):
    plays = make_plays(rows, session_id="long", mood_cluster_id="int")
    texts_ = {n: F.lit(n) for n in ("track_name", "artist_name", "image_url")}
    numbers = {n: F.lit(0.5) for n in (*FEATURES, "tempo")}
    return plays.withColumns({**texts_, **numbers}).select(*HISTORY.fieldNames())


def test_stored_upsert(spark, make_plays):
    path = fresh_dir(spark, "history")
    store.update_history(spark, path, full(make_plays, [(1, 0, "a", 0, 1), (1, 90_000, "b", 1, 1), (1, 9, "n", 0, None)]))
    batch = full(make_plays, [(1, 90_000, "b", 1, 7), (1, 180_000, "c", 2, 2)])
    for _ in range(2):
        got = store.update_history(spark, path, batch)
        assert {r["track_id"]: r["mood_cluster_id"] for r in got.collect()} == {"a": 1, "b": 7, "c": 2}
    # A row that turns incomplete goes, even as the last of its date.
    got = store.update_history(spark, path, full(make_plays, [(1, 90_000, "b", 1, None)]))
    assert {r["track_id"] for r in got.collect()} == {"a", "c"}
    assert {r["track_id"] for r in store.scan_history(spark, path).collect()} == {"a", "c"}


def test_stored_upsert_without_a_column(spark, make_plays):
    path = fresh_dir(spark, "history")
    store.update_history(spark, path, full(make_plays, [(1, 0, "a", 0, 1), (1, 60, "b", 0, 2)]))
    bare = full(make_plays, [(1, 60, "b", 9, None), (1, 120, "new", 9, None)]).drop("mood_cluster_id")
    store.update_history(spark, path, bare)
    got = store.update_history(spark, path, full(make_plays, [(1, 180, "c", 0, 3)]))
    assert {r["track_id"]: (r["session_id"], r["mood_cluster_id"]) for r in got.collect()} == {"a": (0, 1), "b": (9, 2), "c": (0, 3)}


def test_latest_batch(spark, make_plays):
    folder = fresh_dir(spark, "ingestions")
    assert store.latest_batch(spark, folder) is None
    rows = make_plays([(1, 0, "a")])
    assert store.write_batch(rows.filter("track_id = 'x'"), folder, datetime(2024, 3, 3)) is None
    store.write_batch(make_plays([(1, 0, "late")]), folder, datetime(2024, 3, 2))
    store.write_batch(rows, folder, datetime(2024, 3, 1))
    assert [r["track_id"] for r in store.latest_batch(spark, folder).collect()] == ["late"]


def counted(spark, rows):
    """The rows, and a counter of how often one of them was worked out."""
    seen = spark.sparkContext.accumulator(0)

    def each(row):
        seen.add(1)
        return row

    return spark.createDataFrame(rows.rdd.map(each), rows.schema), seen


def test_a_batch_is_worked_out_once(spark, make_plays):
    """Neither the check for an empty batch nor session ids, which read the plays several times, repeat the work before them."""
    features = [0.5] * 6
    plays = make_plays([(1, 60 * k, f"t{k}", *features) for k in range(20)], **FEATURE_TYPES).coalesce(1)
    rows, seen = counted(spark, plays)
    path = store.write_batch(rows, fresh_dir(spark, "ingestions"), datetime(2024, 3, 2))
    assert seen.value == 20 and sorted(store.scan_batch(spark, path).collect()) == sorted(plays.collect())
    rows, seen = counted(spark, plays)
    got = prepared_batch(rows, None, None)
    assert got.count() == 20 and got.select("session_id").distinct().count() == 1 and seen.value == 20


def test_dataset_without_rows_is_an_error(spark, make_plays):
    with pytest.raises(ValueError):
        store.write_dataset(make_plays([(1, 0, "a")]).filter("track_id = 'x'"), fresh_dir(spark, "dataset"))


def test_prepared_batch_drops_incomplete_and_copies(make_plays):
    features = [0.5] * 6
    rows = [(1, 0, "a", *features), (1, 0, "a", *features), (1, 60, "b", *features[:5], None)]
    points = [{"cluster_id": 0, **{n: 0.5 for n in FEATURES}}]
    got = prepared_batch(make_plays(rows, **FEATURE_TYPES), None, points).collect()
    assert [(r["track_id"], r["session_id"], r["mood_cluster_id"]) for r in got] == [("a", 0, 0)]


def test_nan_is_null_at_scan(spark, make_plays):
    path = fresh_dir(spark, "history")
    rows = full(make_plays, [(1, 0, "a", 0, 1)]).withColumn("valence", F.lit(float("nan")))
    rows.write.parquet(path)
    assert store.scan_history(spark, path).first()["valence"] is None


def test_text_of_numbers(spark):
    rows = spark.createDataFrame([(1.5,), (float("nan"),), (float("inf"),), (float("-inf"),), (None,)], "v double")
    assert [r[0] for r in rows.select(S.nan_text(F.col("v"))).collect()] == ["1.5", "NaN", "NaN", "NaN", "NaN"]


def test_nanosecond_stamps(spark):
    import pandas as pd
    import pyarrow as pa
    import pyarrow.parquet as pq

    path = fresh_dir(spark, "nanos") + ".parquet"
    stamps = pd.to_datetime(["2024-03-01T00:00:00.123456789", "2024-03-01T10:00:00.000000000"])
    table = pa.table({"track_id": ["a", "b"], "played_at": pa.array(stamps, pa.timestamp("ns"))})
    pq.write_table(table, path, version="2.6")
    got = store.scan_nanosecond_history(spark, path).withColumn("t", F.unix_micros("played_at")).collect()
    assert got[0]["t"] == 1709251200123456


def test_lookup_refuses_a_key_in_several_rows(spark):
    import pytest

    from moodstream.operators.skew import lookup_join

    rows = spark.createDataFrame([("a",), ("a",), (None,)], "k string")
    table = spark.createDataFrame([("a", 1)], "k string, v int")
    assert sorted((r.k or "", r.v or 0) for r in lookup_join(rows, table, ["k"]).collect()) == [("", 0), ("a", 1), ("a", 1)]
    with pytest.raises(Exception, match="several rows"):
        lookup_join(rows, table.union(table), ["k"]).collect()
