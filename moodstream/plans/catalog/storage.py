"""Readers and writers: each query writes what Spark derives from the tables, and reads it back."""

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moodstream import fixtures
from moodstream.operators.ingest import upserted, with_features
from moodstream.operators.mood_dataset import mood_samples
from moodstream.operators.session_dataset import session_samples
from moodstream.plans.catalog.common import (
    BATCH_FROM,
    FEATURES_R6,
    arrived,
    before,
    history,
    moods,
    r6,
    rx,
    sessions,
)
from moodstream.plans.catalog.projections import MOOD_SAMPLES, SESSION_SAMPLES
from moodstream.plans.catalog.windows import LOG_SQL, _log
from moodstream.schemas import FEATURES, HISTORY, PAYLOAD_FEATURES
from moodstream.session import fresh_dir
from moodstream.sources import history as store
from moodstream.sources import metrics_log, moods as mood_store, payloads


def scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_dir(spark, "history")
    history(spark, sf_dir).select(*HISTORY.fieldNames()).write.parquet(path)
    return store.scan_history(spark, path)


def latest_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = fresh_dir(spark, "ingestions")
    plays = fixtures.plays(spark, sf_dir).select("listener_id", "track_id", "played_at", "event_id")
    store.write_batch(before(plays), folder, datetime(2024, 1, 28, 12, 30))
    store.write_batch(arrived(plays), folder, datetime(2024, 1, 31, 0, 0))
    return store.latest_batch(spark, folder)


def mood_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_dir(spark, "moods")
    mood_store.save_moods(moods(spark, sf_dir), path)
    return mood_store.load_moods(spark, path)


def play_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One payload per play: the play, the same without a track, and one without a stamp."""
    artists = F.transform("artist_names", lambda n: F.struct(n.alias("name")))
    names = fixtures.tracks(spark, sf_dir).select("track_id", artists.alias("artists"))
    rows = fixtures.plays(spark, sf_dir).join(names, "track_id")
    stamp = F.date_format("played_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    track = F.struct(
        F.col("track_id").alias("id"),
        F.col("track_name").alias("name"),
        F.when(F.size("artists") > 0, F.col("artists")).alias("artists"),
    )
    no_stamp = F.lit(None).cast("string")
    items = F.array(
        F.struct(stamp.alias("played_at"), track.alias("track")),
        F.struct(stamp.alias("played_at"), F.when(F.lit(False), track).alias("track")),
        F.struct(no_stamp.alias("played_at"), track.alias("track")),
    )
    return rows.select(
        "listener_id", F.col("event_id").alias("payload_no"), F.to_json(F.struct(items.alias("items"))).alias("payload")
    )


def play_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = payloads.play_payload(play_payloads(spark, sf_dir))
    return flat.select(
        "listener_id", F.col("payload_no").alias("event_id"), "track_id", "played_at", "track_name", "artist_name"
    )


def feature_payloads(spark: SparkSession, sf_dir: str, kinds: int = 5) -> DataFrame:
    """Payloads in all envelopes (the fifth is not known); the first item of each is overruled by the second."""
    tracks = fixtures.tracks(spark, sf_dir)
    link = F.concat(F.lit("https://open.spotify.com/track/"), F.col("track_id"), F.lit("?x=1"))

    def item(shift: float):
        values = [(F.col(n) + shift).alias(n) for n in PAYLOAD_FEATURES]
        return F.struct(
            F.when(F.col("vec_id") % 2 == 0, link).alias("href"),
            F.when(F.col("vec_id") % 2 == 1, F.col("track_id")).alias("trackId"),
            *values,
        )

    items = F.array(item(1.0), item(0.0))
    kind = F.col("vec_id") % kinds
    payload = (
        F.when(kind == 0, F.to_json(F.struct(items.alias("content"))))
        .when(kind == 1, F.to_json(F.struct(items.alias("audioFeatures"))))
        .when(kind == 2, F.to_json(F.struct(items.alias("data"))))
        .when(kind == 3, F.to_json(items))
        .otherwise(F.to_json(F.struct(items.alias("other"))))
    )
    return tracks.select(F.col("vec_id").alias("payload_no"), payload.alias("payload"))


def feature_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = feature_payloads(spark, sf_dir)
    requested = fixtures.plays(spark, sf_dir).select("track_id")
    return payloads.feature_payload(rows, requested)


def track_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    def image(suffix: str, width: int):
        return F.struct(F.concat("image_url", F.lit(suffix)).alias("url"), F.lit(width).alias("width"))

    images = F.when(F.col("vec_id") % 2 == 0, F.array(image("/640", 640), image("/300", 300))).otherwise(
        F.array(image("/640", 640))
    )
    track = F.struct(
        F.col("track_id").alias("id"),
        F.col("track_name").alias("name"),
        F.transform("artist_names", lambda n: F.struct(n.alias("name"))).alias("artists"),
        F.struct(images.alias("images")).alias("album"),
    )
    tracks = F.array(track, F.when(F.lit(False), track))
    return fixtures.tracks(spark, sf_dir).select(
        F.col("vec_id").alias("payload_no"),
        F.to_json(F.struct(tracks.alias("tracks")), {"ignoreNullFields": "false"}).alias("payload"),
    )


def track_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    return payloads.track_payload(track_payloads(spark, sf_dir))


def batch_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = fresh_dir(spark, "ingestions")
    rows = arrived(sessions(spark, sf_dir)).select("listener_id", "track_id", "played_at", "session_id")
    path = store.write_batch(rows, folder, datetime(2024, 1, 31, 0, 0))
    name = F.regexp_extract("_metadata.file_path", r"/(ingestion_[^/]*)/", 1)
    return spark.read.parquet(path).select("*", name.alias("batch"))


def _slim(rows: DataFrame) -> DataFrame:
    return rows.select(*HISTORY.fieldNames())


def upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _slim(history(spark, sf_dir))
    renamed = arrived(rows).withColumn("track_name", F.concat(F.lit("new "), "track_name"))
    return upserted(before(rows), renamed)


def stored_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A first write, then the same batch twice."""
    path = fresh_dir(spark, "history")
    rows = _slim(history(spark, sf_dir))
    renamed = arrived(rows).withColumn("track_name", F.concat(F.lit("new "), "track_name"))
    store.update_history(spark, path, before(rows))
    store.update_history(spark, path, renamed)
    return store.update_history(spark, path, renamed)


def mood_dataset_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = store.write_dataset(mood_samples(history(spark, sf_dir)), fresh_dir(spark, "mood-dataset"))
    return stored.groupBy("target_mood_cluster").agg(F.count("*").alias("n"), F.avg("valence_mean").alias("valence"))


def session_dataset_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = session_samples(sessions(spark, sf_dir)).withColumn("month", F.date_format("date", "yyyy-MM"))
    stored = store.write_dataset(samples, fresh_dir(spark, "session-dataset"), ["month"])
    return stored.groupBy("date").agg(F.count("*").alias("n"), F.sum("target_session_start").alias("starts"))


def mood_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_dir(spark, "moods")
    mood_store.save_moods(moods(spark, sf_dir), path)
    document = spark.read.json(path)
    return document.select(
        F.col("optimal_k").cast("int").alias("optimal_k"),
        F.size("clusters").alias("n_clusters"),
        F.element_at("clusters", 1)["label"].alias("first_label"),
    )


def log_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three runs, of which only the second trained a model."""
    path = fresh_dir(spark, "metrics")
    days = _log(spark, sf_dir)
    for run, trained in (("2024-01-10", False), ("2024-01-20", True), ("2024-01-30", False)):
        known = days.filter(F.col("run_at") <= F.lit(run).cast("date"))
        accuracy = F.when(F.lit(trained), F.avg("val_accuracy"))
        entry = known.agg(F.sum("num_tracks").alias("num_tracks"), accuracy.alias("a"), F.count("*").alias("n")).select(
            F.lit(run).cast("timestamp").alias("run_at"),
            "num_tracks",
            F.col("n").alias("num_sessions"),
            *[
                F.when(
                    F.col("a").isNotNull(),
                    F.struct(
                        *[
                            (F.col("a") if f.name == "val_accuracy" else F.lit(None).cast(f.dataType)).alias(f.name)
                            for f in kind.fields
                        ]
                    ),
                ).alias(block)
                for block, kind in (
                    ("mood_model", metrics_log.MOOD_METRICS),
                    ("session_model", metrics_log.SESSION_METRICS),
                )
            ],
            F.lit(None).cast(metrics_log.DRIFT).alias("drift"),
        )
        metrics_log.append_entry(spark, path, entry)
    log = metrics_log.read_log(spark, path)
    return log.select(
        "run_at",
        "num_tracks",
        "num_sessions",
        F.col("mood_model.val_accuracy").alias("mood_accuracy"),
        F.col("session_model.val_accuracy").alias("session_accuracy"),
    )


def enriched_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From payload text to plays with features."""
    plays = payloads.play_payload(play_payloads(spark, sf_dir))
    tracks = fixtures.tracks(spark, sf_dir)
    items = F.array(F.struct(F.col("track_id").alias("spotify_id"), *PAYLOAD_FEATURES))
    texts = tracks.select(F.col("vec_id").alias("payload_no"), F.to_json(items).alias("payload"))
    rows = with_features(plays, payloads.feature_payload(texts))
    return rows.select(F.col("payload_no").alias("event_id"), "track_id", *FEATURES)


QUERIES = {
    "A1_history_scan": scan,
    "A2_latest_batch": latest_batch,
    "A3_mood_table_load": mood_table,
    "A4_play_payload": play_payload,
    "A5_feature_payload": feature_payload,
    "A6_track_payload": track_payload,
    "A7_batch_write": batch_write,
    "A8_history_upsert": upsert,
    "A8_stored_history_upsert": stored_upsert,
    "A9_mood_dataset_write": mood_dataset_write,
    "A9_session_dataset_write": session_dataset_write,
    "A10_mood_document_write": mood_document,
    "A11_metrics_log_append": log_append,
    "A4_payloads_to_features": enriched_payloads,
}

_HISTORY = f"""listener_id, track_id, played_at, {{name}} AS track_name, artist_name, image_url,
  {r6("valence", "energy", "danceability", "acousticness", "instrumentalness", "tempo", "tempo_norm")},
  session_id, mood_cluster_id"""
_RENAMED = f"CASE WHEN played_at >= '{BATCH_FROM}' THEN 'new ' || track_name ELSE track_name END"

SQL = {
    "A1_history_scan": f"SELECT {_HISTORY.format(name='track_name')} FROM hist",
    "A2_latest_batch": f"""
SELECT listener_id, track_id, played_at, event_id FROM plays WHERE played_at >= '{BATCH_FROM}'""",
    "A3_mood_table_load": f"SELECT cluster_id, label, {FEATURES_R6} FROM moods",
    "A4_play_payload": "SELECT listener_id, event_id, track_id, played_at, track_name, artist_name FROM plays",
    "A5_feature_payload": f"""
SELECT track_id, {r6("valence", "energy", "danceability", "acousticness", "instrumentalness", "tempo")}
FROM tracks WHERE vec_id % 5 <> 4 AND track_id IN (SELECT track_id FROM plays)""",
    "A6_track_payload": """
SELECT track_id, track_name, artist_name,
  image_url || CASE WHEN vec_id % 2 = 0 THEN '/300' ELSE '/640' END AS image_url FROM tracks""",
    "A7_batch_write": f"""
SELECT listener_id, track_id, played_at, session_id, 'ingestion_20240131_000000.parquet' AS batch
FROM sess WHERE played_at >= '{BATCH_FROM}'""",
    "A8_history_upsert": f"SELECT {_HISTORY.format(name=_RENAMED)} FROM hist WHERE mood_cluster_id IS NOT NULL",
    "A8_stored_history_upsert": f"SELECT {_HISTORY.format(name=_RENAMED)} FROM hist WHERE mood_cluster_id IS NOT NULL",
    "A9_mood_dataset_write": f"""
, {MOOD_SAMPLES} SELECT target_mood_cluster, count(*) AS n, {rx("avg(valence_mean)", "valence")}
FROM mood_samples GROUP BY ALL""",
    "A9_session_dataset_write": f"""
, {SESSION_SAMPLES} SELECT date, count(*) AS n, CAST(sum(target_session_start) AS BIGINT) AS starts
FROM session_samples GROUP BY ALL""",
    "A10_mood_document_write": """
SELECT CAST(count(*) AS INTEGER) AS optimal_k, count(*) AS n_clusters, arg_min(label, cluster_id) AS first_label
FROM moods""",
    "A11_metrics_log_append": f"""
, {LOG_SQL}, runs AS (SELECT unnest([DATE '2024-01-10', DATE '2024-01-20', DATE '2024-01-30']) AS day),
trained AS (SELECT avg(val_accuracy) AS a FROM log WHERE run_at <= DATE '2024-01-20')
SELECT CAST(day AS TIMESTAMP) AS run_at, CAST(sum(num_tracks) AS BIGINT) AS num_tracks, count(*) AS num_sessions,
  {rx("CASE WHEN day >= DATE '2024-01-20' THEN (SELECT a FROM trained) END", "mood_accuracy")},
  {rx("CASE WHEN day >= DATE '2024-01-20' THEN (SELECT a FROM trained) END", "session_accuracy")}
FROM runs JOIN log ON run_at <= day GROUP BY day""",
    "A4_payloads_to_features": f"""
SELECT p.event_id, p.track_id, {", ".join(f"round(t.{n}, 6) + 0.0 AS {n}" for n in FEATURES)}
FROM plays p JOIN tracks t USING (track_id)""",
}
