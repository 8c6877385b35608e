"""Orders, top lists, splits, set operations, recommendation."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moodstream import fixtures
from moodstream.operators import export, ingest, splits
from moodstream.operators.mood_dataset import last_plays
from moodstream.operators.session_dataset import session_samples
from moodstream.operators.skew import numbered
from moodstream.plans.catalog.aggregates import ACTUAL_HOURS
from moodstream.plans.catalog.common import (
    BATCH_FROM,
    HISTORY_TO,
    arrived,
    before,
    history,
    points,
    r6,
    rx,
    sessions,
)
from moodstream.plans.catalog.projections import SESSION_SAMPLES
from moodstream.plans.catalog.windows import LOG_SQL, _log
from moodstream.schemas import FEATURES
from moodstream.sources.history import staged


def time_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = numbered(sessions(spark, sf_dir), ["listener_id"], ["played_at", "track_id"])
    return rows.select("event_id", F.col("_pos").alias("place"), F.col("_size").alias("plays"))


def recently_played(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export.recently_played(history(spark, sf_dir))


def top_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    hourly = export.actual_hours(sessions(spark, sf_dir))
    return export.top_hours(hourly, score="share")


def tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = last_plays(sessions(spark, sf_dir), 3)
    return rows.select("listener_id", "session_id", "track_id", "played_at", "recency")


def seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export.seed_tracks(history(spark, sf_dir))


def metric_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export.metric_view(_log(spark, sf_dir)).select("listener_id", "run_at", "num_tracks", "place", "kind")


def time_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = splits.time_split(staged(session_samples(sessions(spark, sf_dir)).select("listener_id", "date", "hour")))
    return parts.select("listener_id", "date", "hour", "part")


def _with_mood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history(spark, sf_dir).na.drop(subset=["mood_cluster_id"]).select("event_id", "event_type", "mood_cluster_id")


def stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.stratified_split(staged(_with_mood(spark, sf_dir)), "mood_cluster_id", ["event_id"])


def random_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.random_split(staged(_with_mood(spark, sf_dir)), ["event_id"])


def class_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    late = F.col("mood_cluster_id").isin(7, 8) | (F.col("event_type") == "purchase")
    rows = _with_mood(spark, sf_dir).withColumn("part", F.when(late, "val").otherwise("train"))
    return splits.cover_classes(rows, "mood_cluster_id", ["event_id"])


def aligned_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    plays = fixtures.plays(spark, sf_dir)
    return ingest.union_aligned(
        before(plays).select("event_id", "track_id", "valence"),
        arrived(plays).select("event_id", "track_id", "track_name"),
    )


def distinct_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.plays(spark, sf_dir).select("track_id").distinct()


def missing_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    plays = fixtures.plays(spark, sf_dir)
    bought = plays.filter("event_type = 'purchase'").select("track_id")
    known = fixtures.tracks(spark, sf_dir).select("track_id")
    return known.join(bought, "track_id", "left_anti")


def recommended(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = history(spark, sf_dir)
    newest = rows.filter(F.col("mood_cluster_id").isNotNull()).groupBy("listener_id").agg(
        F.max_by("mood_cluster_id", "played_at").alias("mood_cluster_id")
    )
    return export.recommend(rows, newest, points(spark, sf_dir))


def nearest_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export.nearest_tracks(export.track_catalogue(history(spark, sf_dir)), points(spark, sf_dir), export.SEED_TRACKS + 1)


QUERIES = {
    "F1_time_order": time_order,
    "F2_recently_played": recently_played,
    "F3_top_hours": top_hours,
    "F4_last_plays": tail,
    "F5_seed_tracks": seeds,
    "F6_metric_view": metric_view,
    "F7_time_split": time_split,
    "F8_stratified_split": stratified_split,
    "F8_random_split": random_split,
    "F9_class_coverage": class_coverage,
    "G1_aligned_union": aligned_union,
    "G2_distinct_tracks": distinct_tracks,
    "G3_missing_tracks": missing_tracks,
    "N1_recommended_tracks": recommended,
    "N1_nearest_tracks": nearest_tracks,
}

_HASH = "substring(md5(CAST(event_id AS VARCHAR) || '|42'), 1, 8)"
_SHIFTS = "(VALUES (0, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE), (1, 0.1, 0.08, 0.1), (2, -0.1, -0.08, -0.1)) q(variant, dv, de, dd)"


def _clamped(expression: str, name: str) -> str:
    return f"greatest(0.0::DOUBLE, least(1.0::DOUBLE, {expression})) AS {name}"


_NEAREST = f"""
queries AS (
  SELECT cluster_id AS mood_cluster_id, variant, {_clamped("valence + dv", "valence")},
    {_clamped("energy + de", "energy")}, {_clamped("danceability + dd", "danceability")},
    acousticness, instrumentalness, tempo_norm
  FROM centroids JOIN {_SHIFTS} ON true
), catalogue AS (
  SELECT DISTINCT track_id, {", ".join(FEATURES)} FROM hist WHERE valence IS NOT NULL
), pairs AS (
  SELECT q.mood_cluster_id, q.variant, c.track_id,
    sqrt({" + ".join(f"(c.{n} - q.{n}) * (c.{n} - q.{n})" for n in FEATURES)}) AS distance
  FROM queries q JOIN catalogue c ON true
)"""

SQL = {
    "F1_time_order": """
SELECT event_id, row_number() OVER (PARTITION BY listener_id ORDER BY played_at, track_id) - 1 AS place,
  count(*) OVER (PARTITION BY listener_id) AS plays FROM plays""",
    "F2_recently_played": """
SELECT listener_id, track_id, track_name, artist_name, image_url, played_at, mood_cluster_id,
  row_number() OVER (PARTITION BY listener_id ORDER BY played_at DESC, track_id DESC) AS place,
  strftime(played_at, '%Y-%m-%dT%H:%M:%S.%f') || '+00:00' AS played_at_text
FROM hist QUALIFY place <= 25""",
    "F3_top_hours": f"""
, {ACTUAL_HOURS}, s AS (
  SELECT *, sessions / max(sessions) OVER (PARTITION BY listener_id) AS share FROM actual
)
SELECT listener_id, hour, sessions, {rx("s.share", "share")},
  row_number() OVER (PARTITION BY listener_id ORDER BY s.share DESC, hour) AS place FROM s QUALIFY place <= 3""",
    "F4_last_plays": """
SELECT listener_id, session_id, track_id, played_at,
  row_number() OVER (PARTITION BY listener_id ORDER BY played_at DESC, track_id DESC) AS recency
FROM sess QUALIFY recency <= 3""",
    "F5_seed_tracks": """
, t AS (
  SELECT listener_id, mood_cluster_id, track_id, max(played_at) AS last_played_at
  FROM hist WHERE mood_cluster_id IS NOT NULL GROUP BY ALL
)
SELECT *, row_number() OVER (PARTITION BY listener_id, mood_cluster_id ORDER BY last_played_at DESC, track_id) AS place
FROM t QUALIFY place <= 5""",
    "F6_metric_view": f"""
, {LOG_SQL}
SELECT listener_id, run_at, num_tracks, row_number() OVER (PARTITION BY listener_id ORDER BY run_at DESC) AS place,
  CASE WHEN place = 1 THEN 'latest' ELSE 'history' END AS kind FROM log QUALIFY place <= 11""",
    "F7_time_split": f"""
, {SESSION_SAMPLES}
SELECT listener_id, date, hour, CASE WHEN row_number() OVER (ORDER BY date, hour, listener_id % 1024, listener_id)
  <= floor(0.8::DOUBLE * count(*) OVER ()) THEN 'train' ELSE 'val' END AS part FROM grid""",
    "F8_stratified_split": f"""
SELECT event_id, event_type, mood_cluster_id, CASE WHEN
  row_number() OVER (PARTITION BY mood_cluster_id ORDER BY {_HASH}, event_id)
  <= floor(0.8::DOUBLE * count(*) OVER (PARTITION BY mood_cluster_id)) THEN 'train' ELSE 'val' END AS part
FROM hist WHERE mood_cluster_id IS NOT NULL""",
    "F8_random_split": f"""
SELECT event_id, event_type, mood_cluster_id, CASE WHEN row_number() OVER (ORDER BY {_HASH}, event_id)
  <= floor(0.8::DOUBLE * count(*) OVER ()) THEN 'train' ELSE 'val' END AS part
FROM hist WHERE mood_cluster_id IS NOT NULL""",
    "F9_class_coverage": """
, m AS (SELECT event_id, event_type, mood_cluster_id,
  CASE WHEN mood_cluster_id IN (7, 8) OR event_type = 'purchase' THEN 'val' ELSE 'train' END AS part
  FROM hist WHERE mood_cluster_id IS NOT NULL)
SELECT event_id, event_type, mood_cluster_id, CASE WHEN mood_cluster_id IN (7, 8)
  AND row_number() OVER (PARTITION BY mood_cluster_id ORDER BY event_id) = 1 THEN 'train' ELSE part END AS part FROM m""",
    "G1_aligned_union": f"""
SELECT event_id, track_id, {r6("valence")}, NULL AS track_name FROM plays WHERE played_at < '{HISTORY_TO}'
UNION ALL SELECT event_id, track_id, NULL, track_name FROM plays WHERE played_at >= '{BATCH_FROM}'""",
    "G2_distinct_tracks": "SELECT DISTINCT track_id FROM plays",
    "G3_missing_tracks": """
SELECT track_id FROM tracks EXCEPT SELECT track_id FROM plays WHERE event_type = 'purchase'""",
    "N1_recommended_tracks": f"""
, {_NEAREST}, wanted AS (
  SELECT listener_id, arg_max(mood_cluster_id, played_at) AS mood_cluster_id
  FROM hist WHERE mood_cluster_id IS NOT NULL GROUP BY 1
), seeds AS (
  SELECT listener_id, mood_cluster_id, track_id FROM (
    SELECT listener_id, mood_cluster_id, track_id, max(played_at) AS m FROM hist
    WHERE mood_cluster_id IS NOT NULL GROUP BY ALL)
  QUALIFY row_number() OVER (PARTITION BY listener_id, mood_cluster_id ORDER BY m DESC, track_id) <= 5
), best AS (
  SELECT listener_id, mood_cluster_id, variant, distance, track_id
  FROM wanted JOIN pairs USING (mood_cluster_id) ANTI JOIN seeds USING (listener_id, mood_cluster_id, track_id)
  QUALIFY row_number() OVER (PARTITION BY listener_id, mood_cluster_id, variant ORDER BY distance, track_id) = 1
)
SELECT listener_id, mood_cluster_id, variant, {r6("distance")}, track_id FROM best
QUALIFY row_number() OVER (PARTITION BY listener_id, mood_cluster_id, track_id ORDER BY variant) = 1""",
    "N1_nearest_tracks": f"""
, {_NEAREST}
SELECT mood_cluster_id, variant, track_id, round(pairs.distance, 6) AS distance FROM pairs
QUALIFY row_number() OVER (PARTITION BY mood_cluster_id, variant ORDER BY pairs.distance, track_id) <= 6""",
}
