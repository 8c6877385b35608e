"""Joins: enrichment, semi and anti joins, lookups, densified grids."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moodstream import fixtures
from moodstream.operators import evaluate, export, ingest
from moodstream.operators.mood_dataset import SESSION, scoring_context
from moodstream.operators.moods import with_nearest
from moodstream.operators.session_dataset import daily_facts, dense_days, hour_grid, session_samples
from moodstream.operators.sessions import session_facts, sessionise
from moodstream.plans.catalog.common import (
    BATCH_FROM,
    FEATURES_R6,
    GAP_MINUTES,
    HISTORY_TO,
    arrived,
    before,
    history,
    moods,
    points,
    r6,
    rx,
    sessions,
)
from moodstream.plans.catalog.projections import SESSION_SAMPLES
from moodstream.schemas import FEATURES

PLAY = ["listener_id", "track_id", "played_at"]


def unseen(spark: SparkSession, sf_dir: str) -> DataFrame:
    plays = fixtures.plays(spark, sf_dir).select(*PLAY, "event_id")
    return ingest.unseen(arrived(plays), before(plays))


def enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    plays = fixtures.plays(spark, sf_dir).select("event_id", "track_id")
    # Features of some tracks are unknown.
    known = fixtures.tracks(spark, sf_dir).filter(F.col("style") != 3)
    return ingest.with_features(plays, known).select("event_id", "tempo", *FEATURES)


def metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    plays = fixtures.plays(spark, sf_dir).select(
        "event_id", "track_id", F.lit("payload name").alias("track_name"), F.lit("payload artist").alias("artist_name")
    )
    known = fixtures.tracks(spark, sf_dir).filter(F.col("style") != 3)
    return ingest.with_metadata(plays, known)


def new_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    plays = fixtures.plays(spark, sf_dir).select(*PLAY, "event_id")
    new = ingest.after_high_water(arrived(plays), before(plays))
    everything = sessionise(ingest.union_aligned(before(plays), new), GAP_MINUTES)
    return ingest.seen_again(everything, new)


def start_with_duration(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = session_facts(sessions(spark, sf_dir))
    return facts.select("listener_id", "session_id", "date", "hour", "duration_minutes")


def nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    plays = fixtures.plays(spark, sf_dir)
    return with_nearest(plays, points(spark, sf_dir)).select("event_id", "nearest_cluster_id", "distance")


def requested(spark: SparkSession, sf_dir: str) -> DataFrame:
    tracks = fixtures.tracks(spark, sf_dir).select("track_id", "style")
    wanted = before(fixtures.plays(spark, sf_dir)).filter(F.col("event_type") == "purchase").select("track_id")
    return tracks.join(wanted.distinct(), "track_id", "left_semi")


def mood_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = history(spark, sf_dir).select("event_id", "mood_cluster_id")
    # Two moods are unknown to the table.
    return export.with_label(rows, moods(spark, sf_dir).filter("cluster_id < 8"))


def hour_priors(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = fixtures.scored_rows(spark, sf_dir)
    prior = evaluate.hour_prior(scored.filter(F.col("hour") >= 4))
    rows = evaluate.with_hour_prior(scored, prior)
    return rows.groupBy("date", "hour").agg(
        F.count("*").alias("n"), F.max("prior_proba").alias("prior_proba"), F.max("prior_pred").alias("prior_pred")
    )


def previous_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = session_samples(sessions(spark, sf_dir))
    return samples.select("listener_id", "date", "hour", "time_since_last_session")


def days_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = session_samples(sessions(spark, sf_dir))
    return samples.select(
        "listener_id",
        "date",
        "hour",
        "rolling_listening_frequency_7d",
        "rolling_listening_frequency_30d",
        "total_tracks_last_7d",
        "total_tracks_last_30d",
    )


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = dense_days(daily_facts(sessions(spark, sf_dir)))
    return hour_grid(days.select("listener_id", "date"))


def scoring_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = history(spark, sf_dir)
    late = rows.filter(F.col("played_at") >= F.lit(HISTORY_TO).cast("timestamp"))
    context = scoring_context(late, before(rows))
    return context.select(*SESSION, "track_id", "played_at", "ready", "session_position")


QUERIES = {
    "C1_unseen_plays": unseen,
    "C2_feature_enrichment": enriched,
    "C3_metadata_override": metadata,
    "C4_new_rows_with_sessions": new_rows,
    "C5_start_with_duration": start_with_duration,
    "C6_nearest_centroid": nearest,
    "C7_requested_tracks": requested,
    "C8_mood_labels": mood_labels,
    "C9_hour_prior_lookup": hour_priors,
    "C10_previous_session": previous_session,
    "C11_days_back": days_back,
    "C12_hour_grid": grid,
    "C13_scoring_union": scoring_union,
}

_NEW = f"""
, top AS (SELECT listener_id, max(played_at) AS m FROM plays WHERE played_at < '{HISTORY_TO}' GROUP BY ALL)
, fresh AS (
  SELECT event_id FROM plays LEFT JOIN top USING (listener_id)
  WHERE played_at >= '{BATCH_FROM}' AND (m IS NULL OR played_at > m)
)"""

SQL = {
    "C1_unseen_plays": f"""
SELECT listener_id, track_id, played_at, event_id
FROM (SELECT listener_id, track_id, played_at, event_id FROM plays WHERE played_at >= '{BATCH_FROM}')
ANTI JOIN (SELECT DISTINCT listener_id, track_id, played_at FROM plays WHERE played_at < '{HISTORY_TO}')
USING (listener_id, track_id, played_at)""",
    "C2_feature_enrichment": f"""
SELECT e.event_id, {r6("tempo")}, {FEATURES_R6}
FROM plays_ids e LEFT JOIN (SELECT * FROM tracks WHERE style <> 3) USING (track_id)""",
    "C3_metadata_override": """
SELECT event_id, track_id, CASE WHEN style <> 3 THEN track_name ELSE 'payload name' END AS track_name,
  CASE WHEN style <> 3 THEN artist_name ELSE 'payload artist' END AS artist_name,
  CASE WHEN style <> 3 THEN image_url END AS image_url FROM plays""",
    "C4_new_rows_with_sessions": f"""
{_NEW}
SELECT listener_id, track_id, played_at, event_id, session_id FROM sess SEMI JOIN fresh USING (event_id)""",
    "C5_start_with_duration": f"""
SELECT listener_id, session_id, date, hour, {r6("duration_minutes")} FROM starts""",
    "C6_nearest_centroid": f"""
SELECT p.event_id, n.cluster_id AS nearest_cluster_id, {rx("sqrt(n.d2)", "distance")}
FROM plays p LEFT JOIN near n USING (event_id)""",
    "C7_requested_tracks": f"""
SELECT track_id, style FROM tracks WHERE track_id IN (
  SELECT track_id FROM plays WHERE event_type = 'purchase' AND played_at < '{HISTORY_TO}')""",
    "C8_mood_labels": """
SELECT event_id, mood_cluster_id, coalesce(label, 'Cluster ' || CAST(mood_cluster_id AS VARCHAR)) AS mood_label
FROM hist LEFT JOIN (SELECT cluster_id, label FROM moods WHERE cluster_id < 8) m ON m.cluster_id = mood_cluster_id""",
    "C9_hour_prior_lookup": f"""
, pri AS (
  SELECT hour, sum(target_session_start) / count(*) AS p FROM scored
  WHERE hour >= 4 AND date < (SELECT max(date) FROM scored WHERE hour >= 4) GROUP BY hour
)
SELECT date, hour, count(*) AS n, {rx("max(coalesce(p, 0))", "prior_proba")},
  max(CASE WHEN coalesce(p, 0) >= 0.5 THEN 1 ELSE 0 END) AS prior_pred
FROM scored LEFT JOIN pri USING (hour) GROUP BY date, hour""",
    "C10_previous_session": f"""
, {SESSION_SAMPLES} SELECT listener_id, date, hour, {r6("time_since_last_session")} FROM session_samples""",
    "C11_days_back": f"""
, {SESSION_SAMPLES} SELECT listener_id, date, hour, rolling_listening_frequency_7d, rolling_listening_frequency_30d,
  total_tracks_last_7d, total_tracks_last_30d FROM session_samples""",
    "C12_hour_grid": f", {SESSION_SAMPLES} SELECT * FROM grid",
    "C13_scoring_union": f"""
, c AS (
  SELECT *, count(mood_cluster_id) OVER w AS moods, row_number() OVER (
    PARTITION BY listener_id, session_id ORDER BY played_at, track_id) AS session_position
  FROM hist WINDOW w AS (PARTITION BY listener_id, session_id ORDER BY played_at, track_id
    ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)
)
SELECT listener_id, session_id, track_id, played_at, moods = 3 AS ready, session_position
FROM c WHERE played_at >= '{HISTORY_TO}'""",
}
SQL["C2_feature_enrichment"] = ", plays_ids AS (SELECT event_id, track_id FROM plays)" + SQL["C2_feature_enrichment"]
