"""Windows over plays, sessions and days."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moodstream import fixtures
from moodstream.operators import export, ingest
from moodstream.operators.mood_dataset import latest_window, mood_samples, scoring_context
from moodstream.operators.session_dataset import SAMPLE_COLUMNS, hourly_scoring_frame, session_samples
from moodstream.operators.sessions import play_gaps, sessionise
from moodstream.plans.catalog.common import (
    BATCH_FROM,
    HISTORY_TO,
    arrived,
    before,
    history,
    r6,
    rx,
    sessions,
)
from moodstream.plans.catalog.projections import MOOD_SAMPLES, SESSION_SAMPLES, session_samples_sql
from moodstream.plans.catalog.scalars import CYCLIC_SQL
from moodstream.schemas import FEATURES

KEY = ["listener_id", "session_id", "played_at"]
SCORE_DATE = "2024-01-31"


def gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return play_gaps(fixtures.plays(spark, sf_dir)).select("event_id", "gap_minutes")


def sessionised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions(spark, sf_dir).select("event_id", "listener_id", "session_id")


def default_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessionise(fixtures.plays(spark, sf_dir)).select("event_id", "listener_id", "session_id")


def one_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All plays as a single listener's: the session numbering must not depend on one task holding a listener."""
    plays = fixtures.plays(spark, sf_dir).withColumn("listener_id", F.lit(0).cast("long"))
    return sessionise(plays, 10).select("event_id", "session_id")


def sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = mood_samples(history(spark, sf_dir))
    return samples.select(*KEY, "mood_cluster_0", "mood_cluster_1", "mood_cluster_2")


def rolling_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = mood_samples(history(spark, sf_dir))
    return samples.select(*KEY, *[f"{n}_{s}" for n in FEATURES for s in ("mean", "std")])


def context(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = mood_samples(history(spark, sf_dir))
    return samples.select(*KEY, "session_position", "session_length", "time_since_session_start")


def target(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mood_samples(history(spark, sf_dir)).select(*KEY, "target_mood_cluster")


def rolling_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return session_samples(sessions(spark, sf_dir)).select(
        "listener_id",
        "date",
        "hour",
        "rolling_listening_frequency_7d",
        "rolling_listening_frequency_30d",
        "avg_session_duration_last_7d",
        "total_tracks_last_7d",
        "total_tracks_last_30d",
    )


def since_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = session_samples(sessions(spark, sf_dir))
    return samples.select("listener_id", "date", "hour", "time_since_last_session", "target_session_start")


def _copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    plays = fixtures.plays(spark, sf_dir).select("listener_id", "track_id", "played_at", "event_id")
    old = before(plays).withColumn("source", F.lit(0))
    return old.unionByName(arrived(plays).withColumn("source", F.lit(1)))


def keep_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.one_per_key(_copies(spark, sf_dir), [F.desc("source")])


def keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.one_per_key(_copies(spark, sf_dir), [F.asc("source")])


def preceding_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = history(spark, sf_dir)
    late = rows.filter(F.col("played_at") >= F.lit(HISTORY_TO).cast("timestamp"))
    return scoring_context(late, before(rows)).filter("ready").drop("ready", "mood_cluster_id")


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One run per listener and day; metrics only on days of listening when a model was trained (every fifth)."""
    days = fixtures.plays(spark, sf_dir).groupBy("listener_id", F.to_date("played_at").alias("run_at"))
    trained = F.dayofmonth("run_at") % 5 == 0
    return days.agg(F.count("*").alias("num_tracks"), F.avg("value").alias("v")).select(
        "listener_id",
        "run_at",
        "num_tracks",
        F.when(trained, F.col("v") / 100).alias("val_accuracy"),
        F.when(trained & (F.col("num_tracks") > 2), F.col("v") / 50).alias("val_f1"),
    )


def carried(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export.carried_forward(_log(spark, sf_dir), ["val_accuracy", "val_f1"])


def scoring_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hourly_scoring_frame(sessions(spark, sf_dir), F.lit(SCORE_DATE).cast("date"))


def next_mood_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest_window(history(spark, sf_dir))


QUERIES = {
    "E1_gap_to_previous": gaps,
    "E2_sessionise": sessionised,
    "E2_sessionise_default_gap": default_sessions,
    "E2_sessionise_one_history": one_history,
    "E3_mood_sequence": sequence,
    "E4_rolling_mean_and_std": rolling_stats,
    "E5_session_context": context,
    "E6_next_mood_target": target,
    "E7_rolling_days": rolling_days,
    "E8_time_since_last_session": since_last,
    "E9_keep_last_copy": keep_last,
    "E9_keep_first_copy": keep_first,
    "E10_preceding_context": preceding_context,
    "E11_carried_metrics": carried,
    "E12_hourly_scoring_frame": scoring_hours,
    "E13_latest_window": next_mood_row,
}


def _sessions_sql(minutes: int, part: str) -> str:
    return f"""
SELECT event_id, {"listener_id, " if part else ""}CAST(sum(CASE WHEN gap > INTERVAL {minutes} MINUTE THEN 1 ELSE 0 END)
  OVER ({part} ORDER BY played_at, track_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session_id
FROM (SELECT *, played_at - lag(played_at) OVER ({part} ORDER BY played_at, track_id) AS gap FROM plays)"""


_KEYS = "listener_id, session_id, played_at"
_STATS = [f"{n}_{s}" for n in FEATURES for s in ("mean", "std")]
LOG_SQL = """
log AS (
  SELECT listener_id, CAST(played_at AS DATE) AS run_at, count(*) AS num_tracks,
    CASE WHEN day(CAST(played_at AS DATE)) % 5 = 0 THEN avg(value) / 100 END AS val_accuracy,
    CASE WHEN day(CAST(played_at AS DATE)) % 5 = 0 AND count(*) > 2 THEN avg(value) / 50 END AS val_f1
  FROM plays GROUP BY listener_id, CAST(played_at AS DATE)
)"""
_BACK = "PARTITION BY listener_id, session_id ORDER BY played_at, track_id"

SQL = {
    "E1_gap_to_previous": f"""
SELECT event_id, {rx("(epoch_us(played_at) - epoch_us(previous_played_at)) / 6e7::DOUBLE", "gap_minutes")} FROM gaps""",
    "E2_sessionise": "SELECT event_id, listener_id, session_id FROM sess",
    "E2_sessionise_default_gap": _sessions_sql(30, "PARTITION BY listener_id"),
    "E2_sessionise_one_history": _sessions_sql(10, ""),
    "E3_mood_sequence": f"""
, {MOOD_SAMPLES} SELECT {_KEYS}, mood_cluster_0, mood_cluster_1, mood_cluster_2 FROM mood_samples""",
    "E4_rolling_mean_and_std": f", {MOOD_SAMPLES} SELECT {_KEYS}, {r6(*_STATS)} FROM mood_samples",
    "E5_session_context": f"""
, {MOOD_SAMPLES} SELECT {_KEYS}, session_position, session_length, {r6("time_since_session_start")}
FROM mood_samples""",
    "E6_next_mood_target": f", {MOOD_SAMPLES} SELECT {_KEYS}, target_mood_cluster FROM mood_samples",
    "E7_rolling_days": f"""
, {SESSION_SAMPLES} SELECT listener_id, date, hour, rolling_listening_frequency_7d, rolling_listening_frequency_30d,
  {r6("avg_session_duration_last_7d")}, total_tracks_last_7d, total_tracks_last_30d FROM session_samples""",
    "E8_time_since_last_session": f"""
, {SESSION_SAMPLES} SELECT listener_id, date, hour, {r6("time_since_last_session")}, target_session_start
FROM session_samples""",
    "E9_keep_last_copy": f"""
SELECT listener_id, track_id, played_at, event_id, CASE WHEN played_at >= '{BATCH_FROM}' THEN 1 ELSE 0 END AS source
FROM plays""",
    "E9_keep_first_copy": f"""
SELECT listener_id, track_id, played_at, event_id, CASE WHEN played_at >= '{HISTORY_TO}' THEN 1 ELSE 0 END AS source
FROM plays""",
    "E10_preceding_context": f"""
, c AS (
  SELECT *, lag(mood_cluster_id, 3) OVER w AS mood_cluster_0, lag(mood_cluster_id, 2) OVER w AS mood_cluster_1,
    lag(mood_cluster_id, 1) OVER w AS mood_cluster_2, count(mood_cluster_id) OVER f AS moods,
    {", ".join(f"avg({n}) OVER f AS {n}_mean, stddev_pop({n}) OVER f AS {n}_std" for n in FEATURES)},
    row_number() OVER w AS session_position, min(played_at) OVER s AS session_start
  FROM hist WINDOW w AS ({_BACK}), f AS ({_BACK} ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING),
    s AS (PARTITION BY listener_id, session_id)
)
SELECT listener_id, session_id, played_at, track_id, mood_cluster_0, mood_cluster_1, mood_cluster_2, {r6(*_STATS)},
  {CYCLIC_SQL}, session_position, session_position AS session_length,
  {rx("(epoch_us(played_at) - epoch_us(session_start)) / 6e7::DOUBLE", "time_since_session_start")},
  {", ".join(rx(f"coalesce({n}, 0)", f"current_{n}") for n in FEATURES)}
FROM c WHERE played_at >= '{HISTORY_TO}' AND moods = 3""",
    "E11_carried_metrics": f"""
, {LOG_SQL}
SELECT listener_id, run_at, num_tracks, {", ".join(
    rx(f"last_value({c} IGNORE NULLS) OVER (PARTITION BY listener_id ORDER BY run_at)", c)
    for c in ("val_accuracy", "val_f1"))} FROM log""",
    "E12_hourly_scoring_frame": f"""
, {session_samples_sql(f"SELECT DISTINCT listener_id, DATE '{SCORE_DATE}' AS date FROM starts")}
SELECT listener_id, date, {", ".join(
    c if c in ("hour", "day_of_month", "is_weekend") or c.startswith(("rolling", "total")) else rx(c, c)
    for c in SAMPLE_COLUMNS)} FROM session_samples""",
    "E13_latest_window": f"""
, known AS (SELECT * FROM hist WHERE mood_cluster_id IS NOT NULL),
sizes AS (SELECT listener_id, session_id, count(*) AS size FROM known GROUP BY ALL),
latest AS (SELECT listener_id, max(session_id) AS session_id, arg_max(size, session_id) AS size FROM sizes GROUP BY 1),
tail AS (
  SELECT *, row_number() OVER (PARTITION BY listener_id ORDER BY session_id DESC, played_at DESC, track_id DESC) AS r
  FROM known QUALIFY r <= 3
), taken AS (
  SELECT listener_id, count(*) AS taken, max(played_at) AS played_at,
    {", ".join(f"max(mood_cluster_id) FILTER (r = {3 - i}) AS mood_cluster_{i}" for i in range(3))},
    {", ".join(f"avg({n}) AS {n}_mean, stddev_pop({n}) AS {n}_std, max({n}) FILTER (r = 1) AS current_{n}"
               for n in FEATURES)}
  FROM tail GROUP BY listener_id
)
SELECT listener_id, session_id, played_at, mood_cluster_0, mood_cluster_1, mood_cluster_2, {r6(*_STATS)}, {CYCLIC_SQL},
  CASE WHEN size >= 3 THEN size ELSE taken END AS session_position,
  CASE WHEN size >= 3 THEN size ELSE taken END AS session_length, 0.0::DOUBLE AS time_since_session_start,
  {r6(*[f"current_{n}" for n in FEATURES])} FROM taken JOIN latest USING (listener_id)""",
}
