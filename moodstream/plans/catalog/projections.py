"""Filters and projections."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moodstream import fixtures
from moodstream.operators import drift, export, splits
from moodstream.operators.ingest import after_high_water
from moodstream.operators.mood_dataset import mood_samples
from moodstream.operators.moods import assign_moods, complete
from moodstream.operators.session_dataset import session_samples
from moodstream.plans.catalog.common import (
    AS_OF,
    BATCH_FROM,
    FEATURES_R6,
    HISTORY_TO,
    arrived,
    before,
    history,
    points,
    r6,
    rx,
    sessions,
)
from moodstream.schemas import FEATURES
from moodstream.sources.payloads import with_required_keys

PLAY = ["listener_id", "track_id", "played_at"]


def high_water(spark: SparkSession, sf_dir: str) -> DataFrame:
    plays = fixtures.plays(spark, sf_dir).select(*PLAY, "event_id")
    return after_high_water(arrived(plays), before(plays))


def required_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    track = (
        F.when(F.col("event_type") == "signup", "")
        .when(F.col("event_type") == "error", None)
        .otherwise(F.col("track_id"))
    )
    plays = fixtures.plays(spark, sf_dir).select("event_id", "played_at", "event_type")
    named = fixtures.plays(spark, sf_dir).select("event_id", "played_at", track.alias("track_id"))
    return with_required_keys(named).join(plays.select("event_id", "event_type"), "event_id")


def subset_not_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = history(spark, sf_dir).na.drop(subset=["mood_cluster_id", "session_id"])
    return rows.select(*PLAY, "session_id", "mood_cluster_id")


def none_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.plays(spark, sf_dir).select(*PLAY, *FEATURES, "tempo").na.drop("any")


def complete_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return complete(fixtures.plays(spark, sf_dir)).select("event_id", *FEATURES)


def needs_mood(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = F.when(F.col("event_type") == "view", 99).cast("int")
    plays = fixtures.plays(spark, sf_dir).withColumn("mood_cluster_id", given)
    return assign_moods(plays, points(spark, sf_dir)).select("event_id", "mood_cluster_id")


def periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift.split_periods(sessions(spark, sf_dir))


def rolling_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.last_days(fixtures.scored_rows(spark, sf_dir), 20)


def last_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    as_of = F.lit(AS_OF).cast("timestamp")
    return export.last_day(fixtures.plays(spark, sf_dir), as_of).select(*PLAY, "event_id")


def zero_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.filled(fixtures.plays(spark, sf_dir), FEATURES).select("event_id", *FEATURES)


def display_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    plays = fixtures.plays(spark, sf_dir).select(
        "event_id",
        F.when(F.col("event_type") != "error", F.col("track_name")).alias("track_name"),
        F.when(F.col("event_type") != "signup", F.col("artist_name")).alias("artist_name"),
    )
    return export.with_display_names(plays)


def assembled(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = session_samples(sessions(spark, sf_dir))
    columns = splits.feature_columns(samples, "target_session_start")
    total = F.lit(0.0)
    for name in columns:
        total = total + F.col(name)
    filled = splits.filled(samples.withColumn("at", F.col("hour")), columns)
    return filled.select("listener_id", "date", "at", F.lit(len(columns)).alias("n_features"), total.alias("total"))


def whole_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sessions(spark, sf_dir).withColumn("mood_cluster_id", F.lit(1))
    return mood_samples(rows).select("listener_id", "session_id", "session_position")


def long_enough(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = mood_samples(history(spark, sf_dir))
    return samples.groupBy("listener_id", "session_id").agg(
        F.count("*").alias("n_samples"), F.max("session_length").alias("session_length")
    )


def absent_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fixtures.plays(spark, sf_dir).drop("tempo_norm", "energy")
    return splits.filled(rows, FEATURES).select("event_id", *FEATURES)


QUERIES = {
    "B1_high_water_filter": high_water,
    "B2_required_keys": required_keys,
    "B3_not_null_subset": subset_not_null,
    "B4_no_nulls_at_all": none_null,
    "B5_complete_features": complete_features,
    "B6_needs_mood": needs_mood,
    "B7_recent_and_prior_periods": periods,
    "B8_rolling_days": rolling_days,
    "B9_last_24_hours": last_day,
    "B10_zero_filled_features": zero_filled,
    "B11_display_names": display_names,
    "B12_features_by_exclusion": assembled,
    "B13_whole_windows": whole_windows,
    "B14_long_enough_sessions": long_enough,
    "B15_absent_features": absent_features,
}

# Session days with their period, as a CTE body.
PERIOD_DAYS = """
days AS (
  SELECT listener_id, session_id, CAST(played_at AS DATE) AS date, min(played_at) AS first_play,
    max(played_at) AS last_play, count(*) AS n_plays
  FROM sess GROUP BY ALL
), newest AS (
  SELECT listener_id, max(date) AS newest FROM days GROUP BY listener_id
), period_days AS (
  SELECT d.*, CASE WHEN d.date >= newest - 7 THEN 'recent' ELSE 'prior' END AS period
  FROM days d JOIN newest USING (listener_id) WHERE d.date >= newest - 37
)"""

# The hour grid of session-start samples, as CTE bodies.
def session_samples_sql(grid_days: str) -> str:
    """CTE bodies of the session-start samples over the given listener dates."""
    return f"""
start_hours AS (SELECT DISTINCT listener_id, date, hour FROM starts),
span AS (
  SELECT listener_id, CAST(min(played_at) AS DATE) AS a, CAST(max(played_at) AS DATE) AS b FROM sess GROUP BY ALL
), grid_days AS (
  {grid_days}
), grid AS (
  SELECT listener_id, date, CAST(unnest(range(24)) AS INTEGER) AS hour FROM grid_days
), freq AS (
  SELECT g.listener_id, g.date, g.hour,
    count(s.date) FILTER (s.date >= g.date - 7) AS rolling_listening_frequency_7d, count(s.date) AS f30
  FROM grid g LEFT JOIN start_hours s
    ON s.listener_id = g.listener_id AND s.hour = g.hour AND s.date >= g.date - 30 AND s.date < g.date
  GROUP BY ALL
), prev AS (
  SELECT g.listener_id, g.date, g.hour, max(s.date + s.hour * INTERVAL 1 HOUR) AS last_start
  FROM grid g LEFT JOIN start_hours s
    ON s.listener_id = g.listener_id AND (s.date < g.date OR (s.date = g.date AND s.hour < g.hour))
  GROUP BY ALL
), firsts AS (
  SELECT listener_id, min(date + hour * INTERVAL 1 HOUR) AS first_start FROM start_hours GROUP BY ALL
), dur AS (
  SELECT g.listener_id, g.date, 
    sum(epoch_us(s.session_end) - epoch_us(s.session_start)) / count(s.session_id) / 6e7::DOUBLE AS d7
  FROM grid_days g LEFT JOIN starts s ON s.listener_id = g.listener_id AND s.date >= g.date - 7 AND s.date < g.date
  GROUP BY ALL
), day_tracks AS (
  SELECT listener_id, CAST(played_at AS DATE) AS date, count(*) AS n FROM sess GROUP BY ALL
), trk AS (
  SELECT g.listener_id, g.date, CAST(coalesce(sum(t.n) FILTER (t.date >= g.date - 7), 0) AS BIGINT) AS t7,
    CAST(coalesce(sum(t.n), 0) AS BIGINT) AS t30
  FROM grid_days g LEFT JOIN day_tracks t
    ON t.listener_id = g.listener_id AND t.date >= g.date - 30 AND t.date < g.date
  GROUP BY ALL
), session_samples AS (
  SELECT g.listener_id, g.date, g.hour,
    sin(2 * pi() * g.hour / 24.0::DOUBLE) AS hour_sin, cos(2 * pi() * g.hour / 24.0::DOUBLE) AS hour_cos,
    sin(2 * pi() * (isodow(g.date) - 1) / 7.0::DOUBLE) AS day_sin,
    cos(2 * pi() * (isodow(g.date) - 1) / 7.0::DOUBLE) AS day_cos,
    day(g.date) AS day_of_month, CASE WHEN isodow(g.date) >= 6 THEN 1 ELSE 0 END AS is_weekend,
    rolling_listening_frequency_7d, f30 AS rolling_listening_frequency_30d,
    coalesce((epoch_us(g.date + g.hour * INTERVAL 1 HOUR) - epoch_us(last_start)) / 3.6e9::DOUBLE,
      least((epoch_us(g.date + g.hour * INTERVAL 1 HOUR) - epoch_us(first_start)) / 3.6e9::DOUBLE, 168),
      168) AS time_since_last_session,
    coalesce(d7, 0) AS avg_session_duration_last_7d, t7 AS total_tracks_last_7d, t30 AS total_tracks_last_30d,
    CASE WHEN h.hour IS NULL THEN 0 ELSE 1 END AS target_session_start
  FROM grid g JOIN freq USING (listener_id, date, hour) JOIN prev USING (listener_id, date, hour)
    JOIN dur USING (listener_id, date) JOIN trk USING (listener_id, date) LEFT JOIN firsts USING (listener_id)
    LEFT JOIN start_hours h ON h.listener_id = g.listener_id AND h.date = g.date AND h.hour = g.hour
)"""


SESSION_SAMPLES = session_samples_sql(
    "SELECT listener_id, CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS date FROM span"
)

_SAMPLE_FEATURES = [
    "hour", "hour_sin", "hour_cos", "day_sin", "day_cos", "day_of_month", "is_weekend",
    "rolling_listening_frequency_7d", "rolling_listening_frequency_30d", "time_since_last_session",
    "avg_session_duration_last_7d", "total_tracks_last_7d", "total_tracks_last_30d",
]

# Mood samples before rounding, as CTE bodies over `known` plays.
_WINDOW = "PARTITION BY listener_id, session_id ORDER BY played_at, track_id"
_COMPLETE_COUNT = " + ".join(f"count({n}) OVER f" for n in FEATURES)
MOOD_SAMPLES = f"""
known AS (SELECT * FROM hist WHERE mood_cluster_id IS NOT NULL),
framed AS (
  SELECT *,
    lag(mood_cluster_id, 2) OVER w AS mood_cluster_0, lag(mood_cluster_id, 1) OVER w AS mood_cluster_1,
    mood_cluster_id AS mood_cluster_2, lead(mood_cluster_id) OVER w AS target_mood_cluster,
    {", ".join(f"avg({n}) OVER f AS {n}_mean, stddev_pop({n}) OVER f AS {n}_std" for n in FEATURES)},
    {_COMPLETE_COUNT} AS present,
    row_number() OVER w AS pos, count(*) OVER s AS session_length, min(played_at) OVER s AS session_start
  FROM known
  WINDOW w AS ({_WINDOW}), f AS ({_WINDOW} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW),
    s AS (PARTITION BY listener_id, session_id)
), mood_samples AS (
  SELECT *, pos AS session_position,
    (epoch_us(played_at) - epoch_us(session_start)) / 6e7::DOUBLE AS time_since_session_start,
    {", ".join(f"{n} AS current_{n}" for n in FEATURES)}
  FROM framed WHERE pos >= 3 AND pos < session_length AND present = 18
)"""

SQL = {
    "B1_high_water_filter": f"""
, top AS (SELECT listener_id, max(played_at) AS m FROM plays WHERE played_at < '{HISTORY_TO}' GROUP BY ALL)
SELECT listener_id, track_id, played_at, event_id FROM plays LEFT JOIN top USING (listener_id)
WHERE played_at >= '{BATCH_FROM}' AND (m IS NULL OR played_at > m)""",
    "B2_required_keys": """
SELECT event_id, played_at, track_id, event_type FROM plays WHERE event_type NOT IN ('signup', 'error')""",
    "B3_not_null_subset": """
SELECT listener_id, track_id, played_at, session_id, mood_cluster_id FROM hist WHERE mood_cluster_id IS NOT NULL""",
    "B4_no_nulls_at_all": f"""
SELECT listener_id, track_id, played_at, {FEATURES_R6}, {r6("tempo")} FROM plays WHERE event_type <> 'error'""",
    "B5_complete_features": f"SELECT event_id, {FEATURES_R6} FROM plays WHERE event_type <> 'error'",
    "B6_needs_mood": """
SELECT event_id, CASE WHEN event_type = 'view' THEN 99 ELSE mood_cluster_id END AS mood_cluster_id FROM hist""",
    "B7_recent_and_prior_periods": f", {PERIOD_DAYS} SELECT * FROM period_days",
    "B8_rolling_days": f"""
SELECT listener_id, date, hour, target_session_start, y_pred, {r6("y_proba")} FROM scored
WHERE date >= (SELECT max(date) FROM scored) - 20""",
    "B9_last_24_hours": f"""
SELECT listener_id, track_id, played_at, event_id FROM plays
WHERE played_at >= TIMESTAMP '{AS_OF}' - INTERVAL 1 DAY""",
    "B10_zero_filled_features": "SELECT event_id, "
    + ", ".join(rx(f"coalesce({n}, 0)", n) for n in FEATURES)
    + " FROM plays",
    "B11_display_names": """
SELECT event_id, CASE WHEN event_type = 'error' THEN 'Unknown Track' ELSE track_name END AS track_name,
  CASE WHEN event_type = 'signup' THEN 'Unknown Artist' ELSE artist_name END AS artist_name FROM plays""",
    "B12_features_by_exclusion": f"""
, {SESSION_SAMPLES}
SELECT listener_id, date, hour AS at, {len(_SAMPLE_FEATURES)} AS n_features,
  {rx(" + ".join(_SAMPLE_FEATURES), "total")} FROM session_samples""",
    "B13_whole_windows": """
, n AS (
  SELECT listener_id, session_id, row_number() OVER w AS session_position, count(valence) OVER f AS filled,
    count(*) OVER (PARTITION BY listener_id, session_id) AS size
  FROM sess WINDOW w AS (PARTITION BY listener_id, session_id ORDER BY played_at, track_id),
    f AS (PARTITION BY listener_id, session_id ORDER BY played_at, track_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)
)
SELECT listener_id, session_id, session_position FROM n WHERE filled = 3 AND session_position < size""",
    "B14_long_enough_sessions": f"""
, {MOOD_SAMPLES}
SELECT listener_id, session_id, count(*) AS n_samples, max(session_length) AS session_length
FROM mood_samples GROUP BY ALL""",
    "B15_absent_features": "SELECT event_id, "
    + ", ".join("0.0::DOUBLE AS " + n if n in ("tempo_norm", "energy") else rx(f"coalesce({n}, 0)", n) for n in FEATURES)
    + " FROM plays",
}
