"""Inputs shared by the registered queries, in Spark and in SQL."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from moodstream import fixtures
from moodstream.operators.moods import assign_moods, mean_centroids
from moodstream.operators.sessions import sessionise
from moodstream.schemas import FEATURES
from moodstream.sources.moods import mood_points

# Sessions of the synthetic plays: a pause of six hours, so that many hold four plays or more.
GAP_MINUTES = 360
# History ends before this date; the new batch starts a day earlier, so that the two overlap.
BATCH_FROM, HISTORY_TO = "2024-01-28", "2024-01-29"
AS_OF = "2024-01-30 12:00:00"

_points: dict[str, list[dict]] = {}


def moods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Centroids of the plays of each style (ten styles), with labels."""
    return mean_centroids(fixtures.plays(spark, sf_dir), "style")


def points(spark: SparkSession, sf_dir: str) -> list[dict]:
    """The centroids as values; kept, since every query on moods needs these few rows."""
    if sf_dir not in _points:
        _points[sf_dir] = mood_points(moods(spark, sf_dir))
    return _points[sf_dir]


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessionise(fixtures.plays(spark, sf_dir), GAP_MINUTES)


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plays with session and mood."""
    return assign_moods(sessions(spark, sf_dir), points(spark, sf_dir))


def before(rows: DataFrame) -> DataFrame:
    """The part of plays that counts as stored history."""
    return rows.filter(F.col("played_at") < F.lit(HISTORY_TO).cast("timestamp"))


def arrived(rows: DataFrame) -> DataFrame:
    """The part of plays that counts as a new batch."""
    return rows.filter(F.col("played_at") >= F.lit(BATCH_FROM).cast("timestamp"))


def comparable(rows: DataFrame) -> DataFrame:
    """Doubles to six decimals and stamps without zone, as the SQL gives them."""
    fixes = {}
    for field in rows.schema.fields:
        if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            # Scaled first, which is how the SQL engine rounds; rounding the decimal text differs on exact halves.
            fixes[field.name] = F.round(F.col(field.name) * 1e6) / 1e6
        elif isinstance(field.dataType, T.TimestampType):
            fixes[field.name] = F.col(field.name).cast("timestamp_ntz")
    return rows.withColumns(fixes)


def r6(*names: str) -> str:
    """SQL list of doubles to six decimals, without a negative zero."""
    return ", ".join(f"round({n}, 6) + 0.0 AS {n}" for n in names)


def rx(expression: str, name: str) -> str:
    return f"round({expression}, 6) + 0.0 AS {name}"


FEATURE_LIST = ", ".join(FEATURES)
FEATURES_R6 = r6(*FEATURES)
_NULLABLE = ["valence", "energy", "danceability", "acousticness", "instrumentalness", "tempo", "tempo_norm"]
_COMPLETE = " AND ".join(f"{n} IS NOT NULL" for n in FEATURES)
_DISTANCE = " + ".join(f"(p.{n} - c.{n}) * (p.{n} - c.{n})" for n in FEATURES)


def level_sql(column: str, high: str, low: str, middle: str) -> str:
    return f"CASE WHEN {column} > 0.6 THEN '{high}' WHEN {column} < 0.4 THEN '{low}' ELSE '{middle}' END"


LABEL_SQL = (
    level_sql("energy", "High energy", "Low energy", "Medium energy")
    + " || ', ' || "
    + level_sql("valence", "positive", "negative", "neutral")
    + " || CASE WHEN acousticness > 0.5 THEN ', acoustic' ELSE '' END"
)


def _level(i: int, name: str) -> str:
    return f"greatest(0.0::DOUBLE, least(1.0::DOUBLE, 0.5::DOUBLE + 2 * CAST(embedding[{i}] AS DOUBLE))) AS {name}"


_LEVELS = ", ".join(_level(i + 1, n) for i, n in enumerate(FEATURES[:5]))

BASE = f"""
WITH tracks AS (
  SELECT vec_id, 't' || CAST(vec_id AS VARCHAR) AS track_id, 'Track ' || CAST(vec_id AS VARCHAR) AS track_name,
    CASE WHEN vec_id % 3 = 0 THEN 'Artist ' || CAST(label AS VARCHAR)
         WHEN vec_id % 3 = 1 THEN 'Artist ' || CAST(label AS VARCHAR) || ', Guest ' || CAST(vec_id AS VARCHAR)
         ELSE '' END AS artist_name,
    'img/' || CAST(vec_id AS VARCHAR) AS image_url,
    {_LEVELS},
    125 + 400 * CAST(embedding[6] AS DOUBLE) AS tempo,
    greatest(0.0::DOUBLE, least(1.0::DOUBLE, (125 + 400 * CAST(embedding[6] AS DOUBLE)) / 250)) AS tempo_norm,
    label AS style
  FROM embeddings
), plays AS (
  SELECT e.user_id AS listener_id, t.track_id, e.ts AS played_at, t.track_name, t.artist_name, t.image_url,
    {", ".join(f"CASE WHEN e.event_type <> 'error' THEN t.{n} END AS {n}" for n in _NULLABLE)},
    e.event_id, e.event_type, e.value, t.style
  FROM events e JOIN tracks t ON t.vec_id = e.event_id % (SELECT count(*) FROM embeddings)
), gaps AS (
  SELECT *, lag(played_at) OVER (PARTITION BY listener_id ORDER BY played_at, track_id) AS previous_played_at
  FROM plays
), sess AS (
  SELECT * EXCLUDE (previous_played_at),
    CAST(sum(CASE WHEN played_at - previous_played_at > INTERVAL {GAP_MINUTES} MINUTE THEN 1 ELSE 0 END)
      OVER (PARTITION BY listener_id ORDER BY played_at, track_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session_id
  FROM gaps
), centroids AS (
  SELECT CAST(style AS INTEGER) AS cluster_id, {", ".join(f"round(avg({n}), 6) AS {n}" for n in FEATURES)}
  FROM plays WHERE {_COMPLETE} GROUP BY style
), moods AS (
  SELECT *, {LABEL_SQL} AS label FROM centroids
), offers AS (
  SELECT p.event_id, c.cluster_id, {_DISTANCE} AS d2
  FROM plays p JOIN centroids c ON true
  WHERE {" AND ".join(f"p.{n} IS NOT NULL" for n in FEATURES)}
), near AS (
  SELECT event_id, cluster_id, d2
  FROM offers QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY d2, cluster_id) = 1
), hist AS (
  SELECT s.*, n.cluster_id AS mood_cluster_id FROM sess s LEFT JOIN near n USING (event_id)
), starts AS (
  SELECT listener_id, session_id, min(played_at) AS session_start, max(played_at) AS session_end,
    count(*) AS n_tracks,
    CAST(min(played_at) AS DATE) AS date, CAST(hour(min(played_at)) AS INTEGER) AS hour,
    (epoch_us(max(played_at)) - epoch_us(min(played_at))) / 6e7::DOUBLE AS duration_minutes
  FROM sess GROUP BY listener_id, session_id
), scored AS (
  SELECT user_id AS listener_id, CAST(ts AS DATE) AS date, CAST(hour(ts) AS INTEGER) AS hour,
    CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS target_session_start,
    CASE WHEN least(1.0::DOUBLE, value / 200) >= 0.5 THEN 1 ELSE 0 END AS y_pred,
    least(1.0::DOUBLE, value / 200) AS y_proba
  FROM events
)
"""
