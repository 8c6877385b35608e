"""Streams over the plays, which arrive in two runs, and what they leave behind."""

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moodstream import fixtures
from moodstream.plans.catalog.common import (
    GAP_MINUTES,
    HISTORY_TO,
    arrived,
    before,
    history,
    points,
    rx,
)
from moodstream.plans.catalog.windows import SQL as WINDOWS
from moodstream.schemas import PLAYS
from moodstream.session import fresh_dir
from moodstream.sources import history as store
from moodstream.streaming import streams
from moodstream.streaming.tails import stream_context

DELAY_HOURS = 6
LATE_FROM = "2024-01-20"


def _plays(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.plays(spark, sf_dir).select(*PLAYS.fieldNames(), "event_id")


def _two_runs(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    rows = _plays(spark, sf_dir)
    edge = F.lit(HISTORY_TO).cast("timestamp")
    return [rows.filter(F.col("played_at") < edge), rows.filter(F.col("played_at") >= edge)]


def replay(
    spark: SparkSession, parts: Sequence[DataFrame], build: Callable[[DataFrame], DataFrame], name: str
) -> DataFrame:
    """Each part arrives in the folder and is then streamed to the end, all on one checkpoint."""
    folder, sink, state = (fresh_dir(spark, f"{name}-{kind}") for kind in ("in", "out", "state"))
    schema = parts[0].schema
    for part in parts:
        part.write.mode("append").parquet(folder)
        query = streams.to_parquet(build(streams.play_stream(spark, folder, schema)), sink, state)
        query.awaitTermination()
    result = build(spark.read.schema(schema).parquet(folder)).schema
    return spark.read.schema(result).parquet(sink)


def ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _plays(spark, sf_dir).drop("event_id")
    folder, table, state = (fresh_dir(spark, f"ingest-{kind}") for kind in ("in", "history", "state"))
    centroids = points(spark, sf_dir)
    # The second run brings some plays of the first again.
    for part in (before(rows), arrived(rows)):
        part.write.mode("append").parquet(folder)
        write = streams.ingest_into(table, centroids, GAP_MINUTES)
        streams.to_each_batch(streams.play_stream(spark, folder, rows.schema), write, state).awaitTermination()
    return store.scan_history(spark, table).select("listener_id", "track_id", "played_at", "session_id", "mood_cluster_id")


def dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _plays(spark, sf_dir).select("listener_id", "track_id", "played_at", "event_id")
    return replay(spark, [before(rows), arrived(rows)], streams.deduplicated, "dedupe")


def late(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second run brings plays from ten days back; days already closed take no more."""
    rows = _plays(spark, sf_dir).select("listener_id", "track_id", "played_at")
    again = rows.filter(F.col("played_at") >= F.lit(LATE_FROM).cast("timestamp"))
    return replay(spark, [before(rows), again], streams.daily_counts, "late")


def closed_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replay(
        spark,
        _two_runs(spark, sf_dir),
        lambda rows: streams.session_windows(rows, GAP_MINUTES, f"{DELAY_HOURS} hours"),
        "sessions",
    )


def closed_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replay(
        spark, _two_runs(spark, sf_dir), lambda rows: streams.mood_bins(rows, f"{DELAY_HOURS} hours"), "bins"
    )


def assigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    centroids = points(spark, sf_dir)
    rows = replay(spark, _two_runs(spark, sf_dir), lambda r: streams.assigned(r, centroids), "assigned")
    return rows.select("event_id", "mood_cluster_id")


def context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The samples of the second run's plays, from the state that the first run left."""
    rows = history(spark, sf_dir)
    late = rows.filter(F.col("played_at") >= F.lit(HISTORY_TO).cast("timestamp"))

    def build(plays: DataFrame) -> DataFrame:
        return stream_context(plays, gap_minutes=GAP_MINUTES)

    samples = replay(spark, [before(rows), late], build, "context")
    return samples.filter(F.col("played_at") >= F.lit(HISTORY_TO).cast("timestamp")).filter("ready").drop("ready", "mood_cluster_id")


QUERIES = {
    "S1_stream_ingest": ingest,
    "S2_stream_dedupe": dedupe,
    "S3_stream_late_data": late,
    "S4_stream_sessions": closed_sessions,
    "S5_stream_mood_bins": closed_bins,
    "S6_stream_assignment": assigned,
    "S7_stream_context": context,
}

_END = f"(SELECT max(played_at) FROM plays) - INTERVAL {DELAY_HOURS} HOUR"

SQL = {
    "S7_stream_context": WINDOWS["E10_preceding_context"],
    "S1_stream_ingest": f"""
, full_plays AS (
  SELECT *, played_at - lag(played_at) OVER (PARTITION BY listener_id ORDER BY played_at, track_id) AS gap
  FROM plays WHERE event_type <> 'error'
)
SELECT f.listener_id, f.track_id, f.played_at, CAST(sum(CASE WHEN gap > INTERVAL {GAP_MINUTES} MINUTE THEN 1 ELSE 0 END)
  OVER (PARTITION BY f.listener_id ORDER BY f.played_at, f.track_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session_id,
  n.cluster_id AS mood_cluster_id
FROM full_plays f JOIN near n USING (event_id)""",
    "S2_stream_dedupe": "SELECT listener_id, track_id, played_at, event_id FROM plays",
    # Without delay, the first run closes every day before the last; the second closes all but the newest.
    "S3_stream_late_data": f"""
, first_run AS (SELECT * FROM plays WHERE played_at < '{HISTORY_TO}'),
closed AS (SELECT CAST(max(played_at) AS DATE) AS day FROM first_run),
both_runs AS (
  SELECT listener_id, CAST(played_at AS DATE) AS date FROM first_run
  UNION ALL
  SELECT listener_id, CAST(played_at AS DATE) FROM plays
  WHERE played_at >= '{LATE_FROM}' AND CAST(played_at AS DATE) >= (SELECT day FROM closed)
)
SELECT listener_id, date, count(*) AS plays FROM both_runs
WHERE date < (SELECT max(CAST(played_at AS DATE)) FROM plays) GROUP BY ALL""",
    "S4_stream_sessions": f"""
SELECT listener_id, session_start, session_end, n_tracks FROM starts
WHERE session_end + INTERVAL {GAP_MINUTES} MINUTE <= {_END}""",
    "S5_stream_mood_bins": f"""
SELECT listener_id, time_bucket(INTERVAL 15 MINUTE, played_at) AS time,
  {rx("coalesce(avg(valence), 0.5)", "valence")}, {rx("coalesce(avg(energy), 0.5)", "energy")}
FROM plays WHERE time_bucket(INTERVAL 15 MINUTE, played_at) + INTERVAL 15 MINUTE <= {_END} GROUP BY ALL""",
    "S6_stream_assignment": "SELECT event_id, mood_cluster_id FROM hist",
}
