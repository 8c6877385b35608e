"""Aggregations: sessions, days, hours, drift."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moodstream import fixtures
from moodstream.operators import drift, export, ingest
from moodstream.operators.sessions import history_counts, session_facts, start_hours
from moodstream.plans.catalog.common import AS_OF, history, r6, rx, sessions
from moodstream.plans.catalog.projections import PERIOD_DAYS


def latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.latest_play(fixtures.plays(spark, sf_dir))


def session_start(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = session_facts(sessions(spark, sf_dir))
    return facts.select("listener_id", "session_id", "session_start", "date", "hour")


def session_duration(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = session_facts(sessions(spark, sf_dir))
    return facts.select("listener_id", "session_id", "session_end", "duration_minutes", "n_tracks")


def _periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift.split_periods(sessions(spark, sf_dir))


def sessions_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift.sessions_per_day(drift.period_sessions(_periods(spark, sf_dir)))


def tracks_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift.tracks_per_day(_periods(spark, sf_dir))


def hour_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift.start_hour_counts(session_facts(sessions(spark, sf_dir)), ["listener_id"])


def entropies(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = drift.start_hour_counts(session_facts(sessions(spark, sf_dir)), ["listener_id"])
    return drift.hour_entropy(counts, ["listener_id"])


def mean_and_std(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sessions(spark, sf_dir)
    return rows.groupBy("listener_id", "session_id").agg(
        F.avg("valence").alias("valence_mean"),
        F.stddev_pop("valence").alias("valence_std"),
        F.avg("energy").alias("energy_mean"),
        F.stddev_pop("energy").alias("energy_std"),
    )


def trajectory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export.mood_trajectory(fixtures.plays(spark, sf_dir), F.lit(AS_OF).cast("timestamp"))


def distinct_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return start_hours(sessions(spark, sf_dir))


def counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history_counts(sessions(spark, sf_dir))


def actual(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export.actual_hours(sessions(spark, sf_dir))


def feature_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift.feature_drift(sessions(spark, sf_dir))


def label_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift.label_drift(sessions(spark, sf_dir))


def hour_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift.hour_drift(sessions(spark, sf_dir))


def drift_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift.drift_report(sessions(spark, sf_dir))


QUERIES = {
    "D1_latest_play": latest,
    "D2_session_start": session_start,
    "D3_session_duration": session_duration,
    "D4_sessions_per_day": sessions_daily,
    "D5_tracks_per_day": tracks_daily,
    "D6_start_hour_histogram": hour_histogram,
    "D7_start_hour_entropy": entropies,
    "D8_mean_and_std": mean_and_std,
    "D9_mood_trajectory": trajectory,
    "D10_distinct_start_hours": distinct_hours,
    "D11_play_and_session_counts": counts,
    "D14_actual_hours": actual,
    "D15_feature_drift": feature_drift,
    "D16_label_drift": label_drift,
    "D16_hour_drift": hour_drift,
    "D17_drift_decision": drift_decision,
}

# Drift measures, as CTE bodies on top of the period days.
_PARTS = ", ".join(
    f"avg({{v}}) FILTER (period = '{p}') AS {{n}}_{p}_mean, stddev_pop({{v}}) FILTER (period = '{p}') AS {{n}}_{p}_std"
    for p in ("recent", "prior")
)
_LENGTHS = ", ".join(
    f"sum(micros) FILTER (period = '{p}') / count(*) FILTER (period = '{p}') / 6e7::DOUBLE AS session_duration_{p}_mean,"
    f" stddev_pop(micros / 6e7::DOUBLE) FILTER (period = '{p}') AS session_duration_{p}_std"
    for p in ("recent", "prior")
)
_TWO = ["session_duration", "sessions_per_day", "tracks_per_day"]


def _zeroed(name: str) -> str:
    both = f"{name}_recent_mean IS NOT NULL AND {name}_prior_mean IS NOT NULL"
    columns = [f"{name}_{p}_{s}" for p in ("recent", "prior") for s in ("mean", "std")]
    return ", ".join(f"CASE WHEN {both} THEN {c} ELSE 0.0::DOUBLE END AS {c}" for c in columns)


def _pct(recent: str, prior: str, floor: str) -> str:
    return f"({recent} - {prior}) / greatest({prior}, {floor}::DOUBLE) * 100"


DRIFT = f"""
{PERIOD_DAYS},
period_sessions AS (
  SELECT listener_id, period, session_id, CAST(min(first_play) AS DATE) AS date, hour(min(first_play)) AS hour,
    epoch_us(max(last_play)) - epoch_us(min(first_play)) AS micros
  FROM period_days GROUP BY listener_id, period, session_id
), daily_sessions AS (
  SELECT listener_id, period, date, count(*) AS n FROM period_sessions GROUP BY ALL
), daily_tracks AS (
  SELECT listener_id, period, date, CAST(sum(n_plays) AS BIGINT) AS n FROM period_days GROUP BY ALL
), d1 AS (SELECT listener_id, {_LENGTHS} FROM period_sessions GROUP BY ALL),
d2 AS (SELECT listener_id, {_PARTS.format(v="n", n=_TWO[1])} FROM daily_sessions GROUP BY ALL),
d3 AS (SELECT listener_id, {_PARTS.format(v="n", n=_TWO[2])} FROM daily_tracks GROUP BY ALL),
shares AS (
  SELECT listener_id, period, count(*) / sum(count(*)) OVER (PARTITION BY listener_id, period) AS p
  FROM period_sessions GROUP BY listener_id, period, hour
), bits AS (SELECT listener_id, period, -sum(p * log2(p)) AS entropy FROM shares GROUP BY ALL),
d4 AS (
  SELECT listener_id, coalesce(max(entropy) FILTER (period = 'recent'), 0) AS entropy_recent,
    coalesce(max(entropy) FILTER (period = 'prior'), 0) AS entropy_prior FROM bits GROUP BY ALL
), wide AS (
  SELECT listener_id, {", ".join(_zeroed(n) for n in _TWO)}, entropy_recent, entropy_prior
  FROM d1 JOIN d2 USING (listener_id) JOIN d3 USING (listener_id) JOIN d4 USING (listener_id)
), changes AS (
  SELECT *,
    {", ".join(
        f"{_pct(f'{n}_recent_{s}', f'{n}_prior_{s}', '1.0')} AS {n}_{s}_pct_change"
        for n in _TWO for s in ("mean", "std"))},
    entropy_recent - entropy_prior AS entropy_change,
    CASE WHEN entropy_prior > 0 THEN {_pct("entropy_recent", "entropy_prior", "0.1")} ELSE 0 END AS entropy_pct_change
  FROM wide
), feature_drift AS (
  SELECT *, greatest({", ".join(f"abs({n}_mean_pct_change)" for n in _TWO)}, abs(entropy_pct_change)) AS max_pct_change
  FROM changes
), rates AS (
  SELECT listener_id, coalesce(avg(n) FILTER (period = 'recent'), 0) AS rate_recent,
    coalesce(avg(n) FILTER (period = 'prior'), 0) AS rate_prior,
    count(*) FILTER (period = 'recent') / 7.0::DOUBLE AS days_recent,
    count(*) FILTER (period = 'prior') / 30.0::DOUBLE AS days_prior
  FROM daily_sessions GROUP BY ALL
), rate_changes AS (
  SELECT *, CASE WHEN rate_prior > 0 THEN {_pct("rate_recent", "rate_prior", "1.0")} ELSE 0 END AS rate_pct_change,
    {_pct("days_recent", "days_prior", "0.01")} AS days_pct_change
  FROM rates
), label_drift AS (
  SELECT *, greatest(abs(rate_pct_change), abs(days_pct_change)) AS max_pct_change FROM rate_changes
)"""

_FEATURE_COLUMNS = [
    *[f"{n}_{p}_{s}" for n in _TWO for p in ("recent", "prior") for s in ("mean", "std")],
    *[f"{n}_{s}_pct_change" for n in _TWO for s in ("mean", "std")],
    "entropy_recent",
    "entropy_prior",
    "entropy_change",
    "entropy_pct_change",
    "max_pct_change",
]
_LABEL_COLUMNS = [
    "rate_recent", "rate_prior", "days_recent", "days_prior", "rate_pct_change", "days_pct_change", "max_pct_change",
]

ACTUAL_HOURS = """
actual AS (
  SELECT l.listener_id, h.hour, count(s.session_id) AS sessions
  FROM (SELECT DISTINCT listener_id FROM starts) l CROSS JOIN (SELECT CAST(unnest(range(24)) AS INTEGER) AS hour) h
  LEFT JOIN starts s ON s.listener_id = l.listener_id AND s.hour = h.hour GROUP BY ALL
)"""

SQL = {
    "D1_latest_play": "SELECT listener_id, max(played_at) AS latest_played_at FROM plays GROUP BY ALL",
    "D2_session_start": "SELECT listener_id, session_id, session_start, date, hour FROM starts",
    "D3_session_duration": f"""
SELECT listener_id, session_id, session_end, {r6("duration_minutes")}, n_tracks FROM starts""",
    "D4_sessions_per_day": f", {DRIFT} SELECT * FROM daily_sessions",
    "D5_tracks_per_day": f", {DRIFT} SELECT * FROM daily_tracks",
    "D6_start_hour_histogram": "SELECT listener_id, hour, count(*) AS n FROM starts GROUP BY ALL",
    "D7_start_hour_entropy": f"""
, p AS (
  SELECT listener_id, count(*) / sum(count(*)) OVER (PARTITION BY listener_id) AS p
  FROM starts GROUP BY listener_id, hour
)
SELECT listener_id, {rx("-sum(p * log2(p))", "entropy")} FROM p GROUP BY ALL""",
    "D8_mean_and_std": f"""
SELECT listener_id, session_id, {rx("avg(valence)", "valence_mean")}, {rx("stddev_pop(valence)", "valence_std")},
  {rx("avg(energy)", "energy_mean")}, {rx("stddev_pop(energy)", "energy_std")} FROM sess GROUP BY ALL""",
    "D9_mood_trajectory": f"""
SELECT listener_id, time_bucket(INTERVAL 15 MINUTE, played_at) AS time,
  {rx("coalesce(avg(valence), 0.5)", "valence")}, {rx("coalesce(avg(energy), 0.5)", "energy")}
FROM plays WHERE played_at >= TIMESTAMP '{AS_OF}' - INTERVAL 1 DAY GROUP BY ALL""",
    "D10_distinct_start_hours": "SELECT DISTINCT listener_id, date, hour FROM starts",
    "D11_play_and_session_counts": """
SELECT (SELECT count(*) FROM sess) AS num_tracks, (SELECT count(*) FROM starts) AS num_sessions""",
    "D14_actual_hours": f"""
, {ACTUAL_HOURS}
SELECT listener_id, hour, sessions, {rx("sessions / max(sessions) OVER (PARTITION BY listener_id)", "share")}
FROM actual""",
    "D15_feature_drift": f"""
, {DRIFT} SELECT listener_id, {r6(*_FEATURE_COLUMNS)}, max_pct_change > 20 AS drift_detected FROM feature_drift""",
    "D16_label_drift": f"""
, {DRIFT} SELECT listener_id, {r6(*_LABEL_COLUMNS)}, max_pct_change > 20 AS drift_detected FROM label_drift""",
    "D16_hour_drift": f"""
, {DRIFT}, h AS (
  SELECT l.listener_id, h.hour, count(*) FILTER (s.period = 'recent') AS recent,
    count(*) FILTER (s.period = 'prior') AS prior
  FROM (SELECT DISTINCT listener_id FROM period_sessions) l CROSS JOIN (SELECT CAST(unnest(range(24)) AS INTEGER) AS hour) h
  LEFT JOIN period_sessions s ON s.listener_id = l.listener_id AND s.hour = h.hour GROUP BY ALL
)
SELECT listener_id, hour, CAST(recent AS DOUBLE) AS recent, CAST(prior AS DOUBLE) AS prior,
  {rx("CASE WHEN prior > 0 THEN " + _pct("recent", "prior", "1.0") + " ELSE 0 END", "pct_change")} FROM h""",
    "D17_drift_decision": f"""
, {DRIFT} SELECT f.listener_id, f.max_pct_change > 20 AS feature_drift,
  {rx("f.max_pct_change", "feature_max_pct_change")}, l.max_pct_change > 20 AS label_drift,
  {rx("l.max_pct_change", "label_max_pct_change")}, f.max_pct_change > 20 OR l.max_pct_change > 20 AS overall_drift
FROM feature_drift f JOIN label_drift l USING (listener_id)""",
}
