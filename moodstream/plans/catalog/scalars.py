"""Scalar functions over whole tables."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moodstream import fixtures
from moodstream.functions import scalar as S
from moodstream.operators.export import QUERY_SHIFTS
from moodstream.operators.sessions import session_facts
from moodstream.plans.catalog.common import LABEL_SQL, history, rx, sessions
from moodstream.schemas import FEATURES


def cyclic(spark: SparkSession, sf_dir: str) -> DataFrame:
    plays = fixtures.plays(spark, sf_dir)
    return plays.select("event_id", *[c.alias(n) for n, c in S.cyclic_time(F.col("played_at")).items()])


def calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    ts = F.col("played_at")
    return fixtures.plays(spark, sf_dir).select(
        "event_id",
        F.to_date(ts).alias("date"),
        F.hour(ts).alias("hour"),
        F.weekday(ts).alias("weekday"),
        F.dayofmonth(ts).alias("day_of_month"),
        S.is_weekend(ts).alias("is_weekend"),
    )


def quarter_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.plays(spark, sf_dir).select("event_id", S.quarter_hour(F.col("played_at")).alias("time_bin"))


def tempo(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.plays(spark, sf_dir).select("event_id", S.tempo_norm(F.col("tempo")).alias("tempo_level"))


def clamped_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    plays = fixtures.plays(spark, sf_dir)
    shift = QUERY_SHIFTS[1]
    # An unknown value stays unknown.
    return plays.select(
        "event_id",
        *[F.when(F.col(n).isNotNull(), S.clamp01(F.col(n) + d)).alias(f"{n}_up") for n, d in shift.items()],
    )


def artists(spark: SparkSession, sf_dir: str) -> DataFrame:
    tracks = fixtures.tracks(spark, sf_dir)
    structs = F.transform("artist_names", lambda n: F.struct(n.alias("name")))
    listed = F.when(F.size("artist_names") > 0, structs)
    return tracks.select("track_id", S.artist_text(listed).alias("artist_text"))


def _link(vec: str) -> str:
    padded = f"lpad(CAST({vec} AS STRING), 22, '0')"
    return (
        f"CASE {vec} % 4 WHEN 0 THEN concat('https://open.spotify.com/track/', {padded}, '?si=1')"
        f" WHEN 1 THEN concat('https://open.spotify.com/track/t', CAST({vec} AS STRING), '/more')"
        f" WHEN 2 THEN 'https://example.org/track/other' ELSE '' END"
    )


def link_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fixtures.tracks(spark, sf_dir).select(
        "vec_id",
        F.struct(
            F.expr(_link("vec_id")).alias("href"),
            F.lit("").alias("spotifyId"),
            F.when(F.col("vec_id") % 8 < 4, F.col("track_id")).alias("spotify_id"),
            F.lit(None).cast("string").alias("trackId"),
            F.concat(F.lit("x"), F.col("track_id")).alias("track_id"),
        ).alias("item"),
    )
    found = S.item_track_id(F.col("item"))
    return rows.select("vec_id", found.alias("track_id"), S.valid_track_id(found).alias("valid"))


def artworks(spark: SparkSession, sf_dir: str) -> DataFrame:
    def image(suffix: str, width: int):
        return F.struct(F.concat("image_url", F.lit(suffix)).alias("url"), F.lit(width).alias("width"))

    images = (
        F.when(F.col("vec_id") % 3 == 0, F.array(image("/640", 640), image("/300", 300)))
        .when(F.col("vec_id") % 3 == 1, F.array(image("/640", 640), image("/64", 64)))
        .otherwise(F.array().cast("array<struct<url:string,width:int>>"))
    )
    return fixtures.tracks(spark, sf_dir).select("track_id", S.artwork(images).alias("picked"))


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    plays = fixtures.plays(spark, sf_dir).na.drop(subset=FEATURES)
    label = S.mood_label(F.col("valence"), F.col("energy"), F.col("acousticness"))
    return plays.select("event_id", label.alias("label"))


def guarded_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = session_facts(sessions(spark, sf_dir))
    recent, prior = F.col("n_tracks").cast("double"), F.col("duration_minutes") / 60
    return facts.select(
        "listener_id",
        "session_id",
        *[
            S.pct_change(recent, prior, floor).alias(name)
            for name, floor in (("change_1", 1.0), ("change_01", 0.1), ("change_001", 0.01))
        ],
    )


def marked_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = (
        F.when(F.col("event_type") == "error", F.lit(float("nan")))
        .when(F.col("event_type") == "signup", F.lit(float("inf")))
        .when(F.col("event_type") == "purchase", F.lit(None).cast("double"))
        .otherwise(F.col("value"))
    )
    plays = fixtures.plays(spark, sf_dir).withColumn("v", value)
    return plays.select(
        "event_id",
        (S.nan_text(F.col("v")) == "NaN").alias("is_marked"),
        S.finite(F.col("v")).alias("finite_value"),
    )


def version_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = history(spark, sf_dir).groupBy("listener_id").agg(
        F.to_date(F.min("played_at")).alias("a"), F.to_date(F.max("played_at")).alias("b"), F.count("*").alias("n")
    )
    text = [F.col(c).cast("string") for c in ("a", "b", "n")]
    return spans.select("listener_id", S.short_hash(*text).alias("data_hash"))


def distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    plays = fixtures.plays(spark, sf_dir).na.drop(subset=FEATURES)
    here = F.array(*[F.col(n) for n in FEATURES])
    middle = F.array(*[F.lit(0.5) for _ in FEATURES])
    return plays.select("event_id", S.array_distance(here, middle).alias("distance"))


def bpm_and_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.plays(spark, sf_dir).select(
        "event_id", S.tempo_bpm(F.col("tempo_norm")).alias("bpm"), S.iso_text(F.col("played_at")).alias("played_at_text")
    )


QUERIES = {
    "H1_cyclic_time": cyclic,
    "H2_calendar_parts": calendar,
    "H3_quarter_hour": quarter_hours,
    "H4_tempo_norm": tempo,
    "H5_clamped_shift": clamped_shift,
    "H6_artist_text": artists,
    "H7_track_id_from_link": link_ids,
    "H8_artwork": artworks,
    "H9_mood_label": labels,
    "H10_guarded_change": guarded_change,
    "H11_nan_marks": marked_numbers,
    "H12_version_hash": version_hashes,
    "H13_euclidean_distance": distances,
    "H14_bpm_and_iso_text": bpm_and_text,
}

_HOUR, _DAY = "hour(played_at)", "(isodow(played_at) - 1)"
CYCLIC_SQL = ", ".join(
    [
        rx(f"sin(2 * pi() * {_HOUR} / 24.0::DOUBLE)", "hour_sin"),
        rx(f"cos(2 * pi() * {_HOUR} / 24.0::DOUBLE)", "hour_cos"),
        rx(f"sin(2 * pi() * {_DAY} / 7.0::DOUBLE)", "day_sin"),
        rx(f"cos(2 * pi() * {_DAY} / 7.0::DOUBLE)", "day_cos"),
        f"CASE WHEN {_DAY} >= 5 THEN 1 ELSE 0 END AS is_weekend",
    ]
)


def _change(floor: str) -> str:
    return f"(n_tracks - duration_minutes / 60) / greatest(duration_minutes / 60, {floor}::DOUBLE) * 100"


SQL = {
    "H1_cyclic_time": f"SELECT event_id, {CYCLIC_SQL} FROM plays",
    "H2_calendar_parts": """
SELECT event_id, CAST(played_at AS DATE) AS date, hour(played_at) AS hour, isodow(played_at) - 1 AS weekday,
  day(played_at) AS day_of_month, CASE WHEN isodow(played_at) >= 6 THEN 1 ELSE 0 END AS is_weekend FROM plays""",
    "H3_quarter_hour": "SELECT event_id, time_bucket(INTERVAL 15 MINUTE, played_at) AS time_bin FROM plays",
    "H4_tempo_norm": f"""
SELECT event_id, {rx("greatest(0.0::DOUBLE, least(1.0::DOUBLE, coalesce(tempo, 0) / 250))", "tempo_level")} FROM plays""",
    "H5_clamped_shift": "SELECT event_id, "
    + ", ".join(
        f"CASE WHEN {n} IS NOT NULL THEN round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, {n} + {d}::DOUBLE)), 6) END"
        f" AS {n}_up"
        for n, d in (("valence", "0.1"), ("energy", "0.08"), ("danceability", "0.1"))
    )
    + " FROM plays",
    "H6_artist_text": "SELECT track_id, artist_name AS artist_text FROM tracks",
    "H7_track_id_from_link": """
SELECT vec_id, track_id, length(track_id) = 22 AS valid FROM (
  SELECT vec_id, CASE WHEN vec_id % 4 = 0 THEN lpad(CAST(vec_id AS VARCHAR), 22, '0')
    WHEN vec_id % 4 = 1 THEN track_id WHEN vec_id % 8 < 4 THEN track_id ELSE 'x' || track_id END AS track_id
  FROM tracks)""",
    "H8_artwork": """
SELECT track_id, CASE WHEN vec_id % 3 = 0 THEN image_url || '/300'
  WHEN vec_id % 3 = 1 THEN image_url || '/640' END AS picked FROM tracks""",
    "H9_mood_label": f"SELECT event_id, {LABEL_SQL} AS label FROM plays WHERE valence IS NOT NULL",
    "H10_guarded_change": f"""
SELECT listener_id, session_id, {rx(_change("1.0"), "change_1")}, {rx(_change("0.1"), "change_01")},
  {rx(_change("0.01"), "change_001")} FROM starts""",
    "H11_nan_marks": f"""
SELECT event_id, event_type IN ('error', 'signup', 'purchase') AS is_marked,
  {rx("CASE WHEN event_type NOT IN ('error', 'signup', 'purchase') THEN value END", "finite_value")} FROM plays""",
    "H12_version_hash": """
SELECT listener_id, substring(md5(CAST(CAST(min(played_at) AS DATE) AS VARCHAR) || '_' ||
  CAST(CAST(max(played_at) AS DATE) AS VARCHAR) || '_' || CAST(count(*) AS VARCHAR)), 1, 8) AS data_hash
FROM hist GROUP BY listener_id""",
    "H13_euclidean_distance": "SELECT event_id, "
    + rx("sqrt(" + " + ".join(f"({n} - 0.5::DOUBLE) * ({n} - 0.5::DOUBLE)" for n in FEATURES) + ")", "distance")
    + " FROM plays WHERE valence IS NOT NULL",
    "H14_bpm_and_iso_text": f"""
SELECT event_id, {rx("tempo_norm * 250", "bpm")},
  strftime(played_at, '%Y-%m-%dT%H:%M:%S.%f') || '+00:00' AS played_at_text FROM plays""",
}
