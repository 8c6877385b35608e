"""Listening data derived from the given `events` and `embeddings` tables."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moodstream.functions.scalar import clamp01
from moodstream.schemas import FEATURES
from moodstream.session import use_utc


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return use_utc(spark).read.parquet(f"{sf_dir}/{table}.parquet")


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per vector: id, texts and features of a track."""
    vec = F.col("vec_id").cast("string")
    first = F.concat(F.lit("Artist "), F.col("label").cast("string"))
    names = (
        F.when(F.col("vec_id") % 3 == 0, F.array(first))
        .when(F.col("vec_id") % 3 == 1, F.array(first, F.concat(F.lit("Guest "), vec)))
        .otherwise(F.array().cast("array<string>"))
    )
    dims = [F.element_at("embedding", i).cast("double") for i in range(1, 7)]
    levels = [clamp01(0.5 + 2 * d).alias(name) for d, name in zip(dims[:5], FEATURES[:5], strict=True)]
    tempo = 125 + 400 * dims[5]
    return read(spark, sf_dir, "embeddings").select(
        "vec_id",
        F.concat(F.lit("t"), vec).alias("track_id"),
        F.concat(F.lit("Track "), vec).alias("track_name"),
        names.alias("artist_names"),
        F.array_join(names, ", ").alias("artist_name"),
        F.concat(F.lit("img/"), vec).alias("image_url"),
        *levels,
        tempo.alias("tempo"),
        clamp01(tempo / 250).alias("tempo_norm"),
        F.col("label").alias("style"),
    )


def plays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per event: a play of a track, without features where the event is an error."""
    catalogue = tracks(spark, sf_dir)
    size = read(spark, sf_dir, "embeddings").count()
    events = read(spark, sf_dir, "events").select(
        F.col("user_id").alias("listener_id"),
        F.col("ts").cast("timestamp").alias("played_at"),
        "event_type",
        "event_id",
        "value",
        (F.col("event_id") % size).alias("vec_id"),
    )
    known = F.col("event_type") != "error"
    hidden = ["valence", "energy", "danceability", "acousticness", "instrumentalness", "tempo", "tempo_norm"]
    return events.join(catalogue, "vec_id").select(
        "listener_id",
        "track_id",
        "played_at",
        "track_name",
        "artist_name",
        "image_url",
        *[F.when(known, F.col(name)).alias(name) for name in hidden],
        "event_id",
        "event_type",
        "value",
        "style",
    )


def scored_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored hours for evaluation: date, hour, truth, prediction and score from `events`."""
    proba = F.least(F.lit(1.0), F.col("value") / 200)
    return read(spark, sf_dir, "events").select(
        F.col("user_id").alias("listener_id"),
        F.to_date("ts").alias("date"),
        F.hour("ts").alias("hour"),
        (F.col("event_type") == "purchase").cast("int").alias("target_session_start"),
        (proba >= 0.5).cast("int").alias("y_pred"),
        proba.alias("y_proba"),
    )
