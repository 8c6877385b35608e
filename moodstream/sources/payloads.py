"""Flattening of service payloads (JSON text, one payload per row).

Each reader takes a table with a `payload` text column and a `payload_no` that tells the order of arrival. Other columns
of the table (such as `listener_id`) are kept.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moodstream.functions.scalar import artist_text, artwork, item_track_id
from moodstream.schemas import (
    FEATURE_ENVELOPES,
    FEATURE_ITEMS,
    FEATURE_PAYLOAD,
    PAYLOAD_FEATURES,
    PLAY_PAYLOAD,
    TRACK_PAYLOAD,
)


def _kept(payloads: DataFrame) -> list[Column]:
    return [F.col(c) for c in payloads.columns if c not in ("payload", "payload_no")]


def play_payload(payloads: DataFrame) -> DataFrame:
    """One row per play item that has a stamp and a track id."""
    parsed = payloads.withColumn("_items", F.from_json("payload", PLAY_PAYLOAD)["items"])
    items = parsed.select(*_kept(payloads), "payload_no", F.posexplode("_items").alias("item_no", "item"))
    track = F.col("item.track")
    flat = items.select(
        *_kept(payloads),
        "payload_no",
        "item_no",
        track["id"].alias("track_id"),
        F.to_timestamp("item.played_at").alias("played_at"),
        F.coalesce(track["name"], F.lit("")).alias("track_name"),
        artist_text(track["artists"]).alias("artist_name"),
    )
    return with_required_keys(flat)


def with_required_keys(plays: DataFrame) -> DataFrame:
    """Drops plays without a stamp or a track id."""
    return plays.na.drop(subset=["played_at", "track_id"]).filter(F.col("track_id") != "")


def _feature_items(payload: Column) -> Column:
    """The item list of whichever envelope the payload uses; a present but empty envelope hides the later ones."""
    names = F.json_object_keys(payload)
    parsed = F.from_json(payload, FEATURE_PAYLOAD)
    chosen = F.when(names.isNull(), F.from_json(payload, FEATURE_ITEMS))
    for envelope in FEATURE_ENVELOPES:
        chosen = chosen.when(F.array_contains(names, envelope), parsed[envelope])
    return chosen


def feature_payload(payloads: DataFrame, requested: DataFrame | None = None) -> DataFrame:
    """One row per track id with its raw features; the last item of an id wins.

    With `requested` (a table of `track_id`), other ids are left out.
    """
    items = payloads.select(
        "payload_no", F.posexplode(_feature_items(F.col("payload"))).alias("item_no", "item")
    )
    rows = items.select(
        item_track_id(F.col("item")).alias("track_id"),
        F.struct("payload_no", "item_no").alias("_place"),
        F.struct(*[F.col(f"item.{name}").alias(name) for name in PAYLOAD_FEATURES]).alias("_values"),
    ).filter(F.col("track_id").isNotNull())
    if requested is not None:
        rows = rows.join(requested.select("track_id").distinct(), "track_id", "left_semi")
    last = rows.groupBy("track_id").agg(F.max_by("_values", "_place").alias("_values"))
    return last.select("track_id", "_values.*")


def track_payload(payloads: DataFrame) -> DataFrame:
    """One row per track id with name, artists and artwork; the last entry of an id wins."""
    parsed = payloads.withColumn("_tracks", F.from_json("payload", TRACK_PAYLOAD)["tracks"])
    items = parsed.select("payload_no", F.posexplode("_tracks").alias("item_no", "track"))
    rows = items.filter(F.col("track.id").isNotNull()).select(
        F.col("track.id").alias("track_id"),
        F.struct("payload_no", "item_no").alias("_place"),
        F.struct(
            F.coalesce("track.name", F.lit("")).alias("track_name"),
            artist_text(F.col("track.artists")).alias("artist_name"),
            artwork(F.col("track.album.images")).alias("image_url"),
        ).alias("_values"),
    )
    last = rows.groupBy("track_id").agg(F.max_by("_values", "_place").alias("_values"))
    return last.select("track_id", "_values.*")
