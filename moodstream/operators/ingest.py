"""New plays: filtering, enrichment, alignment with history."""

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from moodstream.functions.scalar import tempo_norm
from moodstream.operators.skew import lookup_join
from moodstream.schemas import PAYLOAD_FEATURES, PLAY_KEY


def latest_play(history: DataFrame) -> DataFrame:
    """The newest stamp of each listener."""
    return history.groupBy("listener_id").agg(F.max("played_at").alias("latest_played_at"))


def newer_than(new: DataFrame, latest: DataFrame) -> DataFrame:
    """Plays after the listener's `latest_played_at`; everything for a listener without one."""
    marked = lookup_join(new, latest.select("listener_id", "latest_played_at"), ["listener_id"])
    fresh = F.col("latest_played_at").isNull() | (F.col("played_at") > F.col("latest_played_at"))
    return marked.filter(fresh).drop("latest_played_at")


def after_high_water(new: DataFrame, history: DataFrame) -> DataFrame:
    """Plays later than all of the listener's history."""
    return newer_than(new, latest_play(history))


def unseen(new: DataFrame, history: DataFrame) -> DataFrame:
    """Plays whose key is not in history."""
    return new.join(history.select(*PLAY_KEY), PLAY_KEY, "left_anti")


def seen_again(rows: DataFrame, keys: DataFrame, on: Sequence[str] = PLAY_KEY) -> DataFrame:
    """Rows whose key is among `keys`."""
    return rows.join(keys.select(*on), list(on), "left_semi")


def with_features(plays: DataFrame, features: DataFrame) -> DataFrame:
    """Adds the raw features by track and the normalised tempo; an unknown track gets nulls."""
    base = plays.drop(*PAYLOAD_FEATURES, "tempo_norm")
    table = features.select("track_id", *PAYLOAD_FEATURES, tempo_norm(F.col("tempo")).alias("tempo_norm"))
    return lookup_join(base, table, ["track_id"])


def with_metadata(plays: DataFrame, metadata: DataFrame) -> DataFrame:
    """Replaces name, artists and artwork where metadata knows the track."""
    base = plays if "image_url" in plays.columns else plays.withColumn("image_url", F.lit(None).cast("string"))
    table = metadata.select(
        "track_id",
        F.col("track_name").alias("_name"),
        F.col("artist_name").alias("_artist"),
        F.struct("image_url").alias("_image"),
    )
    joined = lookup_join(base, table, ["track_id"])
    chosen = F.when(F.col("_image").isNotNull(), F.col("_image.image_url")).otherwise(F.col("image_url"))
    return joined.withColumns(
        {
            "track_name": F.coalesce("_name", "track_name"),
            "artist_name": F.coalesce("_artist", "artist_name"),
            "image_url": chosen,
        }
    ).drop("_name", "_artist", "_image")


def one_per_key(rows: DataFrame, order: Sequence, keys: Sequence[str] = PLAY_KEY) -> DataFrame:
    """The first row of each key in the given order.

    The rank filter runs before the shuffle too, so a key with very many copies sends one row per task.
    """
    place = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_rank", F.row_number().over(place)).filter("_rank = 1").drop("_rank")


def union_aligned(first: DataFrame, second: DataFrame) -> DataFrame:
    """All rows of both; a column only one side has is null on the other."""
    return first.unionByName(second, allowMissingColumns=True)


def upserted(history: DataFrame, batch: DataFrame, order: Sequence = ()) -> DataFrame:
    """History with the batch's rows put in by key (the batch wins), without rows that hold any null.

    `order` breaks ties between copies of a key inside the batch or the history, preferred copy first.
    """
    both = union_aligned(
        history.withColumn("_source", F.lit(0)), batch.withColumn("_source", F.lit(1))
    )
    return one_per_key(both, [F.desc("_source"), *order]).drop("_source").na.drop("any")
