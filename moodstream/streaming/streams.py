"""Structured Streaming forms: ingest, dedupe, late data, sessions, mood bins, assignment, scoring on arrival."""

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from moodstream.operators.arrivals import prepared_batch
from moodstream.operators.mood_dataset import scoring_context
from moodstream.operators.models import Trained, rescore_moods
from moodstream.operators.moods import assign_moods
from moodstream.operators.sessions import DEFAULT_GAP_MINUTES
from moodstream.schemas import PLAY_KEY
from moodstream.sources import history as store


def play_stream(spark: SparkSession, folder: str, schema: T.StructType) -> DataFrame:
    """Plays from parquet files as they arrive in a folder; `played_at` is a UTC timestamp."""
    return spark.readStream.schema(schema).parquet(folder)


def deduplicated(plays: DataFrame, delay: str = "2 days") -> DataFrame:
    """Each play once, if its copies arrive within the delay; older keys leave the state."""
    return plays.withWatermark("played_at", delay).dropDuplicatesWithinWatermark(list(PLAY_KEY))


def daily_counts(plays: DataFrame, delay: str = "0 seconds") -> DataFrame:
    """Plays per listener and day; a play later than the delay for its day is left out."""
    return (
        plays.withWatermark("played_at", delay)
        .groupBy("listener_id", F.window("played_at", "1 day"))
        .agg(F.count(F.lit(1)).alias("plays"))
        .select("listener_id", F.to_date("window.start").alias("date"), "plays")
    )


def session_windows(plays: DataFrame, gap_minutes: int = DEFAULT_GAP_MINUTES, delay: str = "1 hour") -> DataFrame:
    """Closed sessions: start, end, minutes and plays."""
    return (
        plays.withWatermark("played_at", delay)
        .groupBy("listener_id", F.session_window("played_at", f"{gap_minutes} minutes"))
        .agg(
            F.min("played_at").alias("session_start"),
            F.max("played_at").alias("session_end"),
            F.count(F.lit(1)).alias("n_tracks"),
        )
        .select("listener_id", "session_start", "session_end", "n_tracks")
    )


def mood_bins(plays: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Mean valence and energy per listener and closed 15-minute bin."""
    return (
        plays.withWatermark("played_at", delay)
        .groupBy("listener_id", F.window("played_at", "15 minutes"))
        .agg(
            F.coalesce(F.avg("valence"), F.lit(0.5)).alias("valence"),
            F.coalesce(F.avg("energy"), F.lit(0.5)).alias("energy"),
        )
        .select("listener_id", F.col("window.start").alias("time"), "valence", "energy")
    )


def assigned(plays: DataFrame, points: Sequence[dict]) -> DataFrame:
    """Moods on arrival; the centroids are constants, so there is no state and no join."""
    return assign_moods(plays, points)


def to_parquet(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends what is available to a folder and stops; the next run goes on from the checkpoint."""
    return (
        rows.writeStream.format("parquet")
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start(path)
    )


def to_each_batch(rows: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Hands each micro-batch of what is available to `write`, and stops."""
    return (
        rows.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def ingest_into(
    history_path: str, points: Sequence[dict], gap_minutes: float = DEFAULT_GAP_MINUTES
) -> Callable[[DataFrame, int], None]:
    """A batch writer that puts new plays into the stored history.

    A batch that runs again changes nothing: plays, tails and the other summaries come into force together, and once
    they have, the batch's plays are no longer new.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        del batch_id
        spark = batch.sparkSession
        before = store.kept(spark, history_path)
        store.append_plays(spark, history_path, prepared_batch(batch, None if before is None else before.tails, points, gap_minutes))

    return write


def score_into(
    history_path: str, trained: Trained, target: str
) -> Callable[[DataFrame, int], None]:
    """A batch writer that predicts the mood of arriving plays (with session and mood) from the plays before them."""

    def write(batch: DataFrame, batch_id: int) -> None:
        history = store.try_scan(batch.sparkSession, history_path)
        context = scoring_context(batch, history if history is not None else batch.limit(0))
        # A batch that runs again replaces its own folder.
        rescore_moods(trained, context).write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    return write
