"""Next-mood samples: training windows, scoring context, latest window."""

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from moodstream.functions.scalar import cyclic_time, minutes_between
from moodstream.operators.ingest import seen_again, union_aligned
from moodstream.operators.skew import CHUNK_ROWS, chunked, numbered
from moodstream.schemas import FEATURES

WINDOW_SIZE = 3
SESSION = ["listener_id", "session_id"]
PLAY_ORDER = ["played_at", "track_id"]


def sample_columns(window_size: int = WINDOW_SIZE) -> list[str]:
    """The model features of a mood sample, in order."""
    return [
        *[f"mood_cluster_{i}" for i in range(window_size)],
        *[f"{name}_{stat}" for name in FEATURES for stat in ("mean", "std")],
        "hour_sin",
        "hour_cos",
        "day_sin",
        "day_cos",
        "is_weekend",
        "session_position",
        "session_length",
        "time_since_session_start",
        *[f"current_{name}" for name in FEATURES],
    ]


def _any_feature_null() -> Column:
    missing = F.lit(False)
    for name in FEATURES:
        missing = missing | F.col(name).isNull()
    return missing


def _frame_stats(frame: WindowSpec, fill: bool) -> dict[str, Column]:
    """Mean and population deviation of each feature over a frame; `fill` turns no values into 0."""
    stats = {}
    for name in FEATURES:
        for stat, value in (("mean", F.avg(name).over(frame)), ("std", F.stddev_pop(name).over(frame))):
            stats[f"{name}_{stat}"] = F.coalesce(value, F.lit(0.0)) if fill else value
    return stats


def mood_samples(
    history: DataFrame, window_size: int = WINDOW_SIZE, chunk_rows: int = CHUNK_ROWS
) -> DataFrame:
    """One training sample per run of `window_size` plays with features that is followed by another play.

    Windows run over chunks of numbered sessions, so a session of any length is spread over many tasks.
    """
    slim = history.select(*SESSION, *PLAY_ORDER, *FEATURES, "mood_cluster_id")
    known = slim.na.drop(subset=["mood_cluster_id", "session_id"])
    chunks = chunked(numbered(known, SESSION, PLAY_ORDER), window_size - 1, 1, chunk_rows)
    order = Window.partitionBy(*SESSION, "_chunk").orderBy("_pos")
    frame = order.rowsBetween(-(window_size - 1), 0)
    sequence = {
        f"mood_cluster_{i}": F.lag("mood_cluster_id", window_size - 1 - i).over(order)
        for i in range(window_size)
    }
    framed = chunks.withColumn("_gap", _any_feature_null().cast("int")).withColumns(
        {
            **sequence,
            **_frame_stats(frame, fill=False),
            "_gaps": F.sum("_gap").over(frame),
            "target_mood_cluster": F.lead("mood_cluster_id").over(order),
        }
    )
    whole = framed.filter(
        F.col("_owned")
        & (F.col("_pos") >= window_size - 1)
        & (F.col("_pos") < F.col("_size") - 1)
        & (F.col("_gaps") == 0)
    )
    return whole.withColumns(
        {
            **cyclic_time(F.col("played_at")),
            "session_position": (F.col("_pos") + 1).cast("int"),
            "session_length": F.col("_size").cast("int"),
            "time_since_session_start": minutes_between(F.col("_start"), F.col("played_at")),
            **{f"current_{name}": F.col(name) for name in FEATURES},
        }
    ).select("listener_id", "session_id", "played_at", *sample_columns(window_size), "target_mood_cluster")


def scoring_context(
    batch: DataFrame, history: DataFrame, window_size: int = WINDOW_SIZE, chunk_rows: int = CHUNK_ROWS
) -> DataFrame:
    """Per batch play, the sample of the plays strictly before it in its session.

    Only the history of sessions the batch touches is read. `ready` tells whether there are enough earlier plays, all
    with a mood; without it the features are not to be used.
    """
    columns = [*SESSION, *PLAY_ORDER, *FEATURES, "mood_cluster_id"]
    touched = batch.select(*SESSION).distinct()
    earlier = seen_again(history.select(*columns), touched, SESSION)
    both = union_aligned(
        earlier.withColumn("_new", F.lit(False)), batch.select(*columns).withColumn("_new", F.lit(True))
    )
    chunks = chunked(numbered(both, SESSION, PLAY_ORDER), window_size, 0, chunk_rows)
    order = Window.partitionBy(*SESSION, "_chunk").orderBy("_pos")
    frame = order.rowsBetween(-window_size, -1)
    framed = chunks.withColumns(
        {
            **{
                f"mood_cluster_{i}": F.lag("mood_cluster_id", window_size - i).over(order)
                for i in range(window_size)
            },
            **_frame_stats(frame, fill=True),
            "_moods": F.count("mood_cluster_id").over(frame),
        }
    )
    own = framed.filter(F.col("_owned") & F.col("_new"))
    return own.withColumns(
        {
            **cyclic_time(F.col("played_at")),
            "session_position": (F.col("_pos") + 1).cast("int"),
            "session_length": (F.col("_pos") + 1).cast("int"),
            "time_since_session_start": minutes_between(F.col("_start"), F.col("played_at")),
            **{f"current_{name}": F.coalesce(F.col(name), F.lit(0.0)) for name in FEATURES},
            "ready": F.coalesce(F.col("_moods"), F.lit(0)) == window_size,
        }
    ).select(*SESSION, *PLAY_ORDER, "mood_cluster_id", "ready", *sample_columns(window_size))


def last_plays(history: DataFrame, n: int) -> DataFrame:
    """The last `n` plays of each listener in session order, with `recency` 1 for the newest.

    The rank limit is applied before the shuffle as well.
    """
    newest = Window.partitionBy("listener_id").orderBy(
        F.desc("session_id"), *[F.desc(name) for name in PLAY_ORDER]
    )
    return history.withColumn("recency", F.row_number().over(newest)).filter(F.col("recency") <= n)


def latest_window(
    history: DataFrame, window_size: int = WINDOW_SIZE, exact: bool = False, sessions: DataFrame | None = None
) -> DataFrame:
    """One sample per listener from the newest plays, to predict what comes next.

    A latest session shorter than the window is filled up with the plays before it; position and length are then the
    number of plays taken. The minutes since the session's start count as 0 unless `exact`. With `sessions` (session days of
    a history of complete rows), `history` need hold no more than the newest plays.
    """
    slim = history.select(*SESSION, *PLAY_ORDER, *FEATURES, "mood_cluster_id")
    known = slim.na.drop(subset=["mood_cluster_id", "session_id"])
    if sessions is None:
        sizes = known.groupBy(*SESSION).agg(F.count(F.lit(1)).alias("_size"), F.min("played_at").alias("_start"))
    else:
        sizes = sessions.groupBy(*SESSION).agg(F.sum("n_plays").alias("_size"), F.min("first_play").alias("_start"))
    latest = sizes.groupBy("listener_id").agg(F.max(F.struct("session_id", "_size", "_start")).alias("_session"))
    tail = last_plays(known, window_size)
    taken = tail.groupBy("listener_id").agg(
        F.count(F.lit(1)).alias("_taken"),
        *[
            F.max(F.when(F.col("recency") == window_size - i, F.col("mood_cluster_id"))).alias(f"_mood_{i}")
            for i in range(window_size)
        ],
        *[F.coalesce(F.avg(name), F.lit(0.0)).alias(f"{name}_mean") for name in FEATURES],
        *[F.coalesce(F.stddev_pop(name), F.lit(0.0)).alias(f"{name}_std") for name in FEATURES],
        F.max("played_at").alias("played_at"),
        *[
            F.coalesce(F.max(F.when(F.col("recency") == 1, F.col(name))), F.lit(0.0)).alias(f"current_{name}")
            for name in FEATURES
        ],
    )
    joined = taken.join(latest, "listener_id")
    size = F.col("_session._size")
    length = F.when(size >= window_size, size).otherwise(F.col("_taken")).cast("int")
    minutes = minutes_between(F.col("_session._start"), F.col("played_at")) if exact else F.lit(0.0)
    shift = F.lit(window_size) - F.col("_taken")
    moods = F.array(*[F.col(f"_mood_{i}") for i in range(window_size)])
    return joined.withColumns(
        {
            # A listener with fewer plays than the window fills the leading places; the rest count as 0.
            **{
                f"mood_cluster_{i}": F.coalesce(
                    F.try_element_at(moods, (shift + i + 1).cast("int")), F.lit(0)
                )
                for i in range(window_size)
            },
            **cyclic_time(F.col("played_at")),
            "session_position": length,
            "session_length": length,
            "time_since_session_start": minutes,
            "session_id": F.col("_session.session_id"),
        }
    ).select("listener_id", "session_id", "played_at", *sample_columns(window_size))
