"""Per-listener summaries for the dashboard."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from moodstream.functions.scalar import clamp01, iso_text, quarter_hour
from moodstream.operators.grid import nearest
from moodstream.operators.sessions import session_facts
from moodstream.schemas import FEATURES

# Sizes of the lists, and the shifts of the recommendation queries.
RECENT_PLAYS = 25
TOP_HOURS = 3
SEED_TRACKS = 5
METRIC_HISTORY = 10
QUERY_SHIFTS = [
    {"valence": 0.0, "energy": 0.0, "danceability": 0.0},
    {"valence": 0.1, "energy": 0.08, "danceability": 0.1},
    {"valence": -0.1, "energy": -0.08, "danceability": -0.1},
]


def with_display_names(plays: DataFrame) -> DataFrame:
    """Stand-ins for missing names; artwork and mood stay null."""
    return plays.withColumns(
        {
            "track_name": F.coalesce("track_name", F.lit("Unknown Track")),
            "artist_name": F.coalesce("artist_name", F.lit("Unknown Artist")),
        }
    )


def newest_plays(history: DataFrame, n: int = RECENT_PLAYS) -> DataFrame:
    """The newest `n` plays of each listener, whole; of more of them, and of these joined with others, again the newest."""
    newest = Window.partitionBy("listener_id").orderBy(F.desc("played_at"), F.desc("track_id"))
    return history.withColumn("_place", F.row_number().over(newest)).filter(F.col("_place") <= n).drop("_place")


def recently_played(history: DataFrame, limit: int = RECENT_PLAYS) -> DataFrame:
    """The newest plays of each listener with `place` 1 for the newest; cut to the limit before the shuffle too."""
    newest = Window.partitionBy("listener_id").orderBy(F.desc("played_at"), F.desc("track_id"))
    slim = history.select(
        "listener_id", "track_id", "track_name", "artist_name", "image_url", "played_at", "mood_cluster_id"
    )
    ranked = slim.withColumn("place", F.row_number().over(newest)).filter(F.col("place") <= limit)
    return with_display_names(ranked).withColumn("played_at_text", iso_text(F.col("played_at")))


def last_day(history: DataFrame, as_of: Column) -> DataFrame:
    """Plays of the 24 hours before `as_of` and later."""
    return history.filter(F.col("played_at") >= as_of - F.expr("INTERVAL 1 DAY"))


def mood_trajectory(history: DataFrame, as_of: Column) -> DataFrame:
    """Mean valence and energy per 15-minute bin of the last day; a bin without values counts as 0.5."""
    recent = last_day(history, as_of)
    bins = recent.groupBy("listener_id", quarter_hour(F.col("played_at")).alias("time")).agg(
        F.coalesce(F.avg("valence"), F.lit(0.5)).alias("valence"),
        F.coalesce(F.avg("energy"), F.lit(0.5)).alias("energy"),
    )
    return bins


def actual_hours(history: DataFrame) -> DataFrame:
    """Session starts per listener and hour of day, as a share of the busiest hour; all 24 hours are present."""
    starts = session_facts(history).groupBy("listener_id").agg(
        *[F.count(F.when(F.col("hour") == h, 1)).alias(f"_{h}") for h in range(24)]
    )
    hours = F.array(
        *[F.struct(F.lit(h).alias("hour"), F.col(f"_{h}").alias("sessions")) for h in range(24)]
    )
    busiest = F.greatest(*[F.col(f"_{h}") for h in range(24)])
    rows = starts.select("listener_id", busiest.alias("_most"), F.inline(hours))
    share = F.when(F.col("_most") > 0, F.col("sessions") / F.col("_most")).otherwise(0.0)
    return rows.select("listener_id", "hour", "sessions", share.alias("share"))


def top_hours(hourly: DataFrame, n: int = TOP_HOURS, score: str = "probability") -> DataFrame:
    """The hours with the highest score of each listener (24 rows each); the earlier hour wins a tie."""
    best = Window.partitionBy("listener_id").orderBy(F.desc(score), "hour")
    return hourly.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= n)


def seed_tracks(history: DataFrame, n: int = SEED_TRACKS) -> DataFrame:
    """The most recent distinct tracks of each listener and mood."""
    tracks = (
        history.filter(F.col("mood_cluster_id").isNotNull())
        .groupBy("listener_id", "mood_cluster_id", "track_id")
        .agg(F.max("played_at").alias("last_played_at"))
    )
    return _newest_seeds(tracks, n)


def _newest_seeds(tracks: DataFrame, n: int) -> DataFrame:
    newest = Window.partitionBy("listener_id", "mood_cluster_id").orderBy(F.desc("last_played_at"), "track_id")
    return tracks.withColumn("place", F.row_number().over(newest)).filter(F.col("place") <= n)


def joined_seeds(one: DataFrame, other: DataFrame, n: int = SEED_TRACKS) -> DataFrame:
    """The seeds of two parts of a history, from the seeds of each."""
    both = one.unionByName(other).groupBy("listener_id", "mood_cluster_id", "track_id")
    return _newest_seeds(both.agg(F.max("last_played_at").alias("last_played_at")), n)


def track_catalogue(history: DataFrame) -> DataFrame:
    """One row per track: the features of its newest play that has them all, and the names of its newest play."""
    complete = F.lit(True)
    for name in FEATURES:
        complete = complete & F.col(name).isNotNull()
    texts = ("track_name", "artist_name", "image_url")
    names = [F.col(n) if n in history.columns else F.lit(None).cast("string").alias(n) for n in texts]
    return history.groupBy("track_id").agg(
        F.max(F.when(complete, F.struct("played_at", *FEATURES))).alias("sound"),
        F.max(F.struct("played_at", *names)).alias("names"),
    )


def joined_catalogues(one: DataFrame, other: DataFrame) -> DataFrame:
    """The catalogue of two parts of a history, from the catalogue of each."""
    return one.unionByName(other).groupBy("track_id").agg(F.max("sound").alias("sound"), F.max("names").alias("names"))


def with_label(rows: DataFrame, moods: DataFrame, column: str = "mood_cluster_id") -> DataFrame:
    """Adds the mood's label, or `Cluster <id>` for an unknown one, whatever the number of labels."""
    names = moods.select(F.col("cluster_id").alias(column), "label")
    fallback = F.concat(F.lit("Cluster "), F.col(column).cast("string"))
    return rows.join(names, column, "left").withColumn("mood_label", F.coalesce("label", fallback)).drop("label")


def _query_points(points: Sequence[dict]) -> list[tuple[int, int, list[Column]]]:
    """Mood id, variant and vector of each recommendation query."""
    queries = []
    for point in points:
        for variant, shift in enumerate(QUERY_SHIFTS):
            vector = [
                clamp01(F.lit(float(point[n]) + shift[n])) if n in shift else F.lit(float(point[n]))
                for n in FEATURES
            ]
            queries.append((int(point["cluster_id"]), variant, vector))
    return queries


def nearest_tracks(catalogue: DataFrame, points: Sequence[dict], n: int) -> DataFrame:
    """The `n` catalogue tracks nearest to each query (mood and variant)."""
    queries = [({"mood_cluster_id": mood, "variant": variant}, vector) for mood, variant, vector in _query_points(points)]
    return nearest(catalogue.where("sound is not null").select("track_id", "sound.*"), queries, n, "track_id")


def recommend(
    history: DataFrame,
    wanted: DataFrame,
    points: Sequence[dict],
    catalogue: DataFrame | None = None,
    seeds: DataFrame | None = None,
) -> DataFrame:
    """Per listener and wanted mood, the nearest track of each query variant that is not one of the seeds.

    `wanted` has `listener_id` and `mood_cluster_id`. Since there are at most SEED_TRACKS seeds, the nearest
    SEED_TRACKS + 1 tracks of a query always hold the answer. A track that an earlier variant already gave is skipped.
    `catalogue` and `seeds` are those of the history, where they are at hand already.
    """
    near = nearest_tracks(track_catalogue(history) if catalogue is None else catalogue, points, SEED_TRACKS + 1)
    # At most 15 moods x 3 variants x 6 tracks.
    offers = wanted.join(F.broadcast(near), "mood_cluster_id")
    seeds = (seed_tracks(history) if seeds is None else seeds).select("listener_id", "mood_cluster_id", "track_id")
    left = offers.join(seeds, ["listener_id", "mood_cluster_id", "track_id"], "left_anti")
    best = left.groupBy("listener_id", "mood_cluster_id", "variant").agg(
        F.min(F.struct("distance", "track_id")).alias("_best")
    )
    picks = best.select("listener_id", "mood_cluster_id", "variant", "_best.*")
    first = Window.partitionBy("listener_id", "mood_cluster_id", "track_id").orderBy("variant")
    return picks.withColumn("_first", F.row_number().over(first)).filter("_first = 1").drop("_first")


def carried_forward(log: DataFrame, columns: Sequence[str], keys: Sequence[str] = ("listener_id",)) -> DataFrame:
    """Fills metrics a run did not produce with those of the latest run that did (a few runs per day and key)."""
    order = Window.partitionBy(*keys).orderBy("run_at").rowsBetween(Window.unboundedPreceding, 0)
    return log.withColumns({c: F.last(c, ignorenulls=True).over(order) for c in columns})


def metric_view(log: DataFrame, keys: Sequence[str] = ("listener_id",), n: int = METRIC_HISTORY) -> DataFrame:
    """The newest entry (`latest`) and the `n` before it (`history`)."""
    newest = Window.partitionBy(*keys).orderBy(F.desc("run_at"))
    ranked = log.withColumn("place", F.row_number().over(newest)).filter(F.col("place") <= n + 1)
    return ranked.withColumn("kind", F.when(F.col("place") == 1, "latest").otherwise("history"))
