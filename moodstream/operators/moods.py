"""Moods: nearest centroid, labels, k-means."""

from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from moodstream.functions.scalar import feature_distance, mood_label
from moodstream.operators.kmeans import Fit, best_fits, silhouettes
from moodstream.operators.ingest import one_per_key, union_aligned
from moodstream.schemas import FEATURES, MAX_MOODS

# Range of mood counts tried, number of starts, seed.
K_RANGE = (3, 15)
STARTS = 10
SEED = 42


def complete(plays: DataFrame) -> DataFrame:
    """Plays with all six features."""
    return plays.na.drop(subset=FEATURES)


def nearest_mood(points: Sequence[dict]) -> tuple[Column, Column]:
    """Squared distance and id of the nearest centroid; the lowest id wins a tie, and a missing feature makes both null.

    The centroids (at most MAX_MOODS) are constants of the expression, so no join and no shuffle is needed. Each distance
    is named twice and always needed, so Spark works it out once, in a function of its own: inside a condition they would all be
    in one method, too long to be compiled to machine code.
    """
    ordered = sorted(points, key=lambda point: int(point["cluster_id"]))
    ways = [feature_distance(point) for point in ordered]
    least = F.least(*ways) if len(ways) > 1 else ways[0]
    ids = F.array(*[F.lit(int(point["cluster_id"])) for point in ordered])
    return least, F.get(ids, (F.array_position(F.array(*ways), least) - 1).cast("int"))


def with_nearest(plays: DataFrame, points: Sequence[dict]) -> DataFrame:
    """Adds `nearest_cluster_id` and its Euclidean `distance`; null where a feature is missing."""
    least, nearest = nearest_mood(points)
    found = plays.select(*plays.columns, least.alias("_least"), nearest.alias("_nearest"))
    # The row's only entry, spread out: a later filter on it stays above, where it would else repeat all distances.
    entry = F.inline(F.array(F.struct(F.col("_nearest").alias("nearest_cluster_id"), F.sqrt("_least").alias("distance"))))
    return found.select(*plays.columns, entry)


def assign_moods(plays: DataFrame, points: Sequence[dict]) -> DataFrame:
    """Gives a mood to plays that lack one and have all features; other plays stay as they are."""
    base = plays
    if "mood_cluster_id" not in plays.columns:
        base = plays.withColumn("mood_cluster_id", F.lit(None).cast("int"))
    found = base.select(*base.columns, nearest_mood(points)[1].alias("_nearest"))
    # As in `with_nearest`.
    found = found.select(*base.columns, F.explode(F.array("_nearest")).alias("_mood"))
    return found.withColumn("mood_cluster_id", F.coalesce("mood_cluster_id", "_mood")).drop("_mood")


def assign_history(history: DataFrame, batch: DataFrame, points: Sequence[dict]) -> DataFrame:
    """History joined with the latest batch (its rows win), with missing moods assigned."""
    both = union_aligned(history.withColumn("_source", F.lit(0)), batch.withColumn("_source", F.lit(1)))
    return assign_moods(one_per_key(both, [F.desc("_source")]).drop("_source"), points)


def labelled(moods: DataFrame) -> DataFrame:
    """Adds the readable label of each centroid."""
    return moods.withColumn("label", mood_label(F.col("valence"), F.col("energy"), F.col("acousticness")))


def mean_centroids(plays: DataFrame, group: str) -> DataFrame:
    """Centroids as mean features (six decimals) of the plays of each group value."""
    return labelled(
        complete(plays)
        .groupBy(F.col(group).cast("int").alias("cluster_id"))
        .agg(*[F.round(F.avg(name), 6).alias(name) for name in FEATURES])
    )


def weighted_points(plays: DataFrame) -> DataFrame:
    """Distinct feature points with the number of plays at each: the same objective with far fewer rows.

    They are dealt out to all cores: run-time sizing goes by bytes and would leave a few tasks, while what k-means does
    with each of these short rows is much.
    """
    points = complete(plays).groupBy(*FEATURES).agg(F.count(F.lit(1)).cast("double").alias("weight"))
    return points.repartition(plays.sparkSession.sparkContext.defaultParallelism)


def elbow(ks: Sequence[int], costs: Sequence[float]) -> int:
    """The k after which the cost falls least, for sweeps without a positive silhouette."""
    if len(costs) < 3:
        return ks[len(ks) // 2]
    bends = [costs[i] - 2 * costs[i + 1] + costs[i + 2] for i in range(len(costs) - 2)]
    return ks[bends.index(max(bends)) + 1]


def swept(
    points: DataFrame, n_rows: int, k_range: tuple[int, int] = K_RANGE, starts: int = STARTS, seed: int = SEED
) -> Fit:
    """The fit with the best silhouette over the sweep of numbers of moods, else that at the elbow of the cost."""
    low = max(k_range[0], 2)
    high = min(k_range[1], n_rows // 10, MAX_MOODS)
    if high < low:
        return best_fits(points, [max(low, 3)], starts, seed)[0]
    ks = list(range(low, high + 1))
    fits = best_fits(points, ks, starts, seed)
    found = silhouettes(points, fits)
    scores = [score if n_rows >= 2 * k else -1.0 for k, score in zip(ks, found, strict=True)]
    best = max(scores)
    return fits[scores.index(best) if best > 0 else ks.index(elbow(ks, [fit.cost for fit in fits]))]


_CENTROIDS = T.StructType(
    [T.StructField("cluster_id", T.IntegerType())] + [T.StructField(f, T.DoubleType()) for f in FEATURES]
)


def fit_moods(
    plays: DataFrame, k: int | None = None, k_range: tuple[int, int] = K_RANGE, starts: int = STARTS, seed: int = SEED
) -> DataFrame:
    """Cluster table (id, centroid, label) of k-means over the plays; `k` is chosen where not given."""
    points = weighted_points(plays).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        n_rows = int(points.agg(F.sum("weight")).first()[0] or 0)
        if n_rows < 3:
            raise ValueError(f"too few plays with features: {n_rows}")
        fit = best_fits(points, [k], starts, seed)[0] if k else swept(points, n_rows, k_range, starts, seed)
    finally:
        points.unpersist()
    centers = fit.centres
    rows = [(i, *[float(x) for x in center]) for i, center in enumerate(centers)]
    return labelled(plays.sparkSession.createDataFrame(rows, _CENTROIDS))


def rebuild_moods(history: DataFrame, points: Sequence[dict]) -> DataFrame:
    """History with new moods on all plays with complete features; the others keep what they have."""
    base = history
    if "mood_cluster_id" not in history.columns:
        base = history.withColumn("mood_cluster_id", F.lit(None).cast("int"))
    fresh = with_nearest(base, points)
    return fresh.withColumn("mood_cluster_id", F.coalesce("nearest_cluster_id", "mood_cluster_id")).drop(
        "nearest_cluster_id", "distance"
    )
