"""The cluster model: at most MAX_MOODS centroids with labels."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moodstream.schemas import CLUSTER_MODEL, FEATURES, MAX_MOODS


def load_moods(spark: SparkSession, path: str) -> DataFrame:
    """One row per mood, with label and centroid."""
    model = spark.read.schema(CLUSTER_MODEL).json(path, multiLine=True)
    rows = model.select(F.explode("clusters").alias("c"))
    return rows.select("c.cluster_id", "c.label", "c.centroid.*").orderBy("cluster_id")


def save_moods(moods: DataFrame, path: str) -> None:
    """Writes the model as one JSON document; the table has at most MAX_MOODS rows."""
    mood_points(moods)
    entry = F.struct("cluster_id", "label", F.struct(*FEATURES).alias("centroid"))
    document = moods.agg(
        F.count(F.lit(1)).cast("int").alias("optimal_k"), F.array_sort(F.collect_list(entry)).alias("clusters")
    )
    document.coalesce(1).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def mood_points(moods: DataFrame) -> list[dict]:
    """The centroids (and labels) as plain values, in order of id. More than MAX_MOODS rows are an error, not cut off."""
    rows = moods.select("cluster_id", *(["label"] if "label" in moods.columns else []), *FEATURES).orderBy("cluster_id").limit(MAX_MOODS + 1).collect()
    if not rows:
        raise ValueError("the cluster model is empty")
    if len(rows) > MAX_MOODS:
        raise ValueError(f"a cluster model has at most {MAX_MOODS} moods")
    return [row.asDict() for row in rows]
