import numpy as np
import pytest
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.linalg import Vectors

from moodstream.operators import kmeans, moods
from moodstream.schemas import FEATURES


@pytest.fixture(scope="module")
def cloud(spark):
    rng = np.random.default_rng(3)
    centres = rng.random((4, len(FEATURES)))
    x = np.clip(centres[rng.integers(0, 4, 300)] + rng.normal(0, 0.05, (300, len(FEATURES))), 0, 1)
    w = rng.integers(1, 6, 300).astype(float)
    rows = [(*map(float, p), float(n)) for p, n in zip(x, w, strict=True)]
    return x, w, spark.createDataFrame(rows, ", ".join(f"{n} double" for n in [*FEATURES, "weight"])).repartition(5).cache()


def plain(x, w, centres, iterations):
    """Lloyd's iterations of one model, point by point."""
    for _ in range(iterations):
        at = np.array([min(range(len(centres)), key=lambda k, p=p: ((p - centres[k]) ** 2).sum()) for p in x])
        moved = np.array([np.average(x[at == k], axis=0, weights=w[at == k]) if (at == k).any() else centres[k] for k in range(len(centres))])
        if ((moved - centres) ** 2).sum(axis=1).max() <= kmeans.TOLERANCE**2:
            centres = moved
            break
        centres = moved
    at = np.array([min(range(len(centres)), key=lambda k, p=p: ((p - centres[k]) ** 2).sum()) for p in x])
    return centres, sum(w[i] * ((x[i] - centres[at[i]]) ** 2).sum() for i in range(len(x))), at


def test_models_together_equal_models_alone(cloud):
    x, w, points = cloud
    starts = [x[:2], x[10:15], x[40:43], x[100:108], np.vstack([x[:1], x[:1] + 9])]  # the last has a centre without points
    fits = kmeans.lloyd(points, starts, 6)
    for start, fit in zip(starts, fits, strict=True):
        centres, cost, at = plain(x, w, start.copy(), 6)
        assert fit.centres == pytest.approx(centres) and fit.cost == pytest.approx(cost)
        assert fit.weight == pytest.approx([w[at == k].sum() for k in range(len(start))])


def test_silhouette_equals_the_evaluator(spark, cloud):
    x, w, points = cloud
    fits = kmeans.best_fits(points, [2, 4, 6], 3, 7)
    got = kmeans.silhouettes(points, fits)
    for fit, score in zip(fits, got, strict=True):
        at = ((x[:, None] - fit.centres[None]) ** 2).sum(axis=2).argmin(axis=1)
        rows = [(Vectors.dense(p), int(a), float(n)) for p, a, n in zip(x, at, w, strict=True)]
        told = spark.createDataFrame(rows, ["features", "prediction", "weight"])
        assert score == pytest.approx(ClusteringEvaluator(weightCol="weight").evaluate(told))
    assert max(got) == got[1] and fits[1].cost > fits[2].cost


def test_few_points(spark, cloud):
    one = cloud[2].limit(1)
    fit = kmeans.best_fits(one, [3], 2, 1)[0]
    assert len(fit.centres) == 1 and fit.cost == pytest.approx(0.0) and kmeans.silhouettes(one, [fit]) == [-1.0]


def test_points_are_dealt_out_to_all_cores(spark):
    """Few bytes would be merged into one task, which then measures every point against every model."""
    rows = spark.range(400).selectExpr(*[f"id / 400 + {k} as {n}" for k, n in enumerate(FEATURES)])
    points = moods.weighted_points(rows.unionAll(rows))
    assert points.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism > 1
    assert (points.count(), points.agg({"weight": "sum"}).first()[0]) == (400, 800)
