"""Metrics of scored rows against truth."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moodstream import fixtures
from moodstream.operators import evaluate
from moodstream.plans.catalog.common import history, moods, r6, rx
from moodstream.schemas import FEATURES


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.scored_rows(spark, sf_dir)


def hour_prior(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.hour_prior(scored(spark, sf_dir))


def classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.class_counts(history(spark, sf_dir).na.drop(subset=["mood_cluster_id"]), "mood_cluster_id")


def average_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.ranking_metrics(scored(spark, sf_dir)).select("pr_auc", "n_samples")


def roc_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.ranking_metrics(scored(spark, sf_dir)).select("roc_auc", "n_positive")


def thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.threshold_metrics(scored(spark, sf_dir)).drop("n_negative", "positive_rate")


def calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.calibration_error(scored(spark, sf_dir))


def calibration_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.calibration_bins(scored(spark, sf_dir))


def sample_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = evaluate.threshold_metrics(scored(spark, sf_dir), ["hour"])
    return rows.select("hour", "n_samples", "n_positive", "n_negative", "positive_rate")


def times_of_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    # No purchase counts at night, so that one bucket has a single class.
    truth = F.when(F.col("hour") < 6, 0).otherwise(F.col("target_session_start"))
    return evaluate.time_of_day_metrics(scored(spark, sf_dir).withColumn("target_session_start", truth))


def always_negative(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scored(spark, sf_dir).withColumns({"y_pred": F.lit(0), "y_proba": F.lit(0.0), "scorer": F.lit("never")})
    return evaluate.metrics(rows, ["scorer"])


def comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scored(spark, sf_dir)
    return evaluate.compare_baselines(rows, evaluate.hour_prior(rows))


def _moods_guessed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mood guess from the style of the track."""
    return history(spark, sf_dir).na.drop(subset=["mood_cluster_id"])


def class_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.class_metrics(_moods_guessed(spark, sf_dir), "mood_cluster_id", "style")


def one_vs_rest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _moods_guessed(spark, sf_dir)
    ids = [r[0] for r in moods(spark, sf_dir).select("cluster_id").orderBy("cluster_id").collect()]
    # One feature per class stands in for its probability.
    guess = F.array(*[F.col(FEATURES[i % len(FEATURES)]) for i in range(len(ids))])
    return evaluate.one_vs_rest_auc(rows.withColumn("guess", guess), "mood_cluster_id", "guess", ids)


QUERIES = {
    "D12_hour_prior": hour_prior,
    "D13_class_counts": classes,
    "D18_average_precision": average_precision,
    "D19_roc_area": roc_area,
    "D20_f1_at_thresholds": thresholds,
    "D21_calibration_error": calibration,
    "D21_calibration_bins": calibration_bins,
    "D22_sample_counts": sample_counts,
    "D23_time_of_day": times_of_day,
    "D24_always_negative": always_negative,
    "D25_baseline_comparison": comparison,
    "D26_accuracy_and_macro_f1": class_scores,
    "D27_one_vs_rest_roc_area": one_vs_rest,
}


def ranking_sql(source: str, by: str = "", name: str = "rank") -> str:
    """CTE bodies for ranking metrics of a scored table, optionally per group column."""
    group = f"{by}, " if by else ""
    part = f"PARTITION BY {by} " if by else ""
    return f"""
{name}_counts AS (
  SELECT {group}y_proba, count(*) AS n, sum(target_session_start) AS h FROM {source} GROUP BY {group}y_proba
), {name}_curve AS (
  SELECT *, sum(n) OVER w AS n_up, sum(h) OVER w AS h_up FROM {name}_counts
  WINDOW w AS ({part}ORDER BY y_proba DESC ROWS UNBOUNDED PRECEDING)
), {name} AS (
  SELECT {group}CAST(sum(n) AS BIGINT) AS n_samples, CAST(sum(h) AS BIGINT) AS n_positive,
    CASE WHEN sum(h) > 0 THEN sum(h * (h_up / n_up)) / sum(h) ELSE 0 END AS pr_auc,
    CASE WHEN sum(h) > 0 AND sum(n) > sum(h)
      THEN sum((n - h) * (h_up - h / 2)) / (sum(h) * (sum(n) - sum(h))) ELSE 0 END AS roc_auc
  FROM {name}_curve {"GROUP BY " + by if by else ""}
)"""


_CUTS = {"f1": "y_pred = 1", **{f"f1_at_0_{i}": f"y_proba >= 0.{i}" for i in range(1, 10)}}


def _f1(condition: str) -> str:
    hits = f"sum(target_session_start) FILTER ({condition})"
    size = f"(count(*) FILTER ({condition}) + sum(target_session_start))"
    return f"CASE WHEN {size} > 0 THEN 2 * coalesce({hits}, 0) / {size} ELSE 0 END"


F1_SQL = ", ".join(rx(_f1(c), n) for n, c in _CUTS.items())
_BIN = " + ".join(f"CASE WHEN y_proba > {i} * 0.1::DOUBLE THEN 1 ELSE 0 END" for i in range(1, 10))
_BINS = f"""
bins AS (
  SELECT {_BIN} AS bin, avg(CAST(target_session_start AS DOUBLE)) AS positive_rate, avg(y_proba) AS mean_score,
    count(*) AS n FROM scored GROUP BY 1
)"""
HOUR_PRIOR = """
pri AS (
  SELECT hour, sum(target_session_start) / count(*) AS prior FROM scored
  WHERE date < (SELECT max(date) FROM scored) GROUP BY hour
)"""

SQL = {
    "D12_hour_prior": f", {HOUR_PRIOR} SELECT hour, {r6('prior')} FROM pri",
    "D13_class_counts": """
SELECT mood_cluster_id AS class, count(*) AS n FROM hist WHERE mood_cluster_id IS NOT NULL GROUP BY ALL""",
    # Written as a self join over distinct scores, apart from the cumulative form.
    "D18_average_precision": f"""
, c AS (SELECT y_proba AS s, count(*) AS n, sum(target_session_start) AS h FROM scored GROUP BY 1),
up AS (SELECT a.s, a.h, sum(b.n) AS nu, sum(b.h) AS hu FROM c a JOIN c b ON b.s >= a.s GROUP BY a.s, a.h)
SELECT {rx("sum(h * (hu / nu)) / sum(h)", "pr_auc")}, (SELECT count(*) FROM scored) AS n_samples FROM up""",
    "D19_roc_area": f"""
, c AS (
  SELECT y_proba AS s, sum(1 - target_session_start) AS m, sum(target_session_start) AS h FROM scored GROUP BY 1
), pairs AS (
  SELECT sum(a.h * b.m * CASE WHEN a.s > b.s THEN 1.0::DOUBLE WHEN a.s = b.s THEN 0.5 ELSE 0 END) AS wins
  FROM c a JOIN c b ON true
)
SELECT {rx("(SELECT wins FROM pairs) / (sum(h) * sum(m))", "roc_auc")}, CAST(sum(h) AS BIGINT) AS n_positive FROM c""",
    "D20_f1_at_thresholds": f"""
SELECT {F1_SQL}, count(*) AS n_samples, CAST(sum(target_session_start) AS BIGINT) AS n_positive FROM scored""",
    "D21_calibration_error": f"""
, {_BINS} SELECT {rx("avg(abs(positive_rate - mean_score))", "calibration_error")} FROM bins""",
    "D21_calibration_bins": f", {_BINS} SELECT bin, {r6('positive_rate', 'mean_score')}, n FROM bins",
    "D22_sample_counts": f"""
SELECT hour, count(*) AS n_samples, CAST(sum(target_session_start) AS BIGINT) AS n_positive,
  CAST(sum(1 - target_session_start) AS BIGINT) AS n_negative, {rx("avg(target_session_start)", "positive_rate")}
FROM scored GROUP BY hour""",
    "D23_time_of_day": f"""
, buckets AS (
  SELECT y_proba, CASE WHEN hour < 6 THEN 0 ELSE target_session_start END AS target_session_start,
    CASE WHEN hour < 6 THEN 'night' WHEN hour < 12 THEN 'morning' WHEN hour < 18 THEN 'afternoon' ELSE 'evening' END
      AS time_of_day
  FROM scored
), {ranking_sql("buckets", "time_of_day")}
SELECT time_of_day, n_samples, n_positive,
  {rx("CASE WHEN n_positive BETWEEN 1 AND n_samples - 1 THEN pr_auc ELSE 0 END", "pr_auc")},
  {rx("CASE WHEN n_positive BETWEEN 1 AND n_samples - 1 THEN roc_auc ELSE 0 END", "roc_auc")}
FROM (SELECT unnest(['morning', 'afternoon', 'evening', 'night']) AS time_of_day) JOIN rank USING (time_of_day)""",
    "D24_always_negative": f"""
SELECT 'never' AS scorer, {", ".join(f"0.0::DOUBLE AS {n}" for n in _CUTS)}, count(*) AS n_samples,
  CAST(sum(target_session_start) AS BIGINT) AS n_positive,
  CAST(sum(1 - target_session_start) AS BIGINT) AS n_negative, {rx("avg(target_session_start)", "positive_rate")},
  {rx("avg(target_session_start)", "pr_auc")}, 0.5::DOUBLE AS roc_auc,
  {rx("avg(target_session_start)", "calibration_error")} FROM scored""",
    "D25_baseline_comparison": f"""
, {HOUR_PRIOR}, judged AS (
  SELECT 'model' AS scorer, target_session_start, y_proba FROM scored
  UNION ALL SELECT 'never', target_session_start, 0 FROM scored
  UNION ALL SELECT 'prior', target_session_start, coalesce(prior, 0) FROM scored LEFT JOIN pri USING (hour)
), {ranking_sql("judged", "scorer")}, wide AS (
  SELECT {", ".join(
      f"max({m}) FILTER (scorer = '{s}') AS {n}_{m}"
      for m in ("pr_auc", "roc_auc")
      for s, n in (("model", "model"), ("never", "baseline_neg"), ("prior", "baseline_hist")))}
  FROM rank
)
SELECT {r6(*[f"{n}_{m}" for m in ("pr_auc", "roc_auc") for n in ("model", "baseline_neg", "baseline_hist")])},
  model_pr_auc > baseline_neg_pr_auc AS model_beats_neg, model_pr_auc > baseline_hist_pr_auc AS model_beats_hist
FROM wide""",
    "D26_accuracy_and_macro_f1": f"""
, rows AS (SELECT mood_cluster_id AS t, style AS p FROM hist WHERE mood_cluster_id IS NOT NULL),
classes AS (SELECT t AS c FROM rows UNION SELECT p FROM rows),
f AS (
  SELECT c, 2 * count(*) FILTER (t = c AND p = c) / (count(*) FILTER (t = c) + count(*) FILTER (p = c)) AS f1
  FROM classes JOIN rows ON t = c OR p = c GROUP BY c
)
SELECT {rx("(SELECT avg(CASE WHEN t = p THEN 1.0 ELSE 0 END) FROM rows)", "accuracy")}, {rx("avg(f1)", "f1_macro")}
FROM f""",
    "D27_one_vs_rest_roc_area": f"""
, ids AS (SELECT cluster_id, row_number() OVER (ORDER BY cluster_id) - 1 AS i FROM moods),
long AS (
  SELECT cluster_id AS class, CASE WHEN mood_cluster_id = cluster_id THEN 1 ELSE 0 END AS target_session_start,
    CASE i % 6 {" ".join(f"WHEN {i} THEN {n}" for i, n in enumerate(FEATURES))} END AS y_proba
  FROM hist JOIN ids ON true WHERE mood_cluster_id IS NOT NULL
), {ranking_sql("long", "class")}
SELECT {rx("avg(roc_auc)", "roc_auc_ovr")} FROM rank""",
}
