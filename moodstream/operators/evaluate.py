"""Scores against truth: ranking metrics, thresholds, calibration, baselines.

A scored table has `target_session_start` (0 or 1), `y_pred`, `y_proba`, and the columns named in `by`. Rows are first
combined per distinct score, then ordered inside ranges of the score; only one row per range is ordered as a whole. So
neither a frequent score nor a long table lands in one task.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from moodstream.operators.ranges import running

TARGET = "target_session_start"
# Thresholds of the F1 table, number of calibration bins, hours of the times of day.
THRESHOLDS = [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]
CALIBRATION_BINS = 10
TIMES_OF_DAY = {"morning": (6, 11), "afternoon": (12, 17), "evening": (18, 23), "night": (0, 5)}


def score_counts(scored: DataFrame, by: Sequence[str] = (), target: str = TARGET) -> DataFrame:
    """Rows and positives per distinct score."""
    return scored.groupBy(*by, "y_proba").agg(
        F.count(F.lit(1)).alias("_rows"), F.sum(F.col(target).cast("long")).alias("_hits")
    )


def ranking(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Adds to each distinct score the rows and positives at that score or higher (`_rows_up`, `_hits_up`)."""
    return running(counts, [F.desc("y_proba")], {"_rows_up": "_rows", "_hits_up": "_hits"}, by)


def ranking_metrics(scored: DataFrame, by: Sequence[str] = (), target: str = TARGET) -> DataFrame:
    """Average precision and area under the ROC curve per group; both 0 where undefined.

    Ties count as one step of the precision curve, and half in the ROC area.
    """
    curve = ranking(score_counts(scored, by, target), by)
    misses = F.col("_rows") - F.col("_hits")
    sums = curve.groupBy(*by).agg(
        F.coalesce(F.sum("_rows"), F.lit(0)).alias("n_samples"),
        F.coalesce(F.sum("_hits"), F.lit(0)).alias("n_positive"),
        F.sum(F.col("_hits") * (F.col("_hits_up") / F.col("_rows_up"))).alias("_precision"),
        F.sum(misses * (F.col("_hits_up") - F.col("_hits") / 2)).alias("_wins"),
        F.sum(misses).alias("_misses"),
    )
    hits = F.col("n_positive")
    both = (hits > 0) & (F.col("_misses") > 0)
    return sums.select(
        *by,
        F.when(hits > 0, F.col("_precision") / hits).otherwise(0.0).alias("pr_auc"),
        F.when(both, F.col("_wins") / (hits * F.col("_misses"))).otherwise(0.0).alias("roc_auc"),
        "n_samples",
        "n_positive",
    )


def f1(hits: Column, predicted: Column, positives: Column) -> Column:
    """Twice the hits over predicted plus true positives; 0 where undefined."""
    return F.when(predicted + positives > 0, 2 * hits / (predicted + positives)).otherwise(0.0)


def threshold_metrics(scored: DataFrame, by: Sequence[str] = (), target: str = TARGET) -> DataFrame:
    """F1 of the predictions and at each threshold of the score, and the sample counts, in one pass."""
    truth = F.col(target).cast("long")

    def flagged(condition: Column) -> list[Column]:
        flag = condition.cast("long")
        return [F.sum(flag), F.sum(flag * truth)]

    cuts = {"f1": F.col("y_pred") == 1}
    cuts.update({f"f1_at_{t:.1f}".replace(".", "_"): F.col("y_proba") >= t for t in THRESHOLDS})
    sums = []
    for name, condition in cuts.items():
        predicted, hits = flagged(condition)
        sums += [predicted.alias(f"_p_{name}"), hits.alias(f"_h_{name}")]
    total = scored.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_samples"), F.coalesce(F.sum(truth), F.lit(0)).alias("n_positive"), *sums
    )
    return total.select(
        *by,
        *[f1(F.col(f"_h_{n}"), F.col(f"_p_{n}"), F.col("n_positive")).alias(n) for n in cuts],
        "n_samples",
        "n_positive",
        (F.col("n_samples") - F.col("n_positive")).alias("n_negative"),
        (F.col("n_positive") / F.greatest(F.col("n_samples"), F.lit(1))).alias("positive_rate"),
    )


def calibration_bins(scored: DataFrame, by: Sequence[str] = (), target: str = TARGET) -> DataFrame:
    """Rate of positives and mean score per uniform bin; a score on an inner edge is in the lower bin."""
    place = F.lit(0)
    for i in range(1, CALIBRATION_BINS):
        place = place + (F.col("y_proba") > F.lit(i * 0.1)).cast("int")
    return scored.groupBy(*by, place.alias("bin")).agg(
        F.avg(F.col(target).cast("double")).alias("positive_rate"),
        F.avg("y_proba").alias("mean_score"),
        F.count(F.lit(1)).alias("n"),
    )


def calibration_error(scored: DataFrame, by: Sequence[str] = (), target: str = TARGET) -> DataFrame:
    """Plain mean over the non-empty bins of the distance between rate and score."""
    off = F.abs(F.col("positive_rate") - F.col("mean_score"))
    return calibration_bins(scored, by, target).groupBy(*by).agg(F.avg(off).alias("calibration_error"))


def metrics(scored: DataFrame, by: Sequence[str] = (), target: str = TARGET) -> DataFrame:
    """All metrics of each group in one row (`by` names at least one column)."""
    ranks = ranking_metrics(scored, by, target).drop("n_samples", "n_positive")
    cuts = threshold_metrics(scored, by, target)
    return cuts.join(ranks, list(by)).join(calibration_error(scored, by, target), list(by))


def time_of_day(hour: Column) -> Column:
    names = [F.when(hour.between(low, high), name) for name, (low, high) in TIMES_OF_DAY.items()]
    return F.coalesce(*names)


def time_of_day_metrics(scored: DataFrame, target: str = TARGET) -> DataFrame:
    """Ranking metrics of the four times of day; zeros for one without rows or with a single class."""
    split = scored.withColumn("time_of_day", time_of_day(F.col("hour")))
    found = ranking_metrics(split, ["time_of_day"], target)
    mixed = (F.col("n_positive") > 0) & (F.col("n_positive") < F.col("n_samples"))
    names = scored.sparkSession.createDataFrame([(n,) for n in TIMES_OF_DAY], "time_of_day string")
    return names.join(found, "time_of_day", "left").select(
        "time_of_day",
        F.when(mixed, F.col("pr_auc")).otherwise(0.0).alias("pr_auc"),
        F.when(mixed, F.col("roc_auc")).otherwise(0.0).alias("roc_auc"),
        F.coalesce("n_samples", F.lit(0)).alias("n_samples"),
        F.coalesce("n_positive", F.lit(0)).alias("n_positive"),
    )


def hour_prior(labelled: DataFrame, target: str = TARGET) -> DataFrame:
    """Rate of positives per hour of day, before the newest date; over all rows where nothing is older."""
    truth = F.col(target).cast("long")
    older = F.col("date") < F.col("_newest")
    newest = labelled.select(F.max("date")).scalar()
    hours = (
        labelled.select("hour", "date", target)
        .withColumn("_newest", newest)
        .groupBy("hour")
        .agg(
            F.coalesce(F.sum(F.when(older, truth)), F.lit(0)).alias("_old_hits"),
            F.count(F.when(older, 1)).alias("_old_rows"),
            F.sum(truth).alias("_hits"),
            F.count(F.lit(1)).alias("_rows"),
        )
    )
    # At most 24 rows from here on.
    any_old = F.sum("_old_rows").over(Window.partitionBy(F.lit(0))) > 0
    seen = hours.withColumn("_any", any_old).filter(~F.col("_any") | (F.col("_old_rows") > 0))
    rate = F.when(F.col("_any"), F.col("_old_hits") / F.greatest("_old_rows", F.lit(1))).otherwise(
        F.col("_hits") / F.greatest("_rows", F.lit(1))
    )
    return seen.select("hour", rate.alias("prior"))


def with_hour_prior(scored: DataFrame, prior: DataFrame) -> DataFrame:
    """Adds `prior_proba` (0 for an hour never seen) and `prior_pred`. The prior has one row per hour of day."""
    joined = scored.join(prior, "hour", "left")
    proba = F.coalesce("prior", F.lit(0.0))
    return joined.withColumns({"prior_proba": proba, "prior_pred": (proba >= 0.5).cast("int")}).drop("prior")


def all_scorers(scored: DataFrame, prior: DataFrame, target: str = TARGET) -> DataFrame:
    """The rows as judged by the model and by both baselines, told apart by `scorer`."""
    wide = with_hour_prior(scored, prior)

    def entry(name: str, pred: Column, proba: Column) -> Column:
        return F.struct(F.lit(name).alias("scorer"), pred.alias("y_pred"), proba.alias("y_proba"))

    entries = F.array(
        entry("model", F.col("y_pred").cast("int"), F.col("y_proba")),
        entry("always_negative", F.lit(0), F.lit(0.0)),
        entry("historical_hour", F.col("prior_pred"), F.col("prior_proba")),
    )
    return wide.select("date", "hour", target, F.inline(entries))


def compare_baselines(scored: DataFrame, prior: DataFrame, target: str = TARGET) -> DataFrame:
    """One row: ranking metrics of the model and both baselines, and whether the model beats each."""
    ranks = ranking_metrics(all_scorers(scored, prior, target), ["scorer"], target)

    def of(scorer: str, metric: str) -> Column:
        return F.max(F.when(F.col("scorer") == scorer, F.col(metric)))

    row = ranks.agg(
        of("model", "pr_auc").alias("model_pr_auc"),
        of("always_negative", "pr_auc").alias("baseline_neg_pr_auc"),
        of("historical_hour", "pr_auc").alias("baseline_hist_pr_auc"),
        of("model", "roc_auc").alias("model_roc_auc"),
        of("always_negative", "roc_auc").alias("baseline_neg_roc_auc"),
        of("historical_hour", "roc_auc").alias("baseline_hist_roc_auc"),
    )
    return row.withColumns(
        {
            "model_beats_neg": F.col("model_pr_auc") > F.col("baseline_neg_pr_auc"),
            "model_beats_hist": F.col("model_pr_auc") > F.col("baseline_hist_pr_auc"),
        }
    )


def class_counts(rows: DataFrame, target: str) -> DataFrame:
    """Rows per class."""
    return rows.groupBy(F.col(target).alias("class")).agg(F.count(F.lit(1)).alias("n"))


def class_metrics(rows: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Accuracy, and F1 averaged over the classes seen in truth or prediction."""
    pairs = rows.groupBy(F.col(truth).alias("_t"), F.col(predicted).cast("int").alias("_p")).agg(
        F.count(F.lit(1)).alias("_n")
    )
    sides = F.array(
        F.struct(F.col("_t").alias("class"), F.lit(1).alias("_true"), F.lit(0).alias("_pred")),
        F.struct(F.col("_p").alias("class"), F.lit(0).alias("_true"), F.lit(1).alias("_pred")),
    )
    per_class = (
        pairs.select("_n", (F.col("_t") == F.col("_p")).cast("long").alias("_hit"), F.inline(sides))
        .groupBy("class")
        .agg(
            F.sum(F.col("_n") * F.col("_true")).alias("_positives"),
            F.sum(F.col("_n") * F.col("_pred")).alias("_predicted"),
            F.sum(F.col("_n") * F.col("_hit") * F.col("_true")).alias("_hits"),
        )
    )
    score = f1(F.col("_hits"), F.col("_predicted"), F.col("_positives"))
    return per_class.agg(
        (F.sum("_hits") / F.sum("_positives")).alias("accuracy"), F.avg(score).alias("f1_macro")
    )


def one_vs_rest_auc(rows: DataFrame, truth: str, probabilities: str, classes: Sequence[int]) -> DataFrame:
    """ROC area of each class against the others, averaged; two classes use the second alone.

    `probabilities` is an array aligned with `classes`. A class absent (or alone) makes the result 0.
    """
    judged = list(enumerate(classes))[1:] if len(classes) == 2 else list(enumerate(classes))
    entries = F.array(
        *[
            F.struct(
                F.lit(int(c)).alias("class"),
                (F.col(truth) == int(c)).cast("int").alias(TARGET),
                F.element_at(probabilities, i + 1).alias("y_proba"),
            )
            for i, c in judged
        ]
    )
    areas = ranking_metrics(rows.select(F.inline(entries)), ["class"])
    mixed = (F.col("n_positive") > 0) & (F.col("n_positive") < F.col("n_samples"))
    return areas.agg(
        F.when(F.min(mixed.cast("int")) == 1, F.avg("roc_auc")).otherwise(0.0).alias("roc_auc_ovr")
    )
