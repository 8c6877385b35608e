import random
from datetime import date

import pytest

from moodstream.operators import evaluate


@pytest.fixture
def make_scored(spark):
    def build(rows):
        data = [(date(2024, 3, d), h, t, int(p >= 0.5), float(p)) for d, h, t, p in rows]
        return spark.createDataFrame(data, "date date, hour int, target_session_start int, y_pred int, y_proba double")

    return build


def brute_ap(pairs):
    hits = sum(t for t, _ in pairs)
    total, before = 0.0, 0
    for s in sorted({p for _, p in pairs}, reverse=True):
        up = [t for t, p in pairs if p >= s]
        total += (sum(up) - before) / hits * (sum(up) / len(up))
        before = sum(up)
    return total


def brute_auc(pairs):
    good, bad = [p for t, p in pairs if t], [p for t, p in pairs if not t]
    return sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / (len(good) * len(bad))


def test_four_rows(make_scored):
    rows = make_scored([(1, 0, 0, 0.1), (1, 0, 0, 0.4), (1, 0, 1, 0.35), (1, 0, 1, 0.8)])
    got = evaluate.ranking_metrics(rows).first()
    assert got["pr_auc"] == pytest.approx(0.8333333333) and got["roc_auc"] == pytest.approx(0.75)


@pytest.mark.parametrize("digits", [1, 2, 6])
def test_ranking_matches_brute_force(make_scored, digits):
    rng = random.Random(digits)
    rows = [(1, i % 24, int(rng.random() < 0.3), round(rng.random(), digits)) for i in range(500)]
    # A third of the rows share one score.
    rows += [(1, 5, i % 2, 0.5) for i in range(250)]
    pairs = [(t, p) for _, _, t, p in rows]
    got = evaluate.ranking_metrics(make_scored(rows)).first()
    assert got["pr_auc"] == pytest.approx(brute_ap(pairs)) and got["roc_auc"] == pytest.approx(brute_auc(pairs))
    few = evaluate.ranking(evaluate.score_counts(make_scored(rows))).orderBy("y_proba").first()
    assert few["_rows_up"] == len(rows) and few["_hits_up"] == sum(t for t, _ in pairs)


def test_no_rows_give_zeros(make_scored):
    got = evaluate.ranking_metrics(make_scored([])).first()
    assert tuple(got) == (0.0, 0.0, 0, 0)
    assert evaluate.ranking_metrics(make_scored([]), ["hour"]).count() == 0


def test_one_class_only(make_scored):
    none = evaluate.ranking_metrics(make_scored([(1, 0, 0, 0.2), (1, 0, 0, 0.9)])).first()
    assert (none["pr_auc"], none["roc_auc"]) == (0.0, 0.0)
    every = evaluate.ranking_metrics(make_scored([(1, 0, 1, 0.2), (1, 0, 1, 0.9)])).first()
    assert (every["pr_auc"], every["roc_auc"]) == (1.0, 0.0)


def test_f1_without_predictions_or_truth(make_scored):
    got = evaluate.threshold_metrics(make_scored([(1, 0, 0, 0.0), (1, 0, 0, 0.05)])).first()
    assert got["f1"] == 0.0 and got["f1_at_0_1"] == 0.0 and got["positive_rate"] == 0.0
    got = evaluate.threshold_metrics(make_scored([(1, 0, 1, 0.3), (1, 0, 0, 0.3), (1, 0, 1, 0.9)])).first()
    assert got["f1_at_0_3"] == pytest.approx(0.8) and got["f1"] == pytest.approx(2 / 3)


def test_score_on_a_bin_edge_is_in_the_lower_bin(make_scored):
    rows = make_scored([(1, 0, 0, p) for p in (0.0, 0.1, 0.3, 0.30000000000000004, 0.31, 0.5, 1.0)])
    got = {r["bin"]: r["n"] for r in evaluate.calibration_bins(rows).collect()}
    assert got == {0: 2, 2: 2, 3: 1, 4: 1, 9: 1}


def test_calibration_is_not_weighted(make_scored):
    rows = make_scored([(1, 0, 1, 0.95)] * 9 + [(1, 0, 0, 0.25)])
    assert evaluate.calibration_error(rows).first()[0] == pytest.approx((0.05 + 0.25) / 2)


def test_times_of_day_always_four(make_scored):
    rows = make_scored([(1, 7, 1, 0.9), (1, 8, 0, 0.1), (1, 13, 1, 0.9), (1, 2, 0, 0.3), (1, 5, 0, 0.3)])
    got = {r["time_of_day"]: r for r in evaluate.time_of_day_metrics(rows).collect()}
    assert set(got) == {"morning", "afternoon", "evening", "night"}
    assert got["morning"]["roc_auc"] == 1.0
    assert (got["afternoon"]["pr_auc"], got["afternoon"]["n_positive"]) == (0.0, 1)
    assert (got["evening"]["n_samples"], got["night"]["n_samples"]) == (0, 2)


def test_hour_prior_leaves_the_newest_date_out(make_scored):
    rows = make_scored([(1, 7, 1, 0.9), (2, 7, 0, 0.9), (2, 8, 1, 0.9), (3, 7, 1, 0.5), (3, 9, 1, 0.5)])
    assert {r["hour"]: r["prior"] for r in evaluate.hour_prior(rows).collect()} == {7: 0.5, 8: 1.0}
    one_date = rows.filter("date = '2024-03-03'")
    assert {r["hour"]: r["prior"] for r in evaluate.hour_prior(one_date).collect()} == {7: 1.0, 9: 1.0}
    judged = evaluate.with_hour_prior(rows, evaluate.hour_prior(rows)).filter("hour = 9").first()
    assert (judged["prior_proba"], judged["prior_pred"]) == (0.0, 0)


def test_comparison_is_strict(make_scored):
    rows = make_scored([(1, 7, 1, 0.5), (2, 7, 0, 0.5), (3, 7, 1, 0.5), (3, 7, 0, 0.5)])
    got = evaluate.compare_baselines(rows, evaluate.hour_prior(rows)).first()
    assert got["model_pr_auc"] == got["baseline_neg_pr_auc"] == 0.5
    assert got["model_beats_neg"] is False and got["model_beats_hist"] is False


def test_macro_f1_counts_classes_of_both_sides(spark):
    rows = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (2, 3)], "t int, p int")
    got = evaluate.class_metrics(rows, "t", "p").first()
    assert got["accuracy"] == 0.5
    assert got["f1_macro"] == pytest.approx((2 / 3 + 2 / 3 + 0 + 0) / 4)


def test_one_vs_rest(spark):
    rows = spark.createDataFrame(
        [(0, [0.8, 0.1, 0.1]), (1, [0.2, 0.7, 0.1]), (2, [0.3, 0.4, 0.3]), (0, [0.25, 0.5, 0.25])],
        "t int, p array<double>",
    )
    want = []
    for c in range(3):
        want.append(brute_auc([(int(r["t"] == c), r["p"][c]) for r in rows.collect()]))
    assert evaluate.one_vs_rest_auc(rows, "t", "p", [0, 1, 2]).first()[0] == pytest.approx(sum(want) / 3)
    assert evaluate.one_vs_rest_auc(rows.filter("t = 0"), "t", "p", [0, 1, 2]).first()[0] == 0.0
