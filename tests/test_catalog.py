import check_sql
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
# One or two of each kind; `python tests/check_sql.py` runs them all.
KEYS = [
    "A5_feature_payload",
    "A8_stored_history_upsert",
    "B1_high_water_filter",
    "B7_recent_and_prior_periods",
    "C2_feature_enrichment",
    "C4_new_rows_with_sessions",
    "D15_feature_drift",
    "D25_baseline_comparison",
    "E2_sessionise_one_history",
    "E10_preceding_context",
    "E13_latest_window",
    "F7_time_split",
    "K4_incremental_assignment",
    "N1_recommended_tracks",
    "S1_stream_ingest",
    "S3_stream_late_data",
    "S4_stream_sessions",
    "J4_mood_training_table",
    "J5_session_training_table",
]


@pytest.fixture(scope="module")
def con():
    return check_sql.connect(SF)


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("key", KEYS)
def test_query_equals_sql(spark, con, key):
    problem, _ = check_sql.compare(spark, con, SF, entry.queries()[key], entry.oracle_sql()[key])
    assert problem is None


@pytest.mark.parametrize("key, job", [("J2_full_retrain", "run_full_retrain"), ("J3_bootstrap", "run_bootstrap")])
def test_whole_jobs_are_registered_at_full_size(spark, monkeypatch, key, job):
    from moodstream.plans import jobs

    class Begun(Exception):
        pass

    def begun(*given):
        raise Begun([g for g in given if isinstance(g, jobs.Sizes)])

    monkeypatch.setattr(jobs, job, begun)
    with pytest.raises(Begun) as seen:
        entry.queries()[key](spark, SF)
    assert seen.value.args[0] == [jobs.Sizes()]


def test_entry(spark):
    rows = entry.entry(spark)
    assert rows.columns == ["listener_id", "hour", "sessions", "share"] and rows.count() % 24 == 0


def test_no_window_over_all_plays(spark):
    """Every exchange of the sessionising plan is by key; nothing is gathered in one partition."""
    from moodstream.plans.catalog.common import sessions

    plan = sessions(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan and "CartesianProduct" not in plan
