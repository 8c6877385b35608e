import os
import sys
from datetime import datetime, timedelta, timezone

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from moodstream.schemas import FEATURES  # noqa: E402
from moodstream.session import build_session, shared_dir  # noqa: E402

START = datetime(2024, 3, 1, tzinfo=timezone.utc)


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        app="tests",
        master="local[8]",
        **{
            "spark.sql.shuffle.partitions": "3",
            "spark.default.parallelism": "3",
            "spark.ui.showConsoleProgress": "false",
            "spark.ui.enabled": "false",
            "spark.driver.memory": "8g",
            "spark.sql.execution.arrow.pyspark.enabled": "true",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    shared_dir(session)
    yield session
    session.stop()


@pytest.fixture
def make_plays(spark):
    """Plays from (listener, seconds since the start, track[, more columns]) with features given or constant."""

    def build(rows, **extra):
        names = ["listener_id", "played_at", "track_id", *extra]
        data = []
        for row in rows:
            listener, seconds, track = row[:3]
            data.append((listener, START + timedelta(seconds=seconds), track, *row[3:]))
        kinds = {"listener_id": "long", "played_at": "timestamp", "track_id": "string", **extra}
        return spark.createDataFrame(data, ", ".join(f"{n} {kinds[n]}" for n in names))

    return build


FEATURE_TYPES = {name: "double" for name in FEATURES}
