import random
from datetime import datetime, timedelta, timezone

import pytest
from conftest import START
from pyspark.sql import functions as F

from moodstream.operators.session_dataset import hourly_scoring_frame, session_samples
from moodstream.operators.sessions import sessionise


def brute(starts, plays, date, hour):
    """Features of one hour from (start, minutes) pairs and play stamps of one listener."""
    day = datetime(date.year, date.month, date.day, tzinfo=timezone.utc)
    now = day + timedelta(hours=hour)
    cells = {(s.date(), s.hour) for s, _ in starts}
    stamps = sorted(datetime(d.year, d.month, d.day, h, tzinfo=timezone.utc) for d, h in cells)

    def back(days):
        return lambda d: date - timedelta(days=days) <= d < date

    before = [s for s in stamps if s < now]
    if before:
        since = (now - before[-1]).total_seconds() / 3600
    else:
        since = min((now - stamps[0]).total_seconds() / 3600, 168.0)
    lengths = [m for s, m in starts if back(7)(s.date())]
    return {
        "rolling_listening_frequency_7d": sum(1 for d, h in cells if h == hour and back(7)(d)),
        "rolling_listening_frequency_30d": sum(1 for d, h in cells if h == hour and back(30)(d)),
        "time_since_last_session": since,
        "avg_session_duration_last_7d": sum(lengths) / len(lengths) if lengths else 0.0,
        "total_tracks_last_7d": sum(1 for p in plays if back(7)(p.date())),
        "total_tracks_last_30d": sum(1 for p in plays if back(30)(p.date())),
        "target_session_start": int((date, hour) in cells),
    }


@pytest.fixture
def case(make_plays):
    rng = random.Random(11)
    rows, clock = [], 7 * 3600 + 100
    while clock < 45 * 86_400:
        rows.append((1, clock, f"t{len(rows)}"))
        clock += rng.choice([120, 300, 900, 5_000, 40_000, 400_000])
    stamps = [START + timedelta(seconds=r[1]) for r in rows]
    starts, first = [], None
    for i, s in enumerate(stamps):
        if i == 0 or (s - stamps[i - 1]).total_seconds() > 1800:
            first = s
            starts.append([first, 0.0])
        starts[-1][1] = (s - first).total_seconds() / 60
    return sessionise(make_plays(rows)), [tuple(s) for s in starts], stamps


def test_samples_match_brute_force(case):
    history, starts, stamps = case
    rows = session_samples(history).collect()
    days = (stamps[-1].date() - stamps[0].date()).days + 1
    assert len(rows) == days * 24
    # Early hours of the first day come before the first session: the hours since it are negative.
    assert min(r["time_since_last_session"] for r in rows) == -7.0
    for r in rows:
        for name, value in brute(starts, stamps, r["date"], r["hour"]).items():
            assert r[name] == pytest.approx(value), (r["date"], r["hour"], name)


@pytest.mark.parametrize("ahead", [0, 1, 9, 60])
def test_scoring_frame_matches_brute_force(case, ahead):
    history, starts, stamps = case
    as_of = stamps[-1].date() + timedelta(days=ahead)
    rows = hourly_scoring_frame(history, F.lit(as_of)).collect()
    assert len(rows) == 24
    for r in rows:
        want = brute(starts, stamps, as_of, r["hour"])
        want.pop("target_session_start")
        for name, value in want.items():
            assert r[name] == pytest.approx(value), (r["hour"], name)
