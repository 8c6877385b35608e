"""From arriving plays to rows that can go into history."""

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moodstream.operators.ingest import newer_than, one_per_key
from moodstream.operators.moods import assign_moods
from moodstream.operators.sessions import DEFAULT_GAP_MINUTES, continued, sessionise
from moodstream.schemas import PLAY_KEY
from moodstream.session import staged


def prepared_batch(
    batch: DataFrame,
    tails: DataFrame | None,
    points: Sequence[dict] | None,
    gap_minutes: float = DEFAULT_GAP_MINUTES,
) -> DataFrame:
    """New complete plays of a batch, one per key, with session ids that go on from the tails, and with moods.

    `tails` (see `listener_tails`) stand for the history, which is not read. Without centroids (before the first moods
    are built) the mood column is left out.
    """
    # Of differing copies of a play the one with the greatest values counts, whatever the order of arrival.
    rest = [F.col(c).desc() for c in sorted(batch.columns) if c not in PLAY_KEY]
    fresh = one_per_key(batch.na.drop("any"), rest or [F.lit(1)])
    # Staged, as numbering reads them several times and would work them out anew each time.
    new = staged(fresh if tails is None else newer_than(fresh, tails))
    numbered = sessionise(new, gap_minutes) if tails is None else continued(new, tails, gap_minutes)
    return numbered if points is None else assign_moods(numbered, points)
