"""Cutting plays into listening sessions, and per-session facts."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from moodstream.functions.scalar import minutes_between
from moodstream.operators.skew import lookup_join, time_slice

DEFAULT_GAP_MINUTES = 30
SLICE_MINUTES = 60


def _longer(start: Column, end: Column, gap_minutes: float) -> Column:
    """1 where the pause is strictly longer than the gap; 0 without a previous play."""
    pause = F.unix_micros(end) - F.unix_micros(start)
    return F.coalesce((pause > int(gap_minutes * 60_000_000)).cast("long"), F.lit(0).cast("long"))


def _slice_edges(plays: DataFrame, gap_minutes: float, slice_minutes: int) -> DataFrame:
    """Per listener and time slice: last play of the slices before, and session breaks up to the slice's first play."""
    cut = plays.select("listener_id", "played_at", time_slice(F.col("played_at"), slice_minutes).alias("_slice"))
    inside = Window.partitionBy("listener_id", "_slice").orderBy("played_at")
    steps = cut.withColumn("_break", _longer(F.lag("played_at").over(inside), F.col("played_at"), gap_minutes))
    slices = steps.groupBy("listener_id", "_slice").agg(
        F.min("played_at").alias("_first"),
        F.max("played_at").alias("_last"),
        F.sum("_break").alias("_breaks"),
    )
    by_slice = Window.partitionBy("listener_id").orderBy("_slice")
    slices = slices.withColumn("_prior", F.lag("_last").over(by_slice))
    opens = _longer(F.col("_prior"), F.col("_first"), gap_minutes)
    breaks_before = F.sum("_breaks").over(by_slice.rowsBetween(Window.unboundedPreceding, -1))
    return slices.select(
        "listener_id",
        "_slice",
        "_prior",
        (F.sum(opens).over(by_slice) + F.coalesce(breaks_before, F.lit(0))).alias("_offset"),
    )


def with_previous(
    plays: DataFrame, gap_minutes: float = DEFAULT_GAP_MINUTES, slice_minutes: int = SLICE_MINUTES
) -> DataFrame:
    """Adds `previous_played_at` and `session_id` (0, 1, 2... per listener in time order).

    The work is split by listener and slice of time; only one small row per slice is ordered per listener, so a
    listener with a large share of all plays is spread over many tasks.
    """
    edges = _slice_edges(plays, gap_minutes, slice_minutes)
    cut = plays.withColumn("_slice", time_slice(F.col("played_at"), slice_minutes))
    inside = Window.partitionBy("listener_id", "_slice").orderBy("played_at", "track_id")
    local = cut.withColumn("_lag", F.lag("played_at").over(inside))
    local = local.withColumn("_break", _longer(F.col("_lag"), F.col("played_at"), gap_minutes))
    running = F.sum("_break").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    local = local.withColumn("_local", running)
    joined = local.join(edges, ["listener_id", "_slice"])
    return joined.select(
        *[F.col(c) for c in plays.columns],
        F.coalesce("_lag", "_prior").alias("previous_played_at"),
        (F.col("_offset") + F.col("_local")).alias("session_id"),
    )


def play_gaps(plays: DataFrame, slice_minutes: int = SLICE_MINUTES) -> DataFrame:
    """Adds `gap_minutes` since the listener's previous play, null for the first."""
    linked = with_previous(plays, slice_minutes=slice_minutes)
    gap = minutes_between(F.col("previous_played_at"), F.col("played_at"))
    return linked.withColumn("gap_minutes", gap).drop("previous_played_at", "session_id")


def sessionise(
    plays: DataFrame, gap_minutes: float = DEFAULT_GAP_MINUTES, slice_minutes: int = SLICE_MINUTES
) -> DataFrame:
    """Adds `session_id`; a new session starts after a pause strictly longer than the gap."""
    base = plays.drop("session_id")
    return with_previous(base, gap_minutes, slice_minutes).drop("previous_played_at")


def listener_tails(history: DataFrame) -> DataFrame:
    """Per listener: the latest play, and number and start of the last session. All that new plays need to go on."""
    sessions = history.groupBy("listener_id", "session_id").agg(
        F.max("played_at").alias("latest_played_at"), F.min("played_at").alias("last_session_start")
    )
    return _last_sessions(sessions)


def tails_of_days(days: DataFrame) -> DataFrame:
    """The listener tails, from session days."""
    sessions = days.groupBy("listener_id", "session_id").agg(
        F.max("last_play").alias("latest_played_at"), F.min("first_play").alias("last_session_start")
    )
    return _last_sessions(sessions)


def _last_sessions(sessions: DataFrame) -> DataFrame:
    last = F.max(F.struct("session_id", "last_session_start", "latest_played_at"))
    return (
        sessions.groupBy("listener_id")
        .agg(last.alias("_last"))
        .select(
            "listener_id",
            F.col("_last.latest_played_at").alias("latest_played_at"),
            F.col("_last.session_id").alias("last_session_id"),
            F.col("_last.last_session_start").alias("last_session_start"),
        )
    )


def extended_tails(tails: DataFrame, batch: DataFrame) -> DataFrame:
    """The tails after a batch with session ids went into history."""
    both = tails.unionByName(listener_tails(batch)).groupBy(
        "listener_id", F.col("last_session_id").alias("session_id")
    )
    return _last_sessions(
        both.agg(
            F.max("latest_played_at").alias("latest_played_at"), F.min("last_session_start").alias("last_session_start")
        )
    )


def continued(new: DataFrame, tails: DataFrame, gap_minutes: float = DEFAULT_GAP_MINUTES) -> DataFrame:
    """Session ids for plays later than the listener's tail, which they go on from."""
    heads = new.groupBy("listener_id").agg(F.min("played_at").alias("_begin"))
    opens = _longer(F.col("latest_played_at"), F.col("_begin"), gap_minutes)
    shift = heads.join(tails, "listener_id").select(
        "listener_id", (F.col("last_session_id") + opens).alias("_shift")
    )
    ids = lookup_join(sessionise(new, gap_minutes), shift, ["listener_id"])
    return ids.withColumn("session_id", F.col("session_id") + F.coalesce("_shift", F.lit(0))).drop("_shift")


def continue_sessions(new: DataFrame, history: DataFrame, gap_minutes: float = DEFAULT_GAP_MINUTES) -> DataFrame:
    """Session ids for plays later than all of the listener's history, without ordering the history again."""
    return continued(new, listener_tails(history), gap_minutes)


def session_days(history: DataFrame) -> DataFrame:
    """One row per listener, session and date: the compact base of all session facts.

    Its rows per listener are bounded by the calendar, whatever the number of plays.
    """
    return history.groupBy("listener_id", "session_id", F.to_date("played_at").alias("date")).agg(
        F.min("played_at").alias("first_play"),
        F.max("played_at").alias("last_play"),
        F.count(F.lit(1)).alias("n_plays"),
    )


def as_session_days(rows: DataFrame) -> DataFrame:
    """Session days as they are, or those of a history. Jobs derive them once for all their summaries."""
    return rows if "n_plays" in rows.columns else session_days(rows)


def by_listener(rows: DataFrame) -> DataFrame:
    """The rows brought together by listener, for several steps that all work on that partitioning.

    For rows bounded by the calendar, which grow again later: a fixed number of partitions is not merged at run time.
    """
    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(partitions, "listener_id")


def session_facts(history: DataFrame) -> DataFrame:
    """Start, end, start date and hour, duration in minutes, and size of each session, from plays or session days."""
    first, last, size = "played_at", "played_at", F.count(F.lit(1))
    if "n_plays" in history.columns:
        first, last, size = "first_play", "last_play", F.sum("n_plays")
    per_session = history.groupBy("listener_id", "session_id").agg(
        F.min(first).alias("session_start"), F.max(last).alias("session_end"), size.alias("n_tracks")
    )
    return per_session.select(
        "listener_id",
        "session_id",
        "session_start",
        "session_end",
        F.to_date("session_start").alias("date"),
        F.hour("session_start").alias("hour"),
        minutes_between(F.col("session_start"), F.col("session_end")).alias("duration_minutes"),
        "n_tracks",
    )


def start_hours(history: DataFrame) -> DataFrame:
    """Distinct (listener, date, hour) with at least one session start."""
    return session_facts(history).select("listener_id", "date", "hour").distinct()


def history_counts(history: DataFrame) -> DataFrame:
    """Number of plays and of distinct sessions, from plays or session days."""
    size = F.sum("n_plays") if "n_plays" in history.columns else F.count(F.lit(1))
    sessions = history.groupBy("listener_id", "session_id").agg(size.alias("n"))
    return sessions.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("num_tracks"), F.count(F.lit(1)).alias("num_sessions")
    )
