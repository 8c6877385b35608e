"""Context of arriving plays from state: the last plays of each open session, so that no history is read."""

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from moodstream.functions.scalar import cyclic_time, minutes_between
from moodstream.operators.mood_dataset import PLAY_ORDER, SESSION, WINDOW_SIZE, sample_columns
from moodstream.operators.sessions import DEFAULT_GAP_MINUTES
from moodstream.schemas import FEATURES

#: State and plays are dealt out by a hash of the session to so many groups, each of which is handled as whole columns:
#: a call for each session would cost far more than its few plays. A stream keeps the number that it began with.
SHARDS = 1024
_KEPT = ["mood_cluster_id", *FEATURES]
_COLUMNS = [*SESSION, *PLAY_ORDER, *_KEPT]
_EPOCH = pd.Timestamp(0)


def _state(kinds: dict[str, str]) -> str:
    """Of each open session its key, plays so far, first play in microseconds, end in milliseconds, and the last values."""
    keys = [f"{c} array<{kinds[c]}>" for c in SESSION]
    return ", ".join([*keys, *[f"{c} array<bigint>" for c in ("n", "start", "until")], *[f"{c} array<double>" for c in _KEPT]])


def _micros(column: pd.Series) -> pd.Series:
    return (column.dt.tz_localize(None) if column.dt.tz is not None else column).sub(_EPOCH) // pd.Timedelta(microseconds=1)


def _first_of_session(plays: pd.DataFrame) -> np.ndarray:
    """Places where a session begins in plays ordered by session."""
    differs = np.zeros(len(plays), bool)
    differs[:1] = True
    for c in SESSION:
        values = plays[c].to_numpy()
        differs[1:] |= values[1:] != values[:-1]
    return np.flatnonzero(differs)


def _follow(window_size: int, gap_minutes: float):
    """Hands each play of a shard's sessions the plays before it, and keeps their last `window_size` for the next micro-batch."""
    wait = int(gap_minutes * 60_000) + 1
    window = np.arange(window_size)

    def follow(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        del key
        now = state.getCurrentWatermarkMs()
        held = list(state.get) if state.exists else [[] for _ in range(len(SESSION) + 3 + len(_KEPT))]
        keys = list(zip(*held[: len(SESSION)], strict=True))
        # A last entry stands for sessions that are not known yet.
        n, start, until = (np.append(np.array(c, np.int64), 0) for c in held[len(SESSION) : len(SESSION) + 3])
        tails = [np.append(np.array(t, float), np.full(window_size, np.nan)).reshape(-1, window_size) for t in held[-len(_KEPT) :]]
        stays = until >= now
        stays[-1] = False
        told = {}
        if not state.hasTimedOut:
            plays = pd.concat(list(frames))[_COLUMNS].sort_values([*SESSION, *PLAY_ORDER], kind="stable", ignore_index=True)
            micros = _micros(plays["played_at"]).to_numpy(np.int64)
            begins = _first_of_session(plays)
            sizes = np.diff(np.append(begins, len(plays)))
            found = list(zip(*[plays[c].iloc[begins].tolist() for c in SESSION], strict=True))
            place = {k: i for i, k in enumerate(keys)}
            at = np.array([place.get(k, -1) for k in found], np.int64)
            stays[at] = False
            begun = np.where(at >= 0, start[at], micros[begins])
            ends = np.maximum(micros[begins + sizes - 1] // 1000 + wait, now + 1)
            told = {"keys": found, "n": n[at] + sizes, "start": begun, "until": ends, "tails": []}
            # Each session's values stand behind those kept of it.
            session = np.repeat(np.arange(len(begins)), sizes)
            inside = np.arange(len(plays)) - begins[session]
            head = begins + window_size * np.arange(len(begins))
            out = {"_pos": n[at][session] + inside, "_start": begun[session]}
            for column, tail in zip(_KEPT, tails, strict=True):
                values = np.empty(len(plays) + window_size * len(begins))
                values[head[:, None] + window] = tail[at]
                values[head[session] + window_size + inside] = plays[column].to_numpy(float, na_value=np.nan)
                for i in range(window_size):
                    earlier = values[head[session] + inside + i]
                    out[f"_{column}_{i}"] = pd.arrays.FloatingArray(earlier, np.isnan(earlier))
                told["tails"].append(values[(head + sizes)[:, None] + window])
        kept = [keys[i] for i in np.flatnonzero(stays)] + (told["keys"] if told else [])
        if not kept:
            state.remove()
            return

        def both(old: np.ndarray, new: np.ndarray | None) -> np.ndarray:
            return old[stays] if new is None else np.concatenate([old[stays], new])

        until = both(until, told.get("until"))
        news = told.get("tails") or [None] * len(tails)
        lasts = [both(t, new).ravel().tolist() for t, new in zip(tails, news, strict=True)]
        columns = [list(c) for c in zip(*kept, strict=True)]
        state.update((*columns, both(n, told.get("n")).tolist(), both(start, told.get("start")).tolist(), until.tolist(), *lasts))
        state.setTimeoutTimestamp(max(int(until.min()), now + 1))
        if told:
            yield pd.concat([plays, pd.DataFrame(out)], axis=1)

    return follow


def _places(name: str, window_size: int) -> list[Column]:
    return [F.col(f"_{name}_{i}") for i in range(window_size)]


def _present(values: list[Column]) -> Column:
    return sum((v.isNotNull().cast("int") for v in values), F.lit(0))


def _mean(values: list[Column]) -> Column:
    """Mean of the values that are not null; null if none is."""
    count = _present(values)
    return F.when(count > 0, sum((F.coalesce(v, F.lit(0.0)) for v in values), F.lit(0.0)) / count)


def _stats(name: str, window_size: int) -> dict[str, Column]:
    """Mean and population deviation of a feature over the plays before; 0 where it has no value."""
    values = _places(name, window_size)
    mean = _mean(values)
    spread = F.sqrt(_mean([(v - mean) * (v - mean) for v in values]))
    return {f"{name}_mean": F.coalesce(mean, F.lit(0.0)), f"{name}_std": F.coalesce(spread, F.lit(0.0))}


def stream_context(
    plays: DataFrame,
    window_size: int = WINDOW_SIZE,
    gap_minutes: float = DEFAULT_GAP_MINUTES,
    delay: str = "1 hour",
) -> DataFrame:
    """Per arriving play (with session and mood) the sample of the plays before it in its session, as `scoring_context` gives
    it from a stored history.

    State holds `window_size` plays per open session; it goes once the watermark is past the session's last play by more than the
    gap, when nothing can follow. Plays should arrive in the order of a session, in any cut into micro-batches; a play that
    arrives after a later one counts as the later, and one later than `delay` is left out. Of one shard of
    sessions, the plays of a micro-batch meet in one call.
    """
    kinds = {f.name: f.dataType.simpleString() for f in plays.schema.fields}
    kept = ", ".join(f"_{c}_{i} double" for c in _KEPT for i in range(window_size))
    schema = ", ".join(f"{c} {kinds[c]}" for c in _COLUMNS) + f", _pos long, _start long, {kept}"
    known = plays.where("listener_id is not null and session_id is not null and played_at is not null")
    held = (
        known.select(*_COLUMNS, F.pmod(F.xxhash64(*SESSION), F.lit(SHARDS)).alias("_shard"))
        .withWatermark("played_at", delay)
        .groupBy("_shard")
        .applyInPandasWithState(_follow(window_size, gap_minutes), schema, _state(kinds), "append", GroupStateTimeout.EventTimeTimeout)
    )
    moods = _places("mood_cluster_id", window_size)
    stats = {k: v for name in FEATURES for k, v in _stats(name, window_size).items()}
    return held.withColumns(
        {
            **{f"mood_cluster_{i}": moods[i].cast("int") for i in range(window_size)},
            **stats,
            **cyclic_time(F.col("played_at")),
            "session_position": (F.col("_pos") + 1).cast("int"),
            "session_length": (F.col("_pos") + 1).cast("int"),
            "time_since_session_start": minutes_between(F.timestamp_micros("_start"), F.col("played_at")),
            **{f"current_{name}": F.coalesce(F.col(name), F.lit(0.0)) for name in FEATURES},
            "ready": _present(moods) == window_size,
        }
    ).select(*SESSION, *PLAY_ORDER, "mood_cluster_id", "ready", *sample_columns(window_size))
