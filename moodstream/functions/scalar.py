"""Built-in column expressions: time, text, vectors, guards."""

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from moodstream.schemas import FEATURES, TRACK_ID_FIELDS

# Tempo scale, track link marker, artwork width, id length.
TEMPO_SCALE = 250.0
TRACK_LINK = "open.spotify.com/track/"
ARTWORK_WIDTH = 300
TRACK_ID_LENGTH = 22


def cyclic_sin(value: Column, period: int) -> Column:
    return F.sin(2 * F.pi() * value / F.lit(float(period)))


def cyclic_cos(value: Column, period: int) -> Column:
    return F.cos(2 * F.pi() * value / F.lit(float(period)))


def is_weekend(day: Column) -> Column:
    return (F.weekday(day) >= 5).cast("int")


def cyclic_time(ts: Column) -> dict[str, Column]:
    """Hour of day and day of week (Monday = 0) as points on a circle, and the weekend flag."""
    hour, day = F.hour(ts), F.weekday(ts)
    return {
        "hour_sin": cyclic_sin(hour, 24),
        "hour_cos": cyclic_cos(hour, 24),
        "day_sin": cyclic_sin(day, 7),
        "day_cos": cyclic_cos(day, 7),
        "is_weekend": is_weekend(ts),
    }


def minutes_between(start: Column, end: Column) -> Column:
    return (F.unix_micros(end) - F.unix_micros(start)) / F.lit(6e7)


def quarter_hour(ts: Column) -> Column:
    """Start of the epoch-aligned 15-minute bin."""
    return F.timestamp_seconds(F.floor(F.unix_seconds(ts) / 900) * 900)


def clamp01(value: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(value, F.lit(1.0)))


def tempo_norm(tempo: Column) -> Column:
    """Tempo on 0..1; an unknown tempo of a known track counts as 0."""
    return clamp01(F.coalesce(tempo, F.lit(0.0)) / TEMPO_SCALE)


def tempo_bpm(norm: Column) -> Column:
    return norm * TEMPO_SCALE


def artist_text(artists: Column) -> Column:
    """Names joined by comma and blank; no list gives an empty text."""
    return F.array_join(F.coalesce(F.transform(artists, lambda a: a["name"]), F.array()), ", ")


def artwork(images: Column) -> Column:
    """The first image of the preferred width, else the first image, else null."""
    preferred = F.try_element_at(F.filter(images, lambda i: i["width"] == ARTWORK_WIDTH), F.lit(1))["url"]
    first = F.try_element_at(images, F.lit(1))["url"]
    return F.coalesce(F.nullif(preferred, F.lit("")), first)


def id_from_link(href: Column) -> Column:
    """Track id of a track link, null for any other link."""
    found = F.regexp_extract(href, r"/track/([^?/]*)", 1)
    return F.nullif(F.when(F.contains(href, F.lit(TRACK_LINK)), found), F.lit(""))


def item_track_id(item: Column) -> Column:
    """The link's id, else the first non-empty id field."""
    fields = [F.nullif(item[name], F.lit("")) for name in TRACK_ID_FIELDS]
    return F.coalesce(id_from_link(item["href"]), *fields)


def valid_track_id(track_id: Column) -> Column:
    return F.length(track_id) == TRACK_ID_LENGTH


def _level(value: Column, high: str, low: str, middle: str) -> Column:
    return F.when(value > 0.6, high).when(value < 0.4, low).otherwise(middle)


def mood_label(valence: Column, energy: Column, acousticness: Column) -> Column:
    return F.concat(
        _level(energy, "High energy", "Low energy", "Medium energy"),
        F.lit(", "),
        _level(valence, "positive", "negative", "neutral"),
        F.when(acousticness > 0.5, ", acoustic").otherwise(""),
    )


def pct_change(recent: Column, prior: Column, floor: float) -> Column:
    """Change in percent of the prior value, which counts as at least `floor`."""
    return (recent - prior) / F.greatest(prior, F.lit(floor)) * 100


def nan_to_null(value: Column) -> Column:
    return F.when(~F.isnan(value), value)


def finite(value: Column) -> Column:
    """Null, NaN and infinities all become null."""
    return F.when(~F.isnan(value) & (F.abs(value) < F.lit(float("inf"))), value)


def nan_text(value: Column) -> Column:
    """Text of a number with the mark `NaN` for null, NaN and infinities."""
    return F.coalesce(finite(value).cast("string"), F.lit("NaN"))


def squared_distance(left: Sequence[Column], right: Sequence[Column]) -> Column:
    total = F.lit(0.0)
    for a, b in zip(left, right, strict=True):
        total = total + (a - b) * (a - b)
    return total


def feature_distance(point: dict[str, float], prefix: str = "") -> Column:
    """Squared distance of a row's features to a fixed point."""
    return squared_distance(
        [F.col(prefix + name) for name in FEATURES],
        [F.lit(float(point[name])) for name in FEATURES],
    )


def array_distance(left: Column, right: Column) -> Column:
    """Euclidean distance of two vectors held as arrays."""
    squares = F.zip_with(left, right, lambda a, b: (a - b) * (a - b))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda acc, x: acc + x))


def short_hash(*parts: Column) -> Column:
    """First eight hex digits of the md5 of the parts joined by underscores."""
    return F.substring(F.md5(F.concat_ws("_", *parts)), 1, 8)


def iso_text(ts: Column) -> Column:
    """ISO-8601 text of a UTC stamp."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS+00:00")
