"""Joins and row numbers that stay balanced when one key holds a large share of the rows."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# A key outside the HOT_KEYS most frequent ones holds less than 1/HOT_KEYS of the rows.
HOT_KEYS = 1000
# Rows of a long group that one task handles together.
CHUNK_ROWS = 4096


def hot_keys(rows: DataFrame, keys: Sequence[str], limit: int = HOT_KEYS) -> DataFrame:
    """The most frequent keys, at most `limit` of them. Counts are combined before the shuffle."""
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return counts.orderBy(F.desc("_n"), *keys).limit(limit).select(*keys)


def lookup_join(rows: DataFrame, table: DataFrame, keys: Sequence[str], hot: int = HOT_KEYS) -> DataFrame:
    """Left join to a table with one row per key, for `rows` whose keys may be very uneven.

    The most frequent keys (at most `hot`) are broadcast with their entries. Their rows, and rows without a key, get a
    salt that no table entry carries, so that they are spread over all tasks of the shuffle join that serves the rest:
    there are as many salts as the session has shuffle partitions.
    """
    salts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = list(keys)
    values = [c for c in table.columns if c not in keys]
    frequent = hot_keys(rows, keys, hot)
    entries = table.join(F.broadcast(frequent), keys, "left_semi").select(*keys, F.struct(*values).alias("_entry"))
    several = F.raise_error(F.lit("the table of a lookup has a key in several rows"))
    entries = entries.groupBy(*keys).agg(F.when(F.count("*") == 1, F.first("_entry")).otherwise(several).alias("_entry"))
    # Both sides have at most `hot` rows.
    known = frequent.join(F.broadcast(entries), keys, "left")
    known = known.select(*keys, "_entry", F.lit(True).alias("_hot"))
    marked = rows.join(F.broadcast(known), keys, "left")
    keyless = F.lit(False)
    for key in keys:
        keyless = keyless | F.col(key).isNull()
    salt = F.when(F.col("_hot").isNotNull() | keyless, 1 + F.pmod(F.xxhash64(*rows.columns), F.lit(salts))).otherwise(0)
    marked = marked.withColumn("_salt", salt.cast("long"))
    cold = table.select(*keys, F.struct(*values).alias("_cold"), F.lit(0).cast("long").alias("_salt"))
    joined = marked.join(cold, [*keys, "_salt"], "left")
    found = F.coalesce(F.col("_entry"), F.col("_cold"))
    return joined.select(*[F.col(c) for c in rows.columns], *[found[v].alias(v) for v in values])


def time_slice(ts: Column, minutes: int) -> Column:
    """Number of the fixed-width slice of time that holds `ts`."""
    return F.floor(F.unix_seconds(ts) / (60 * minutes))


def numbered(
    rows: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    ts: str = "played_at",
    slice_minutes: int = 60,
) -> DataFrame:
    """Adds `_pos` (0-based place in the group), `_size` and `_start` (first stamp) of the group.

    `order` starts with `ts`. A group is never sorted in one task: rows are numbered inside slices of time, and each
    slice is offset by the rows of the slices before it, of which there are few.
    """
    keys = list(keys)
    sliced = rows.withColumn("_slice", time_slice(F.col(ts), slice_minutes))
    inside = Window.partitionBy(*keys, "_slice").orderBy(*order)
    local = sliced.withColumn("_local", F.row_number().over(inside))
    slices = sliced.groupBy(*keys, "_slice").agg(F.count(F.lit(1)).alias("_n"), F.min(ts).alias("_first"))
    group = Window.partitionBy(*keys)
    earlier = group.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = slices.select(
        *keys,
        "_slice",
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"),
        F.sum("_n").over(group).alias("_size"),
        F.min("_first").over(group).alias("_start"),
    )
    placed = local.join(offsets, [*keys, "_slice"])
    return placed.withColumn("_pos", F.col("_before") + F.col("_local") - 1).drop("_slice", "_local", "_before")


def chunked(rows: DataFrame, before: int, after: int, size: int = CHUNK_ROWS) -> DataFrame:
    """Cuts numbered groups into chunks of `size` places for frames of `before` preceding and `after` following rows.

    Rows near an edge are also copied to the neighbouring chunk, so that every frame of an owned row lies in its own
    chunk. `_owned` marks the one copy of each row to keep. `size` is at least `before` and `after`.
    """
    home = F.floor(F.col("_pos") / size)
    place = F.col("_pos") - home * size
    last = F.floor((F.col("_size") - 1) / size)
    targets = F.array(
        home,
        F.when((place >= size - before) & (home < last), home + 1),
        F.when((place < after) & (home > 0), home - 1),
    )
    spread = rows.withColumn("_home", home).withColumn("_chunk", F.explode(F.array_compact(targets)))
    return spread.withColumn("_owned", F.col("_chunk") == F.col("_home")).drop("_home")
