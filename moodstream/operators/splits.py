"""Train and validation splits without ordering the whole table.

Rows are ordered by coarse keys first and by fine keys inside them. Counts per coarse key show where the cut falls; the
last row before it becomes a record, and a row's part follows from comparing it with that record.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from moodstream.functions.scalar import nan_to_null
from moodstream.operators.ranges import running

TEST_SIZE = 0.2
SEED = 42
SHARDS = 1024


def _thresholds(
    rows: DataFrame, strata: Sequence[str], coarse: Sequence[str], fine: Sequence[str], first: float
) -> DataFrame:
    """Per stratum, the record that the cut falls on: strata and `_last`, the place of the last train row.

    One aggregate counts rows per coarse key; running sums over it show through which key the cut runs, and how far into
    it. Only the rows of that key are ordered by `fine`. A stratum whose first part is empty has no record. Totals and
    cuts, a row per stratum each, are named as what to broadcast: rows that are small as files may be far too many.
    """
    counts = rows.groupBy(*strata, *coarse).agg(F.count(F.lit(1)).alias("_n"))
    up_to = running(counts, [F.asc(c) for c in coarse], {"_to": "_n"}, strata)
    names = [F.col(c).alias(f"_of_{c}") for c in strata]
    totals = up_to.groupBy(*strata).agg(F.floor(F.max("_to") * F.lit(first) + F.lit(1e-9)).alias("_cut")).select(*names, "_cut")
    through = up_to.join(F.broadcast(totals), _alike(strata)).filter((F.col("_to") >= F.col("_cut")) & (F.col("_to") - F.col("_n") < F.col("_cut")))
    through = through.select(*names, *[F.col(c).alias(f"_of_{c}") for c in coarse], (F.col("_cut") - F.col("_to") + F.col("_n")).alias("_rest"))
    met = rows.join(F.broadcast(through), _alike([*strata, *coarse]))
    place = F.row_number().over(Window.partitionBy(*(strata or coarse)).orderBy(*fine))
    last = met.select(*strata, _place(coarse, fine).alias("_last"), place.alias("_k"), "_rest").filter("_k = _rest")
    return last.select(*names, "_last")


def _alike(columns: Sequence[str]) -> Column:
    same = F.lit(True)
    for c in columns:
        same = same & F.col(c).eqNullSafe(F.col(f"_of_{c}"))
    return same


def _place(coarse: Sequence[str], fine: Sequence[str]) -> Column:
    """Where a row stands in the order; the same value for every table of rows."""
    return F.struct(*[F.col(c).alias(f"p{k}") for k, c in enumerate([*coarse, *fine])])


def _cut(rows: DataFrame, strata: Sequence[str], coarse: Sequence[str], fine: Sequence[str], first: float) -> DataFrame:
    """Adds `part`: `train` for the first floor(n * first) rows of each stratum in the order of coarse and fine keys.

    Three passes over the rows: counts per coarse key, the rows of the one key that the cut runs through, and the labels, for which
    each row is compared with its stratum's record. Rows alike in all keys fall on the same side.
    """
    strata, coarse, fine = list(strata), list(coarse), list(fine)
    record = _thresholds(rows, strata, coarse, fine, first)
    if strata:
        # One record per class.
        marked = rows.join(record, _alike(strata), "left")
        last = F.col("_last")
    else:
        found = record.select("_last").first()
        kind = record.schema["_last"].dataType
        marked = rows
        last = F.lit(None) if found is None else F.struct(
            *[F.lit(found[0][f.name]).cast(f.dataType).alias(f.name) for f in kind.fields]
        )
    train = F.coalesce(_place(coarse, fine) <= last, F.lit(False))
    return marked.select(*rows.columns, F.when(train, "train").otherwise("val").alias("part"))


def time_split(
    rows: DataFrame,
    test_size: float = TEST_SIZE,
    by: Sequence[str] = ("date", "hour"),
    key: str = "listener_id",
    more: Sequence[str] = (),
) -> DataFrame:
    """The earlier rows train, the later ones validate; no row is in both. `more` tells rows of one `by` and `key` apart."""
    sharded = rows.withColumn("_shard", F.pmod(F.col(key), F.lit(SHARDS)))
    return _cut(sharded, [], [*by, "_shard"], [key, *more], 1 - test_size).drop("_shard")


def row_hash(keys: Sequence[str], seed: int = SEED) -> Column:
    """A repeatable pseudo-random number of a row's keys, as 8 hex digits."""
    return F.substring(F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in keys], F.lit(str(seed)))), 1, 8)


def _hashed(rows: DataFrame, keys: Sequence[str], seed: int) -> DataFrame:
    """Adds the row hash, and of its first digits 65,536 shards."""
    hashed = rows.withColumn("_hash", row_hash(keys, seed))
    return hashed.withColumn("_shard", F.substring("_hash", 1, 4))


def stratified_split(
    rows: DataFrame, target: str, keys: Sequence[str], test_size: float = TEST_SIZE, seed: int = SEED
) -> DataFrame:
    """A repeatable random split that keeps the share of each class."""
    return _cut(_hashed(rows, keys, seed), [target], ["_shard"], ["_hash", *keys], 1 - test_size).drop("_hash", "_shard")


def random_split(rows: DataFrame, keys: Sequence[str], test_size: float = TEST_SIZE, seed: int = SEED) -> DataFrame:
    """A repeatable random split without regard to classes."""
    return _cut(_hashed(rows, keys, seed), [], ["_shard"], ["_hash", *keys], 1 - test_size).drop("_hash", "_shard")


def cover_classes(split: DataFrame, target: str, keys: Sequence[str]) -> DataFrame:
    """Moves one validation row of each class that training lacks into training.

    The row is the one with the lowest keys. The classes are few, so the moved rows are broadcast.
    """
    waiting = F.when(F.col("part") == "val", F.struct(*keys))
    classes = split.groupBy(target).agg(F.count_if(F.col("part") == "train").alias("_train"), F.min(waiting).alias("_key"))
    chosen = classes.filter("_train = 0 and _key is not null").select("_key.*", F.lit(True).alias("_move"))
    moved = split.join(F.broadcast(chosen), list(keys), "left")
    part = F.when(F.col("_move"), "train").otherwise(F.col("part"))
    return moved.withColumn("part", part).drop("_move")


def last_days(rows: DataFrame, days: int, column: str = "date") -> DataFrame:
    """Rows of the newest date and the `days` before it."""
    newest = rows.select(F.max(column)).scalar()
    return rows.filter(F.col(column) >= F.date_sub(newest, days))


def feature_columns(rows: DataFrame, target: str, keys: Sequence[str] = ("listener_id", "session_id", "played_at")) -> list[str]:
    """All columns but the target, the date and the keys, in table order; `hour` is a feature."""
    return [c for c in rows.columns if c != target and c != "date" and c not in keys]


def filled(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Model features with 0 for a missing value and for a missing column."""
    present = {c: F.coalesce(nan_to_null(F.col(c).cast("double")), F.lit(0.0)) for c in columns if c in rows.columns}
    absent = {c: F.lit(0.0) for c in columns if c not in rows.columns}
    return rows.withColumns({**present, **absent})
