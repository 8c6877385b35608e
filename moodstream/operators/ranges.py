"""Running sums along an order of a whole table, which no task ever sees whole.

Rows are dealt out by ranges of the order and stored, so that every later step sees the same ranges. A running sum is
then the sum inside the range plus the total of the ranges before it, of which there is one row per range and group.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from moodstream.session import fresh_dir


def in_ranges(rows: DataFrame, order: Sequence[Column], by: Sequence[str] = ()) -> DataFrame:
    """The rows with `_range`, which rises along `by` and `order`; rows equal in all of these share a range.

    There are as many ranges as the session has shuffle partitions, or fewer where run-time sizing merges small ones.
    """
    path = fresh_dir(rows.sparkSession, "ranges")
    ranged = rows.repartitionByRange(*[F.col(c) for c in by], *order).withColumn("_range", F.spark_partition_id())
    ranged.write.parquet(path)
    return rows.sparkSession.read.schema(ranged.schema).parquet(path)


def running(rows: DataFrame, order: Sequence[Column], sums: dict[str, str], by: Sequence[str] = ()) -> DataFrame:
    """Adds the columns named in `sums`: of the column each maps to, the sum over the group's rows up to each row.

    Rows alike in `order` stand in any order among themselves. Nulls in `by` are a group; an empty table stays empty.
    """
    placed = in_ranges(rows, order, by)
    inside = Window.partitionBy(*by, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = placed.withColumns({name: F.sum(column).over(inside) for name, column in sums.items()})
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    earlier = group.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = placed.groupBy(*by, "_range").agg(*[F.sum(column).alias(name) for name, column in sums.items()])
    before = totals.select(
        *[F.col(c).alias(f"_by_{c}") for c in by],
        F.col("_range").alias("_of"),
        *[F.coalesce(F.sum(name).over(earlier), F.lit(0)).alias(f"_before_{name}") for name in sums],
    )
    same = F.col("_range") == F.col("_of")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    # The rows may be small as files and yet too many to be broadcast; these totals are a row per range and group.
    joined = local.join(F.broadcast(before), same)
    return joined.select(*rows.columns, *[(F.col(n) + F.col(f"_before_{n}")).alias(n) for n in sums])
