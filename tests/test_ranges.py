import random

import pytest
from pyspark.sql import functions as F

from moodstream.operators import ranges


@pytest.mark.parametrize("parts", [1, 3, 17])
def test_running_sums(spark, parts):
    rng = random.Random(parts)
    rows = [(rng.choice(["a", "b", None]), k, rng.randrange(10)) for k in range(500)]
    rows += [("a", 1000 + k, 1) for k in range(400)]  # most rows in one group
    frame = spark.createDataFrame(rows, "g string, k int, n int")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        grouped = ranges.running(frame, [F.desc("k")], {"up": "n"}, ["g"]).collect()
        whole = ranges.running(frame, [F.asc("k"), F.desc("g")], {"up": "n", "k_up": "k"}).collect()
        used = ranges.in_ranges(frame, [F.asc("k")]).select("_range").distinct().count()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert used == parts
    assert sorted((r.g or "", r.k, r.up) for r in grouped) == sorted(
        (g or "", k, sum(n for h, j, n in rows if h == g and j >= k)) for g, k, _ in rows
    )
    assert sorted((r.k, r.up, r.k_up) for r in whole) == sorted(
        (k, sum(n for _, j, n in rows if j <= k), sum(j for _, j, _ in rows if j <= k)) for _, k, _ in rows
    )


def test_empty(spark):
    assert ranges.running(spark.createDataFrame([], "k int, n int"), [F.asc("k")], {"up": "n"}).count() == 0
