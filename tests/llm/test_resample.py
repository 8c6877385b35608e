"""Importance resampling against plain sums."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np

from moodstream.llm import resample

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SMALL = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_features(text):
    words = WORD.findall((text or "").translate(SMALL))
    runs = [" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]
    return len(words), collections.Counter(zlib.crc32(r.encode()) % 10000 for r in runs)


def plain(docs, items):
    counts = [(i, *plain_features(t)) for i, t in docs]
    s = sum((c for _, _, c in counts), collections.Counter())
    t = sum((plain_features(x)[1] for _, x in items), collections.Counter())
    big_s, big_t = s.total(), t.total()
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (big_s + 10000) / ((s[b] + 1) * (big_t + 10000)))) for b in s}
    rows = []
    for i, n, c in counts:
        weight = sum(k * gain[b] for b, k in c.items())
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, n, c.total(), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))))
    able = sorted((r for r in rows if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    drawn = able[: len(able) * 5 // 100]
    # Rows equal in all respects take ranks in any order.
    return sorted(map(repr, rows)), [(r[0], r[4], k) for k, r in enumerate(drawn, 1)]


def found(spark, docs, items):
    left = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as score", "'x' as rank", "3 as weight", "doc_id as row")
    right = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "'x' as bucket", "2 as n")
    rows = resample.resampled(left.repartition(3), right).collect()
    every = sorted(repr((r.doc_id, r.n_words, r.n_features, r.weight, r.score)) for r in rows)
    return every, sorted(((r.doc_id, r.score, r["rank"]) for r in rows if r["rank"]), key=lambda r: r[2])


def test_against_plain(spark):
    rng = random.Random(5)
    names = [f"w{k}" for k in range(50)] + ["É", "ß" * 40, "x" * 47, "y" * 48, "z" * 49, "q" * 300]
    docs = [(k, " ".join(rng.choices(names, k=rng.randrange(1, 60)))) for k in range(300)]
    docs += [(7, docs[7][1]), (None, docs[8][1]), (1000, None), (1001, ""), (1002, "-- ."), (1003, "A " * 700), (1004, docs[9][1])]
    docs += [(2000 + k, docs[20][1] + " " + docs[21][1]) for k in range(40)]
    docs.append((3000, " ".join(rng.choices(names, k=30_000))))
    docs += [(4000, " ".join(names))] * 30
    items = [(k, " ".join(rng.choices(names[:20], k=12))) for k in range(10)] + [(3, None), (3, "W1 w2"), (3, "W1 w2")]
    assert found(spark, docs, items) == plain(docs, items)


def test_empty(spark):
    assert found(spark, [], [(1, "a")]) == ([], [])
    docs = [(k, "a b " * 10) for k in range(40)]
    assert found(spark, docs, []) == plain(docs, [])


def test_planes_sum_exactly():
    rng = np.random.default_rng(1)
    gain = rng.integers(-20_000, 20_000, 10_000)
    text = np.sort(rng.integers(0, 30, 50_000))
    bucket = np.where(rng.random(50_000) < 0.3, 77, rng.integers(0, 10_000, 50_000))
    want = np.zeros(31, np.int64)
    np.add.at(want, text, gain[bucket])
    assert resample.weights(text, bucket, 31, resample.gain_planes(gain)).tolist() == want.tolist()
    assert resample.weights(text[:0], bucket[:0], 2, resample.gain_planes(gain * 0)).tolist() == [0, 0]
