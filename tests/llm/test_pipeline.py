"""Each stage of the pipeline against plain Python on small tables."""

import collections
import random
import re

import numpy as np
import pytest
import xxhash

import corpus_pipeline
from moodstream.llm import simhash

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SMALL = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def frame(spark, texts):
    return spark.createDataFrame([(k, t, "en", "ab"[k % 2], len(t or "")) for k, t in enumerate(texts)], DOCS)


def fingerprint(text):
    """Bit by bit, as the definition says."""
    words = WORD.findall((text or "").translate(SMALL))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(4)
    out = [None, "", " \t", "One two", "one TWO", "Ünter ÜNTER unter x", "a b a b a b a b"]
    for _ in range(40):
        base = [f"w{rng.randrange(300)}" for _ in range(rng.choice([2, 9, 80, 400]))]
        for changes in (0, 0, 1, 3):
            near = list(base)
            for _ in range(changes):
                near[rng.randrange(len(near))] = f"x{rng.randrange(9)}"
            out.append(" ".join(near))
    return out


def test_fingerprints(spark, texts):
    docs = frame(spark, texts)
    got = {r.doc_id: r.fingerprint for r in docs.select("doc_id", simhash.fingerprints(docs.text, 3).alias("fingerprint")).collect()}
    assert [int(np.int64(got[k]).view(np.uint64)) for k in range(len(texts))] == [fingerprint(t) for t in texts]


def test_near_dedup(spark, texts):
    prints = [fingerprint(t) for t in texts]
    top = list(range(len(texts)))

    def find(k):
        while top[k] != k:
            k = top[k]
        return k

    for i in range(len(texts)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                a, b = sorted((find(i), find(j)))
                top[b] = a
    out = corpus_pipeline.near_dedup(spark, frame(spark, texts), SF)
    assert sorted(r.doc_id for r in out.collect()) == [k for k in range(len(texts)) if find(k) == k]


def test_line_dedup(spark):
    long = "one two three four five six seven eight nine"
    texts = [f"{long}\nshort line\n\nshort line", "short line\nown words here", long, f"{long} ten\nother", long.replace("four", "4") + "\nshort  line", None, ""]
    out = {r.doc_id: r for r in corpus_pipeline.line_dedup(spark, frame(spark, texts), SF).collect()}
    want = {0: f"{long}\nshort line\n", 1: "own words here", 3: "other", 5: None, 6: ""}
    assert {k: r.text for k, r in out.items()} == want
    assert {k: r.n_chars for k, r in out.items()} == {k: len(t or "") for k, t in want.items()}


def test_decontamination(spark):
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").limit(2).collect()]
    texts = [items[0], f"{' '.join(['plain'] * 400)} {' '.join(items[0].split()[:13])}", "nothing of it", None, f"so {items[1]} then"]
    out = corpus_pipeline.decontamination(spark, frame(spark, texts), SF)
    assert sorted(r.doc_id for r in out.collect()) == [1, 2, 3]


def test_quality_rules(spark):
    good = spark.read.parquet(f"{SF}/documents.parquet")
    bad = frame(spark, [None, "", "too few words", "five words over and over " * 30])
    rows = corpus_pipeline.quality_rules(spark, good.unionByName(bad.selectExpr("doc_id + 100000 as doc_id", *bad.columns[1:])), SF)
    kept = {r.doc_id for r in rows.collect()}
    assert not any(k >= 100000 for k in kept)
    for r in good.collect():
        found = WORD.findall(r.text or "")
        windows = [tuple(found[i : i + 5]) for i in range(len(found) - 4)]
        count = collections.Counter(windows)
        covered = {k for i, w in enumerate(windows) if count[w] > 1 for k in range(i, i + 5)}
        if len(found) < 10 or 100 * len(covered) > 20 * len(found):
            assert r.doc_id not in kept


def test_mixing(spark):
    rng = random.Random(2)
    texts = ["w " * rng.randrange(0, 40) for _ in range(600)]
    docs = frame(spark, texts)
    rows = corpus_pipeline.mixing(spark, docs, SF).collect()
    assert all(r.size == len(WORD.findall(texts[r.doc_id])) and 1 <= r.copies <= 3 and r.taken == r.size * r.copies for r in rows)
    total = sum(len(WORD.findall(t)) for t in texts)
    for source, weight in (("a", 1), ("b", 2)):
        assert sum(r.taken for r in rows if r.source == source) == pytest.approx(total * weight / 3, abs=40)


def test_extra_columns_stay(spark):
    docs = frame(spark, ["some words of one text in a line of its own here", "other words"]).selectExpr("*", "1 as n_lines", "2 as k", "3 as key")
    for _, stage in corpus_pipeline.STAGES[1:4]:
        assert stage(spark, docs, SF).columns == docs.columns


def test_quality_verdicts_are_worked_out_once(spark):
    """A filter on the verdict must not carry the steps that make the verdict, which it would repeat without end."""
    rows = corpus_pipeline.quality_rules(spark, spark.read.parquet(f"{SF}/documents.parquet"), SF)
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "kept" in plan and "xxhash64" not in plan and "regexp_replace" not in plan
