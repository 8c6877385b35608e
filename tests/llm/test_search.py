"""Ranked lexical search against a plain scorer."""

import collections
import math
import random
import re

import pytest

from moodstream.llm import search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
SMALL = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(SMALL))


def plain(docs, items, top):
    counts = [(i, collections.Counter(terms(t))) for i, t in docs]
    sizes = [sum(c.values()) for _, c in counts]
    n_docs, n_terms = sum(n > 0 for n in sizes), sum(sizes)
    df = collections.Counter(t for _, c in counts for t in c)
    asked = collections.defaultdict(collections.Counter)
    for item, text in set(items):
        asked[item].update(terms(text))
    out = []
    for item, want in asked.items():
        scored = []
        for (doc, c), n in zip(counts, sizes, strict=True):
            score = 0
            for term, times in want.items():
                if c[term]:
                    weight = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[term] + 1)))
                    m = 25 + (75 * n * n_docs) // n_terms
                    score += times * weight * ((1_000_000_000 * c[term]) // (1000 * c[term] + 8 * m))
            if score > 0:
                scored.append((-score, doc is None, doc or 0, doc))
        for rank, (score, _, _, doc) in enumerate(sorted(scored)[:top], 1):
            out.append((str(item), rank, doc, -score))
    return sorted(out, key=repr)


def found(spark, docs, items, top=10):
    left = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as score", "'x' as rank", "doc_id as block", "'y' as slot")
    right = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 as term", "'x' as bundle")
    rows = search.ranked(left.repartition(3), right, top).collect()
    return sorted(((str(r.item_id), r.rank, r.doc_id, r.score) for r in rows), key=repr)


@pytest.mark.parametrize("bundle", [256, 3])
def test_against_plain(spark, monkeypatch, bundle):
    monkeypatch.setattr(search, "BUNDLE", bundle)
    rng = random.Random(bundle)
    names = [f"w{k}" for k in range(60)] + ["the"]
    weights = [1 / (k + 1) for k in range(60)] + [3]
    docs = [(k, " ".join(rng.choices(names, weights, k=rng.randrange(1, 40)))) for k in range(300)]
    docs += [(1000 + k, docs[7][1]) for k in range(40)]  # copies tie
    docs += [(7, docs[7][1]), (7, docs[7][1]), (None, "The W1 w1 only"), (2000, None), (2001, ""), (2002, " -- "), (2003, "ŁÓDŹ łódź the")]
    docs.append((2004, " ".join(rng.choices(names, weights, k=20_000))))
    items = [(k, " ".join(rng.choices(names, k=8))) for k in range(10)]
    items += [(20, "the the THE w1"), (21, None), (22, "absent"), (23, "ŁÓDŹ"), (24, "w3 w4"), (24, "w3 w4"), (24, "w5"), (None, "w9 the")]
    assert found(spark, docs, items) == plain(docs, items, 10)
    assert found(spark, docs, items, 3) == plain(docs, items, 3)


def test_empty(spark):
    assert found(spark, [], [(1, "a")]) == found(spark, [(1, "a")], []) == found(spark, [], []) == []
    assert found(spark, [(1, None)], [(1, "a")]) == []
