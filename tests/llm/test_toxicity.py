"""Hits, phrases and scores of the toxicity lexicon against a plain matcher."""

import math
import random

import pytest

from moodstream.llm import toxicity


def plain_score(lexicon, text):
    words = toxicity.folded(text)
    weight = 0.0
    for k, word in enumerate(words):
        stems = [s for s in lexicon.stems if word.startswith(s)]
        pairs = [" ".join(words[j : j + 2]) for j in (k - 1, k) if 0 <= j < len(words) - 1]
        if stems and not any(p in lexicon.phrases for p in pairs):
            weight += lexicon.stems[max(stems, key=len)]
    a, b, c = lexicon.fit
    x, y = math.log1p(weight), math.log1p(100 * weight / max(len(words), 20))
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, a * x + b * y + c))))


def test_scores_against_a_plain_matcher(spark):
    rng = random.Random(8)
    words = ["idio", "idiot", "idiots", "fool", "foolish", "food", "sly", "you", "the", "1d10t", "F00L", "іdiot", "id", "a-idiot"]
    lexicon = toxicity.Lexicon({"idio": 1.5, "idiots": 2.0, "fool": 0.7, "sly": 3.0}, frozenset(["you fool", "idiot the"]), (1.1, 0.6, -2.0))
    texts = [" ".join(rng.choices(words, k=rng.randrange(1, 30))) for _ in range(300)] + [None, "", " . ", "idiot " * 30_000, "fool", "fool"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "1 as kept", "'x' as weight")
    rows = toxicity.scored(frame, lexicon).collect()
    assert len(rows) == len(texts) and {r.weight for r in rows} == {"x"}
    for r in rows:
        assert r.score == pytest.approx(plain_score(lexicon, texts[r.doc_id]))
    assert toxicity.scored(frame.limit(0), lexicon).count() == 0
    with pytest.raises(ValueError):
        toxicity.scored(frame, lexicon, "kept")
