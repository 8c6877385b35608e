"""Toxicity by a weighted lexicon, matched with an Aho-Corasick automaton on folded text."""

import math
import re
import unicodedata
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moodstream.llm.hashing import pieces
from moodstream.llm.shared import stored, table, unused

#: A lexicon is learned from at most about so many labelled rows (chosen by a hash of doc_id), and has at most so many
#: terms and exception phrases.
TRAINING_ROWS = 40_000
TERMS = 2000
PHRASES = 1000
STEM = 4
THRESHOLD = 0.3
_LEAST_DOCS = 4
#: Look-alikes of letters, fixed values: digits and signs used for letters, then Cyrillic and Greek letters.
SUBSTITUTES = dict(zip("013457@$", "oieastas", strict=True))
HOMOGLYPHS = dict(zip("авекмнорстухіјѕԁοανιρτυχκ", "abekmhopctyxijsdoaviptuxk", strict=True))
_INVISIBLE = dict.fromkeys([0x00AD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF])
_LETTERS = str.maketrans(HOMOGLYPHS) | _INVISIBLE
_DIGITS = str.maketrans(SUBSTITUTES)
_TOKEN = re.compile(r"[^\W_]+(?:[@$]+[^\W_]+)*")
_HAS_LETTER = re.compile(r"[^\W\d_]")
_DISGUISED = re.compile(f"[{''.join(map(chr, _LETTERS))}]")


def folded(text: str | None) -> list[str]:
    """The words of a text with case, compatibility forms, look-alike letters and digits used as letters undone.

    Digits and signs stand for letters only in words that have a letter, and signs only inside of them.
    """
    plain = unicodedata.normalize("NFKC", text or "").lower()
    if not plain.isascii() and _DISGUISED.search(plain):
        plain = plain.translate(_LETTERS)
    # Most words are letters alone and have nothing to undo.
    return [t if t.isalpha() or not _HAS_LETTER.search(t) else t.translate(_DIGITS) for t in _TOKEN.findall(plain)]


@dataclass(frozen=True)
class Lexicon:
    """Weights of stems (matched where a word begins) and phrases that clear the stem in them, with the score's fit."""

    stems: dict[str, float]
    phrases: frozenset[str]
    fit: tuple[float, ...] = ()

    def automaton(self):
        import ahocorasick

        found = ahocorasick.Automaton()
        for stem in self.stems:
            found.add_word(f" {stem}", stem)
        if self.stems:
            found.make_automaton()
        return found


def _hits(automaton, lexicon: Lexicon, words: list[str]) -> list[tuple[str, int]]:
    """(stem, place of its word) of every hit outside exception phrases; the longest stem of a word counts."""
    if not lexicon.stems or not words:
        return []
    found = list(automaton.iter(" " + " ".join(words)))
    if not found:
        return []
    best = {}
    starts = {at: k for k, at in enumerate(accumulate((len(w) + 1 for w in words), initial=0))}
    for end, stem in found:
        k = starts[end - len(stem)]
        if len(stem) > len(best.get(k, "")):
            best[k] = stem
    return [(s, k) for k, s in best.items() if not any(p in lexicon.phrases for p in _around(words, k))]


def _around(words: list[str], k: int) -> list[str]:
    """The two-word phrases with word k."""
    pairs = (words[k - 1 : k + 1] if k else [], words[k : k + 2])
    return [" ".join(p) for p in pairs if len(p) == 2]


def _features(automaton, lexicon: Lexicon, words: list[str]) -> tuple[float, float]:
    """The weight of a text's hits on a log scale, and that weight per hundred words."""
    weight = sum(lexicon.stems[s] for s, _ in _hits(automaton, lexicon, words))
    return math.log1p(weight), math.log1p(100 * weight / max(len(words), 20))


def _training(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(text, toxic) of the training rows: labelled, not held out, at most about TRAINING_ROWS of them."""
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.where(~held_out(F.col("doc_id")))
    share = min(1.0, TRAINING_ROWS / max(1, known.count()))
    known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    chosen = F.broadcast(known)  # of TRAINING_ROWS rows, give or take the chance of a hash
    return stored(documents.select("doc_id", "text").join(chosen, "doc_id").select("text", "toxic"), "training")


def held_out(doc_id) -> object:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def _counted(rows: DataFrame, of_text) -> DataFrame:
    """(term, toxic, clean): in how many toxic and clean texts each term is, summed batch by batch before the shuffle."""

    def each(batches):
        for whole in batches:
            for batch in pieces(whole, "text"):
                counts: dict[str, list[int]] = {}
                for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                    for term in of_text(folded(text)):
                        counts.setdefault(term, [0, 0])[0 if toxic else 1] += 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(counts), pa.string()), pa.array([c[0] for c in counts.values()], pa.int64()), pa.array([c[1] for c in counts.values()], pa.int64())],
                    ["term", "toxic", "clean"],
                )

    got = rows.select("text", "toxic").mapInArrow(each, "term string, toxic long, clean long")
    return got.groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def _stems_of(words: list[str]) -> set[str]:
    """Words of letters, and their beginnings from STEM letters on."""
    return {w[:k] for w in set(words) if _HAS_LETTER.match(w) for k in {*range(STEM, min(len(w), STEM + 3)), len(w)}}


def learned(documents: DataFrame, labels: DataFrame) -> Lexicon:
    """A lexicon from the labelled rows that are not held out.

    Stems are words, or the first letters of words, that are common enough in toxic texts and rare in clean ones, weighed
    by log odds; a stem that a shorter chosen one begins is left out. Exceptions are two-word phrases around stems that
    clean texts have and toxic ones don't. A logistic curve over the weight of hits and their weight by length is fitted.
    """
    rows = _training(documents, labels)
    totals = rows.groupBy().agg(F.sum((F.col("toxic") == 1).cast("int")), F.count("*")).first()
    toxic, clean = int(totals[0] or 0), int((totals[1] or 0) - (totals[0] or 0))
    if not toxic or not clean:
        return Lexicon({}, frozenset(), (0.0, 0.0, math.log((toxic + 0.5) / (clean + 0.5))))
    least = max(_LEAST_DOCS, 0.015 * toxic)
    odds = F.log(((F.col("toxic") + 0.5) / (toxic + 1.0)) / ((F.col("clean") + 0.5) / (clean + 1.0)))
    terms = _counted(rows, _stems_of).where((F.col("toxic") >= least) & (F.col("toxic") >= 4 * F.col("clean")))
    terms = terms.withColumn("weight", odds).where("weight > 1").withColumn("rank", F.col("weight") * F.log1p("toxic"))
    found = {r.term: r.weight for r in terms.orderBy(F.desc("rank"), "term").limit(TERMS).collect()}
    stems = {s: w for s, w in found.items() if not any(s[:k] in found for k in range(STEM, len(s)))}
    lexicon = Lexicon(stems, frozenset())

    def contexts(words: list[str]) -> set[str]:
        return {p for _, k in _hits(automaton(lexicon), lexicon, words) for p in _around(words, k)}

    phrases = _counted(rows, contexts).where((F.col("clean") >= 3) & (F.col("toxic") == 0))
    lexicon = Lexicon(stems, frozenset(r.term for r in phrases.orderBy(F.desc("clean"), "term").limit(PHRASES).collect()))

    def measured(batches):
        for whole in batches:
            for batch in pieces(whole, "text"):
                built = automaton(lexicon)
                x = [_features(built, lexicon, folded(t)) for t in batch.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in x]), pa.array([b for _, b in x]), batch.column("toxic").cast(pa.int32())], ["a", "b", "y"])

    points = rows.select("text", "toxic").mapInArrow(measured, "a double, b double, y int")
    counts = points.groupBy(F.round("a", 2).alias("a"), F.round("b", 2).alias("b"), "y").agg(F.count("*").alias("n"))
    got = counts.toPandas()  # at most a row for each training row
    return Lexicon(lexicon.stems, lexicon.phrases, _logistic(got[["a", "b"]].to_numpy(), got["y"].to_numpy(), got["n"].to_numpy()))


def _logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray, ridge: float = 1.0) -> tuple[float, ...]:
    """Weights of a ridge logistic regression with a constant, by Newton's method."""
    design = np.column_stack([x, np.ones(len(x))])
    weights = np.zeros(design.shape[1])
    penalty = np.diag([ridge] * x.shape[1] + [1e-3])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(design @ weights, -30, 30)))
        slope = design.T @ (n * (y - p)) - penalty @ weights
        curve = (design * (n * p * (1 - p))[:, None]).T @ design + penalty
        step = np.linalg.solve(curve, slope)
        weights += step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(w) for w in weights)


_AUTOMATA: dict[int, tuple] = {}


def automaton(lexicon: Lexicon):
    """The lexicon's automaton, built once in each process."""
    key = hash((tuple(lexicon.stems), lexicon.phrases))
    if key not in _AUTOMATA:
        _AUTOMATA[key] = (lexicon.automaton(),)
    return _AUTOMATA[key][0]


def scored(documents: DataFrame, lexicon: Lexicon, into: str = "score") -> DataFrame:
    """`documents` (text, any others) with a score from 0 to 1, higher for texts likelier to be toxic.

    The score depends on the text only. Null, empty and wordless texts have no hit and get the score of such; texts are
    scored whole; repeated rows alike. An empty table gives no rows.
    """
    unused(documents, into)

    def each(texts: pd.Series) -> pd.Series:
        a, b, c = lexicon.fit
        built = automaton(lexicon)
        found = [_features(built, lexicon, folded(t)) for t in texts]
        return pd.Series([1 / (1 + math.exp(-max(-30.0, min(30.0, a * x + b * y + c)))) for x, y in found], dtype=float)

    return documents.withColumn(into, F.pandas_udf(each, "double")("text"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score and prediction of every document, by a lexicon that the held-out rows have no part in."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    lexicon = learned(documents, table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    found = scored(documents, lexicon)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


QUERIES = {"op3_toxicity": op3_toxicity}
SQL: dict[str, str] = {}
