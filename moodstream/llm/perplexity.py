"""Quality by the perplexity of an interpolated modified Kneser-Ney character model of trusted text."""

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moodstream.llm.hashing import MAP_BITS, bitmap, in_map, pieces
from moodstream.llm.shared import stored, table, unused, with_field

ORDER = 4
#: Perplexity above which a text is dropped: this quantile of its language's trusted texts.
QUANTILE = 0.995
MIN_TRUSTED = 30
#: A model of more grams than this is joined to the texts' grams instead of being sent to every executor.
MODEL_GRAMS = 2_000_000
#: Counts are merged in a task whenever so many characters have been taken in.
_PENDING = 4 << 20
_PAD = "\0"
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_SALTS = [np.uint64(0x2545F4914F6CDD1D * (2 * k + 1) % (1 << 64)) for k in range(ORDER + 1)]


def _points(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all texts, ORDER - 1 pads before each; which places are characters; the text of each place."""
    joined = "".join(_PAD * (ORDER - 1) + t for t in texts)
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.fromiter((len(t) + ORDER - 1 for t in texts), np.int64, len(texts))
    owner = np.repeat(np.arange(len(texts)), sizes)
    place = np.arange(len(points)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return points, place >= ORDER - 1, owner


def _hashes(points: np.ndarray, k: int) -> np.ndarray:
    """A hash of the k characters that end at each place (0 for the first k - 1 places)."""
    wide = points.astype(np.uint64)
    out = np.full(max(0, len(points) - k + 1), _SALTS[k], np.uint64)
    for j in range(k):
        out = (out ^ wide[j : len(points) - k + 1 + j]) * _MULTIPLIER
        out ^= out >> np.uint64(29)
    return np.concatenate([np.zeros(min(k - 1, len(points)), np.uint64), out])


def gram_counts(trusted: DataFrame) -> DataFrame:
    """(gram, n): every ORDER characters in a row of the trusted texts (padded at their start), counted.

    Each task sums its own counts first, so what is shuffled is different grams per task.
    """

    def each(batches):
        held: pd.Series | None = None
        for whole in batches:
            for batch in pieces(whole, "text", _PENDING):
                points, real, _ = _points([t or "" for t in batch.column("text").to_pylist()])
                at = np.flatnonzero(real)
                if not len(at):
                    continue
                grid = np.stack([points[at - k] for k in range(ORDER - 1, -1, -1)], axis=1)
                packed = _hashes(points, ORDER)[at]
                _, first, n = np.unique(packed, return_index=True, return_counts=True)
                raw = np.ascontiguousarray(grid[first]).tobytes().decode("utf-32-le", "surrogatepass")
                found = pd.Series(n, index=[raw[i : i + ORDER] for i in range(0, len(raw), ORDER)])
                held = found if held is None else held.add(found, fill_value=0)
                if len(held) > 1_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(held.index), pa.array(held.astype(np.int64))], ["gram", "n"])
                    held = None
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array(held.index, pa.string()), pa.array(held.astype(np.int64))], ["gram", "n"])

    return trusted.select("text").mapInArrow(each, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def _discounts(grams: DataFrame) -> tuple[float, float, float]:
    """The three discounts of modified Kneser-Ney, from how many grams have counts of one to four."""
    of = grams.groupBy().agg(*[F.sum((F.col("n") == k).cast("long")) for k in (1, 2, 3, 4)]).first()
    n1, n2, n3, n4 = (float(x or 0) for x in of)
    y = n1 / (n1 + 2 * n2) if n1 + n2 else 0.5
    usual = (0.5, 1.0, 1.5)
    raw = [k - (k + 1) * y * b / a if a and b else d for k, a, b, d in zip((1, 2, 3), (n1, n2, n3), (n2, n3, n4), usual, strict=True)]
    return tuple(min(float(k), max(0.0, d)) for k, d in zip((1, 2, 3), raw, strict=True))


def trained(trusted: DataFrame) -> DataFrame:
    """(gram, p, left) of the model: for each gram of 1 to ORDER characters that the trusted texts have, its interpolated
    probability after its beginning (p), and, for what may stand before a character, the share left to shorter ones.

    Counts of the longest grams are their own; a shorter gram counts the different characters before it. Each order is a
    join of counts, totals of their beginnings and the next shorter order, all dealt out by gram. The row with the empty
    gram holds the share of characters never seen (left), spread over the alphabet and one more.
    """
    counts = [stored(gram_counts(trusted), "grams")]
    for k in range(ORDER - 1, 0, -1):
        counts.append(stored(counts[-1].groupBy(F.substring("gram", 2, k).alias("gram")).agg(F.count("*").alias("n")), f"grams-{k}"))
    model, shorter = None, None
    for k, grams in zip(range(1, ORDER + 1), reversed(counts), strict=True):
        d1, d2, d3 = _discounts(grams)
        cut = F.when(F.col("n") == 1, d1).when(F.col("n") == 2, d2).otherwise(d3)
        marked = grams.select("gram", "n", F.substring("gram", 1, k - 1).alias("start"), cut.alias("cut"))
        starts = marked.groupBy("start").agg(F.sum("n").alias("total"), (F.sum("cut") / F.sum("n")).alias("left"))
        rows = marked.join(starts, "start")
        own = F.greatest(F.lit(0.0), F.col("n") - F.col("cut")) / F.col("total")
        if k == 1:
            alphabet = F.lit(float(grams.count() + 1))
            now = rows.select("gram", (own + F.col("left") / alphabet).alias("p"))
            first = starts.select("start", (F.col("left") / alphabet).alias("left"))
            lefts = first
        else:
            lower = shorter.select(F.col("gram").alias("end"), F.col("p").alias("q"))
            rows = rows.withColumn("end", F.substring("gram", 2, k - 1)).join(lower, "end")
            now = rows.select("gram", (own + F.col("left") * F.col("q")).alias("p"))
            lefts = starts.select("start", "left")
        shorter = stored(now, f"probabilities-{k}")
        part = shorter.select("gram", "p", F.lit(None).cast("double").alias("left"))
        part = part.union(lefts.select("start", F.lit(None).cast("double"), "left"))
        model = part if model is None else model.union(part)
    return stored(model.groupBy("gram").agg(F.max("p").alias("p"), F.max("left").alias("left")), "model")


class _Model:
    """The model as sorted hashes with values, for looking up many grams at once."""

    def __init__(self, rows: pd.DataFrame):
        self.p, self.left = [], []
        self.unseen = float(rows.loc[rows["gram"] == "", "left"].iloc[0]) if (rows["gram"] == "").any() else 1.0
        size = rows["gram"].str.len().to_numpy() if len(rows) else np.zeros(0, int)
        for k in range(1, ORDER + 1):
            part = rows[size == k]
            points = np.frombuffer("".join(part["gram"]).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(-1, k)
            keys = _hashes(points.reshape(-1), k)[k - 1 :: k] if len(part) else np.zeros(0, np.uint64)
            for values, into in ((part["p"], self.p), (part["left"], self.left)):
                given = values.notna().to_numpy()
                into.append(self._table(keys[given], np.log(np.maximum(values.to_numpy(float)[given], 1e-300))))

    @staticmethod
    def _table(keys: np.ndarray, values: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
        """Two-choice buckets: sorted by upper bits, with a start for each bucket."""
        order = np.argsort(keys)
        keys, values = keys[order], values[order]
        bits = max(4, int(2 * len(keys) + 1).bit_length())
        starts = np.searchsorted(keys >> np.uint64(64 - bits), np.arange((1 << bits) + 1, dtype=np.uint64))
        depth = int(np.diff(starts).max()) if len(keys) else 0
        return bits, depth, starts.astype(np.int32), np.append(keys, np.uint64(0)), np.append(values, 0.0)

    @staticmethod
    def _find(table, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        bits, depth, starts, keys, values = table
        at = starts[(hashes >> np.uint64(64 - bits)).astype(np.int64)].astype(np.int64)
        found = np.zeros(len(hashes), bool)
        out = np.zeros(len(hashes))
        for _ in range(depth):
            hit = (keys[at] == hashes) & ~found & (at < len(keys) - 1)
            out[hit] = values[at[hit]]
            found |= hit
            at = np.minimum(at + 1, len(keys) - 1)
        return found, out

    def scores(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Sum of log probabilities and number of characters of each text."""
        points, real, owner = _points(texts)
        at = np.flatnonzero(real)
        total = np.zeros(len(at))
        open_ = np.arange(len(at))
        for k in range(ORDER, 0, -1):
            if not len(open_):
                break
            found, logs = self._find(self.p[k - 1], _hashes(points, k)[at[open_]])
            total[open_[found]] += logs[found]
            open_ = open_[~found]
            if k > 1 and len(open_):
                before, logs = self._find(self.left[k - 2], _hashes(points, k - 1)[at[open_] - 1])
                total[open_[before]] += logs[before]
        total[open_] += np.log(max(self.unseen, 1e-300))
        return np.bincount(owner[at], total, len(texts)), np.bincount(owner[at], minlength=len(texts))


def _scored_by_broadcast(documents: DataFrame, model: DataFrame, into: str) -> DataFrame:
    sent = documents.sparkSession.sparkContext.broadcast(model.toPandas())
    made: list[_Model] = []

    def each(batches):
        if not made:
            made.append(_Model(sent.value))
        for whole in batches:
            for batch in pieces(whole, "text", 1 << 20):
                logs, n = made[0].scores([t or "" for t in batch.column("text").to_pylist()])
                out = pa.array(np.exp(-logs / np.maximum(n, 1)), mask=n == 0)
                yield pa.RecordBatch.from_arrays([*batch.columns, out], [*batch.schema.names, into])

    return documents.mapInArrow(each, with_field(documents, into, "double"))


def _text_grams(texts: DataFrame) -> DataFrame:
    """(a, b, gram, n): the different ORDER characters that end in each text of `texts` (a, b, text), counted; one pass over it."""

    def each(batches):
        for whole in batches:
            for batch in pieces(whole, "text", 1 << 20):
                points, real, owner = _points(batch.column("text").to_pylist())
                at = np.flatnonzero(real)
                if not len(at):
                    continue
                packed, owner = _hashes(points, ORDER)[at], owner[at]
                order = np.lexsort((packed, owner))
                new = np.append(True, (np.diff(packed[order]) != 0) | (np.diff(owner[order]) != 0))
                first = order[new]
                n = np.diff(np.append(np.flatnonzero(new), len(order)))
                grid = np.stack([points[at[first] - k] for k in range(ORDER - 1, -1, -1)], axis=1)
                raw = np.ascontiguousarray(grid).tobytes().decode("utf-32-le", "surrogatepass")
                grams = pa.array([raw[i : i + ORDER] for i in range(0, len(raw), ORDER)], pa.string())
                ids = [batch.column(c).take(pa.array(owner[first])) for c in ("a", "b")]
                yield pa.RecordBatch.from_arrays([*ids, grams, pa.array(n, pa.int64())], ["a", "b", "gram", "n"])

    return texts.select("a", "b", "text").mapInArrow(each, "a long, b long, gram string, n long")


def _gram_logs(grams: DataFrame, model: DataFrame) -> DataFrame:
    """(gram, log): the log probability of the last character of each of `grams` (gram, all different), one join an order."""
    rows = grams.select("gram", F.lit(0.0).alias("log"), F.lit(False).alias("done"))
    probabilities = model.where("p is not null").select(F.col("gram").alias("m"), F.log("p").alias("lp"))
    lefts = model.where("left is not null").select(F.col("gram").alias("m"), F.log("left").alias("ll"))
    for k in range(ORDER, 0, -1):
        rows = rows.withColumn("e", F.substring("gram", ORDER - k + 1, k)).join(probabilities, F.col("e") == F.col("m"), "left").drop("m", "e")
        rows = rows.withColumn("e", F.substring("gram", ORDER - k + 1, k - 1)).join(lefts, F.col("e") == F.col("m"), "left").drop("m", "e")
        add = F.coalesce("lp", "ll", F.lit(0.0))
        rows = rows.select("gram", F.when(F.col("done"), F.col("log")).otherwise(F.col("log") + add).alias("log"), (F.col("done") | F.col("lp").isNotNull()).alias("done"))
    return rows.select("gram", "log")


def _scored_by_join(documents: DataFrame, model: DataFrame, into: str) -> DataFrame:
    """For models of any size: different grams of all texts meet the model order by order; then each text's grams, with
    counts, meet their logs. Linear in the texts. Texts are told apart by 128 bits of hash."""
    keyed = documents.withColumn("__a", F.xxhash64("text")).withColumn("__b", F.xxhash64(F.lit(1), "text"))
    texts = keyed.where(F.length("text") > 0).select(F.col("__a").alias("a"), F.col("__b").alias("b"), "text")
    # Repeated texts are counted once for each copy: the mean is the same.
    grams = stored(_text_grams(texts), "text-grams")
    logs = stored(_gram_logs(grams.select("gram").distinct(), model), "gram-logs")
    mean = (F.exp(-F.sum(F.col("log") * F.col("n")) / F.sum("n"))).alias("__found")
    found = grams.join(logs, "gram").groupBy(F.col("a").alias("__key_a"), F.col("b").alias("__key_b")).agg(mean)
    same = (F.col("__a") == F.col("__key_a")) & (F.col("__b") == F.col("__key_b"))
    return keyed.join(found, same, "left").select(*[keyed[c] for c in documents.columns], F.col("__found").alias(into))


def scored(documents: DataFrame, model: DataFrame, into: str = "perplexity") -> DataFrame:
    """`documents` (text, any others) with the perplexity per character of each whole text; null for null and empty ones."""
    unused(documents, into)
    if model.count() <= MODEL_GRAMS:
        return _scored_by_broadcast(documents, model, into)
    return _scored_by_join(documents, model, into)


def _maps(good: DataFrame, documents: DataFrame, bits: int) -> list[np.ndarray] | None:
    """Maps of fixed size that together tell the ids of `good` from all others of `documents`, without an error.

    The first holds the good ids, the second the others that the first lets through, the third the good ones that the
    second lets through, and so on until nothing is let through. None if a map is over half full: then they do not pay.
    """
    maps: list[np.ndarray] = []
    inside, outside = good, documents
    while True:
        level = F.lit(len(maps))
        maps.append(bitmap(inside.select(F.xxhash64("doc_id", level).alias("h")), "h", bits))
        if 2 * int(np.bitwise_count(maps[-1]).sum()) > 1 << bits:
            return None
        sent = documents.sparkSession.sparkContext.broadcast(maps[-1])

        def each(batches, sent=sent):
            for batch in batches:
                hashes = batch.column("h").to_numpy(zero_copy_only=False).view(np.uint64)
                yield batch.select(["doc_id"]).filter(pa.array(in_map(sent.value, hashes)))

        passed = outside.select("doc_id", F.xxhash64("doc_id", level).alias("h")).mapInArrow(each, "doc_id long")
        if len(maps) == 1:
            passed = passed.join(good, "doc_id", "left_anti").distinct()
        passed = stored(passed, f"let-through-{len(maps)}")
        if passed.isEmpty():
            return maps
        inside, outside = passed, inside


def trusted_texts(documents: DataFrame, labels: DataFrame, bits: int = MAP_BITS) -> DataFrame:
    """(doc_id, lang, text) of documents that some row of `labels` (doc_id, quality) calls good.

    Only ids are shuffled: texts are picked where they are read, by maps of 2^bits bits that make no error on these
    ids. With more good ids than such maps can hold, texts are joined to the ids, and stored as that moves them.
    """
    good = labels.where("quality = 1 and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    good = stored(good, "good")
    source = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "text").where("doc_id is not null")
    maps = _maps(good, source.select("doc_id"), bits)
    if maps is None:
        return stored(source.join(good, "doc_id", "left_semi"), "trusted")
    sent = documents.sparkSession.sparkContext.broadcast(maps)

    def each(batches):
        for batch in batches:
            open_ = np.ones(batch.num_rows, bool)
            passed = np.zeros(batch.num_rows, np.int64)
            for level, found in enumerate(sent.value):
                open_ &= in_map(found, batch.column(f"h{level}").to_numpy(zero_copy_only=False).view(np.uint64))
                passed += open_
            yield batch.select(["doc_id", "lang", "text"]).filter(pa.array(passed % 2 == 1))

    hashes = [F.xxhash64("doc_id", F.lit(level)).alias(f"h{level}") for level in range(len(maps))]
    return source.select("*", *hashes).mapInArrow(each, source.schema)


def judged(documents: DataFrame, labels: DataFrame, into: str = "language_model") -> DataFrame:
    """`documents` (doc_id, lang, text, any others) with a struct `into` of perplexity, threshold and kept.

    The model is trained on all documents that labels call good. A document is kept if its perplexity is not above the
    QUANTILE of the good documents of its language (null is a language); a language with under MIN_TRUSTED good documents
    takes the quantile over all. Null and empty texts have no perplexity and are not kept; without any good document all
    others are kept. Repeated rows are judged alike.
    """
    unused(documents, into)
    trusted = trusted_texts(documents, labels)
    model = trained(trusted)
    rated = stored(scored(trusted, model, "perplexity").select("lang", "perplexity"), "trusted-perplexity").where("perplexity is not null")
    limits = rated.groupBy("lang").agg(F.percentile_approx("perplexity", QUANTILE, 10_000).alias("limit"), F.count("*").alias("n"))
    limits = limits.where(F.col("n") >= MIN_TRUSTED).select(F.col("lang").alias("__lang"), F.col("limit").alias("__limit"))
    general = rated.agg(F.percentile_approx("perplexity", QUANTILE, 10_000)).first()[0]
    out = scored(documents, model, "__perplexity")
    out = out.join(limits, F.col("lang").eqNullSafe(F.col("__lang")), "left")
    limit = F.coalesce("__limit", F.lit(general).cast("double"), F.lit(float("inf")))
    kept = F.coalesce(F.col("__perplexity") <= limit, F.lit(False))
    struct = F.struct(F.col("__perplexity").alias("perplexity"), limit.alias("threshold"), kept.alias("kept"))
    return out.select(*documents.columns, struct.alias(into))


def op10_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Perplexity of every document, its language's threshold and the verdict."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    found = judged(documents, table(spark, sf_dir, "labels").select("doc_id", "quality"))
    return found.select("doc_id", "lang", "language_model.*")


QUERIES = {"op10_kneser_ney": op10_kneser_ney}
SQL: dict[str, str] = {}
