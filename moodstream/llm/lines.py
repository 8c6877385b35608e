"""Line dedup: equal lines, and lines one word apart, by a join of deletion neighbourhoods."""

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from moodstream.llm.hashing import Tokens, _powers, bitmap, in_map, mix, pieces
from moodstream.llm.shared import bound, stored, table, unused

MIN_WORDS = 8
#: Bytes of text that a task hashes at once, which bounds the memory of its tables of powers and sums.
PIECE = 1 << 20
#: Bytes inside words; 0 for what stands between them. The zero byte stands as a blank, which no word holds.
KINDS = np.arange(256).astype(np.uint8)
KINDS[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = 0
KINDS[0] = 0x20
_SALT = np.uint64(0xD6E8FEB86659FD93)


class _Runs:
    """Hashes of any run of a batch's words, whatever stands before it."""

    def __init__(self, hashes: np.ndarray):
        self.power, self.inverse = _powers(len(hashes) + 1)
        self.sums = np.zeros(len(hashes) + 1, np.uint64)
        np.cumsum(hashes * self.power[: len(hashes)], dtype=np.uint64, out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.inverse[start]

    def without(self, start: int, end: int) -> np.ndarray:
        """The hash of words start..end with one left out, for each of them."""
        at = np.arange(start, end)
        head = (self.sums[at] - self.sums[start]) * self.inverse[start]
        tail = (self.sums[end] - self.sums[at + 1]) * self.inverse[start + 1]
        return head + tail


def _lines_of(batch: pa.RecordBatch) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The lines of a batch's texts, the row of each, and its number in the text."""
    split = pc.split_pattern(pc.fill_null(batch.column("text"), ""), "\n")
    counts = pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.arange(len(counts)), counts)
    number = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
    return split.flatten(), row, number


def _keys(tokens: Tokens) -> tuple[np.ndarray, np.ndarray]:
    start, end = tokens.firsts[:-1], tokens.firsts[1:]
    one = mix(_Runs(tokens.hashes).of(start, end))
    other = mix(_Runs(mix(tokens.hashes ^ _SALT)).of(start, end))
    return one.view(np.int64), other.view(np.int64)


def _hashed(documents: DataFrame) -> DataFrame:
    """A row per line that has a word: two hashes of its words, and hashes of the halves that a near line would share.

    Two lines of t and t or t - 1 words that are one word apart agree in their first (t - 1) / 2 words or in as many last
    ones as then remain of t - 1. So each line gives both halves for t = its words and for one more.
    """
    kinds = ["doc_id", "text_hash", "line", "n", "k1", "k2", "h1", "h2", "h3", "h4"]

    def each(batches):
        for whole in batches:
            for batch in pieces(whole, "text", PIECE):
                lines, row, number = _lines_of(batch)
                tokens = Tokens(lines, KINDS)
                n = tokens.counts
                start, end = tokens.firsts[:-1], tokens.firsts[1:]
                runs = _Runs(tokens.hashes)
                k1, k2 = _keys(tokens)
                halves = []
                for t in (n, n + 1):
                    head = np.maximum(t - 1, 0) // 2
                    for kind, (a, b) in enumerate(((start, start + head), (end - (np.maximum(t - 1, 0) - head), end))):
                        tag = (2 * t + kind).astype(np.uint64)
                        halves.append(mix(runs.of(a, b) ^ mix(tag)).view(np.int64))
                use = n > 0
                near = n >= MIN_WORDS
                taken = pa.array(row[use])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").take(taken),
                        batch.column("text_hash").take(taken),
                        pa.array(number[use].astype(np.int32)),
                        pa.array(n[use]),
                        pa.array(k1[use]),
                        pa.array(k2[use]),
                        *[pa.array(h[use], mask=~near[use]) for h in halves],
                    ],
                    kinds,
                )

    return documents.mapInArrow(each, ", ".join(f"{k} {'int' if k == 'line' else 'long'}" for k in kinds))


def _texts_of(documents: DataFrame, suspects: DataFrame) -> DataFrame:
    """(k1, k2, ord, line) of the suspect lines: a bitmap of fixed size keeps most others from the join."""
    found = documents.sparkSession.sparkContext.broadcast(bitmap(suspects, "k1"))

    def each(batches):
        for whole in batches:
            for batch in pieces(whole, "text", PIECE):
                lines, row, number = _lines_of(batch)
                tokens = Tokens(lines, KINDS)
                k1, k2 = _keys(tokens)
                use = np.flatnonzero((tokens.counts >= MIN_WORDS) & in_map(found.value, k1.view(np.uint64)))
                taken = pa.array(row[use])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").take(taken),
                        batch.column("text_hash").take(taken),
                        pa.array(number[use].astype(np.int32)),
                        pa.array(k1[use]),
                        pa.array(k2[use]),
                        lines.take(pa.array(use)),
                    ],
                    ["doc_id", "text_hash", "line", "k1", "k2", "words"],
                )

    rows = documents.mapInArrow(each, "doc_id long, text_hash long, line int, k1 long, k2 long, words string")
    rows = rows.select("k1", "k2", _order().alias("ord"), "words")
    return rows.join(suspects, ["k1", "k2", "ord"], "left_semi")


def _order():
    """What makes a line earlier: doc_id (null last), then, for ids in several rows, the text, then the line's number."""
    return F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("doc_id"), "text_hash", "line")


def _variants(texts: DataFrame) -> DataFrame:
    """(v, gap, k1, k2, ord): each line whole (gap -1), and with each word left out (gap: its place)."""
    names = ["v", "gap", "row"]

    def each(batches):
        for whole in batches:
            for batch in pieces(whole, "words", PIECE):
                tokens = Tokens(batch.column("words"), KINDS)
                runs = _Runs(tokens.hashes)
                out, size = [], 0
                for at in range(batch.num_rows):
                    start, end = int(tokens.firsts[at]), int(tokens.firsts[at + 1])
                    full = runs.of(np.array([start]), np.array([end]))
                    out.append((np.concatenate([full, runs.without(start, end)]), at, end - start + 1))
                    size += end - start + 1
                    if size > 200_000 or at == batch.num_rows - 1:
                        row = np.concatenate([np.full(n, a) for _, a, n in out])
                        gap = np.concatenate([np.arange(n) - 1 for *_, n in out]).astype(np.int32)
                        v = mix(np.concatenate([h for h, *_ in out])).view(np.int64)
                        took = pa.array(row)
                        kept = [batch.column(c).take(took) for c in ("k1", "k2", "none", "doc_id", "text_hash", "line")]
                        yield pa.RecordBatch.from_arrays([pa.array(v), pa.array(gap), *kept], [*names[:2], "k1", "k2", "none", "doc_id", "text_hash", "line"])
                        out, size = [], 0

    flat = texts.select("k1", "k2", "ord.*", "words")
    rows = flat.mapInArrow(each, "v long, gap int, k1 long, k2 long, none boolean, doc_id long, text_hash long, line int")
    return rows.select("v", "gap", "k1", "k2", F.struct("none", "doc_id", "text_hash", "line").alias("ord"))


def _one_apart(one: pd.Series, other: pd.Series) -> pd.Series:
    """Whether two lines differ by one word put in, left out or replaced, at most."""

    def near(x: str, y: str) -> bool:
        a, b = ([bytes(w) for w in _split(t)] for t in (x, y))
        if abs(len(a) - len(b)) > 1:
            return False
        head = 0
        while head < min(len(a), len(b)) and a[head] == b[head]:
            head += 1
        tail = 0
        while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
            tail += 1
        return max(len(a), len(b)) - head - tail <= 1

    return pd.Series([near(x, y) for x, y in zip(one, other, strict=True)], dtype=bool)


def _split(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").split()


def near_lines(documents: DataFrame, lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(different lines with their first place and number of places, those of them that are near an earlier one)."""
    firsts = lines.groupBy("k1", "k2").agg(
        F.min(_order()).alias("ord"), F.count("*").alias("places"), *[F.first(h).alias(h) for h in ("h1", "h2", "h3", "h4")]
    )
    firsts = stored(firsts, "first-lines")
    halves = firsts.where("h1 is not null").select("k1", "k2", "ord", F.explode(F.array("h1", "h2", "h3", "h4")).alias("half"))
    shared = halves.groupBy("half").agg(F.min("k1").alias("low"), F.max("k1").alias("high")).where("low != high")
    suspects = stored(halves.join(shared.select("half"), "half", "left_semi").select("k1", "k2", "ord").distinct(), "suspects")
    texts = stored(_texts_of(documents, suspects), "suspect-texts")
    variants = stored(_variants(texts), "variants")
    # Lines that leave out the same place and agree in the rest are one replaced word apart: the earliest stands for all.
    same_gap = variants.where("gap >= 0").groupBy("v", "gap").agg(F.min("ord").alias("replaced"))
    by_rest = variants.groupBy("v").agg(
        F.min(F.when(F.col("gap") < 0, F.col("ord"))).alias("shorter"),
        F.min(F.when(F.col("gap") >= 0, F.col("ord"))).alias("longer"),
        F.count("*").alias("met"),
    )
    joined = variants.join(by_rest.where("met > 1"), "v").join(same_gap, ["v", "gap"], "left")
    mate = F.when(F.col("gap") < 0, F.col("longer")).otherwise(F.least("replaced", "shorter"))
    mates = joined.withColumn("mate", mate).where("mate < ord").groupBy("k1", "k2").agg(F.min("mate").alias("mate"))
    theirs = texts.select(F.col("ord").alias("mate"), F.col("words").alias("other"))
    pairs = mates.join(texts, ["k1", "k2"]).join(theirs, "mate")
    return firsts, stored(pairs.where(F.pandas_udf(_one_apart, "boolean")("words", "other")).select("k1", "k2").distinct(), "near-lines")


def _may_be_in(keys: DataFrame, key: Column) -> Column:
    """Whether a row's key may be one of `keys`, by a bitmap of fixed size: the texts of most others need no shuffle."""
    found = keys.sparkSession.sparkContext.broadcast(bitmap(keys, "key"))

    def each(hashes: pd.Series) -> pd.Series:
        return pd.Series(in_map(found.value, hashes.to_numpy(np.int64).view(np.uint64)), dtype=bool)

    return F.pandas_udf(each, "boolean")(key)


def deduplicated(documents: DataFrame, into: str = "lines") -> DataFrame:
    """`documents` (doc_id, text, any others) with `text` cut to the lines that are kept, and a struct `into`.

    The struct holds n_lines, n_removed (longs) and removed (numbers of the removed lines, from 0). Lines end at \\n and
    are compared by their words (runs without blanks). A line is removed if an earlier one (by doc_id, null last, then
    line) has the same words, or, if both have MIN_WORDS words or more, if they differ by one word put in, left out or
    replaced. That the earlier one may itself be removed makes no difference. Lines without a word stay. Null texts stay
    null and have no lines; an empty text is one line without a word. Rows alike in doc_id and text are one document,
    returned as often as given. No two lines are paired but a line and the earliest one near it.
    """
    unused(documents, into, "__d", "__t", "__dropped")
    source = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    lines = stored(_hashed(source), "lines")
    firsts, near = near_lines(source, lines)
    near = near.withColumn("near", F.lit(True))
    again = firsts.select("k1", "k2", "ord", "places").join(near, ["k1", "k2"], "left").where("places > 1 or near")
    again = again.select("k1", "k2", F.col("ord").alias("first"), F.coalesce("near", F.lit(False)).alias("near"))
    dropped = lines.select("k1", "k2", _order().alias("ord")).join(again, ["k1", "k2"]).where("near or ord != first")
    dropped = dropped.groupBy("ord.none", "ord.doc_id", "ord.text_hash").agg(F.collect_set("ord.line").alias("__dropped"))
    dropped = dropped.select(
        F.when(~F.col("none"), F.col("doc_id")).alias("__d"), F.col("text_hash").alias("__t"), F.sort_array("__dropped").alias("__dropped")
    )
    dropped = stored(dropped, "dropped-lines")
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("__d")) & (F.xxhash64("text") == F.col("__t"))
    cut_ones = _may_be_in(dropped.select(F.xxhash64("__d", "__t").alias("key")), F.xxhash64(F.col("doc_id").cast("long"), F.xxhash64("text")))
    whole = documents.where(~cut_ones).withColumn("__dropped", F.lit(None).cast("array<int>"))
    out = documents.where(cut_ones).join(dropped, same, "left").drop("__d", "__t").unionByName(whole)
    gone = F.coalesce("__dropped", F.array().cast("array<int>"))
    every = F.split("text", "\n")
    count = F.when(F.col("text").isNull(), 0).otherwise(F.size(every))
    left = F.array_except(F.sequence(F.lit(0), count - 1), gone)
    cut = bound(every, lambda lines: F.array_join(F.transform(left, lambda i: F.get(lines, i)), "\n"))
    text = F.when(F.size(gone) > 0, cut).otherwise(F.col("text"))
    struct = F.struct(count.cast("long").alias("n_lines"), F.size(gone).cast("long").alias("n_removed"), gone.alias("removed"))
    names = [text.alias("text") if c == "text" else F.col(c) for c in documents.columns]
    return out.select(*names, struct.alias(into))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the lines that it keeps."""
    found = deduplicated(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "lines.n_lines", "lines.n_removed", F.array_join("lines.removed", ",").alias("removed"), "text")


QUERIES = {"op9_line_dedup": op9_line_dedup}
SQL = {
    "op9_line_dedup": """
with l as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) - 1 as no from documents),
w as (select doc_id, no, list_filter(regexp_split_to_array(line, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w from l),
k as (select doc_id, no, len(w) as n, w, array_to_string(w, ' ') as k, row(doc_id, no) as ord from w where len(w) > 0),
f as (select k, any_value(w) as w, any_value(n) as n, min(ord) as ord from k group by k),
v as (select k, ord, i, array_to_string(list_concat(w[:i - 1], w[i + 1:]), ' ') as v from (select *, unnest(range(1, n + 1)) as i from f where n >= 8)),
near as (
  select a.k from v a join v b on a.v = b.v and a.i = b.i and b.ord < a.ord
  union select a.k from v a join f b on a.v = b.k and b.n >= 8 and b.ord < a.ord
  union select a.k from f a join v b on a.k = b.v and a.n >= 8 and b.ord < a.ord),
dropped as (select k.doc_id, k.no from k join f on k.k = f.k where k.ord <> f.ord or k.k in (select k from near)),
kept as (select l.doc_id, string_agg(l.line, chr(10) order by l.no) as text from l anti join dropped d on l.doc_id = d.doc_id and l.no = d.no group by l.doc_id),
gone as (select doc_id, count(*) as n, string_agg(cast(no as varchar), ',' order by no) as removed from dropped group by doc_id)
select d.doc_id, coalesce(len(string_split(d.text, chr(10))), 0) as n_lines, coalesce(g.n, 0) as n_removed, coalesce(g.removed, '') as removed,
  case when d.text is not null then coalesce(x.text, '') end as text
from documents d left join gone g using (doc_id) left join kept x using (doc_id)""",
}
