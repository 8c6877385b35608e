"""Importance resampling towards a target's distribution, with weights added up from bit planes."""

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from moodstream.llm.decontaminate import KINDS
from moodstream.llm.hashing import Tokens, pieces
from moodstream.llm.shared import stored, table
from moodstream.operators.ranges import running

#: Fixed values of the features: words in a run, buckets, and of the draw: percent, words a document needs, seed.
RUN = 3
BUCKETS = 10_000
PERCENT = 5
LEAST_WORDS = 20
SEED = 42
#: A plane of 10000 bits is so many 64-bit words.
PLANE = -(-BUCKETS // 64)
#: Words of more bytes are hashed one by one.
_SHORT = 48
_ONE = np.uint32(0xFFFFFFFF)


def _crc_tables() -> tuple[np.ndarray, np.ndarray]:
    """The table of CRC-32 by byte, and for each n up to _SHORT what a CRC becomes by n zero bytes, by its four bytes."""
    step = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        step = np.where(step & 1, (step >> np.uint32(1)) ^ np.uint32(0xEDB88320), step >> np.uint32(1))
    shift = np.zeros((_SHORT + 1, 4, 256), np.uint32)
    for k in range(4):
        shift[0, k] = np.arange(256, dtype=np.uint32) << np.uint32(8 * k)
    for n in range(_SHORT):
        shift[n + 1] = step[shift[n] & np.uint32(255)] ^ (shift[n] >> np.uint32(8))
    return step, shift


_STEP, _SHIFT = _crc_tables()


def _after(crc: np.ndarray, more: np.ndarray, size: np.ndarray) -> np.ndarray:
    """CRCs of texts put together: of the first ones `crc`, of the second ones, of at most _SHORT bytes, `more` and `size`."""
    out = more.copy()
    for k in range(4):
        out ^= _SHIFT[size, k, (crc >> np.uint32(8 * k)) & np.uint32(255)]
    return out


def features(tokens: Tokens) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of every run of 1 to RUN words, a blank between words, as the CRC-32 of its bytes falls."""
    n = len(tokens.starts)
    sizes = tokens.ends - tokens.starts
    crc = np.full(n, _ONE, np.uint32)
    order = np.argsort(-sizes, kind="stable")
    left = np.searchsorted(-sizes[order], -np.arange(1, _SHORT + 1), side="right")
    for k, many in enumerate(left.tolist()):  # words of more than k bytes
        if not many:
            break
        use = order[:many]
        crc[use] = _STEP[(crc[use] ^ tokens.data[tokens.starts[use] + k]) & np.uint32(255)] ^ (crc[use] >> np.uint32(8))
    crc ^= _ONE
    long = np.flatnonzero(sizes > _SHORT)
    for k in long.tolist():
        crc[k] = zlib.crc32(tokens.data[tokens.starts[k] : tokens.ends[k]].tobytes())
    texts, buckets, run = [tokens.text], [crc % np.uint32(BUCKETS)], crc
    for size in range(2, RUN + 1):
        if n < size:
            break
        last = np.arange(size - 1, n)
        before = run[: n - size + 1]
        spaced = _STEP[(before ^ _ONE ^ np.uint32(0x20)) & np.uint32(255)] ^ ((before ^ _ONE) >> np.uint32(8)) ^ _ONE
        run = _after(spaced, crc[last], np.minimum(sizes[last], _SHORT))
        for k in long[long >= size - 1].tolist():
            run[k - size + 1] = zlib.crc32(tokens.data[tokens.starts[k] : tokens.ends[k]].tobytes(), int(spaced[k - size + 1]))
        inside = tokens.text[: n - size + 1] == tokens.text[last]
        texts.append(tokens.text[last][inside])
        buckets.append(run[inside] % np.uint32(BUCKETS))
    return np.concatenate(texts), np.concatenate(buckets).astype(np.int64)


def bucket_counts(texts: DataFrame) -> np.ndarray:
    """How many features of all texts fall into each bucket; 10000 sums reach the driver."""

    def each(batches):
        total = np.zeros(BUCKETS, np.int64)
        for whole in batches:
            for batch in pieces(whole, "text"):
                total += np.bincount(features(Tokens(batch.column("text"), KINDS))[1], minlength=BUCKETS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])

    rows = texts.select(F.col("text").cast("string").alias("text")).mapInArrow(each, "bucket long, n long")
    got = rows.groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(BUCKETS, np.int64)
    out[got["bucket"].to_numpy(np.int64)] = got["n"].to_numpy(np.int64)
    return out


def gains(target: np.ndarray, source: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of a bucket's share in the target and in the source, each bucket counted once more."""
    t, s = target.astype(np.float64), source.astype(np.float64)
    ratio = (t + 1) * (s.sum() + BUCKETS) / ((s + 1) * (t.sum() + BUCKETS))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def gain_planes(gain: np.ndarray) -> np.ndarray:
    """(sign, bit, word): the bits of the gains above 0 and of those below, each as planes of 10000 bits."""
    size = int(np.abs(gain).max(initial=0)).bit_length()
    out = np.zeros((2, size, PLANE), np.uint64)
    for sign, part in enumerate((np.maximum(gain, 0), np.maximum(-gain, 0))):
        for bit in range(size):
            at = np.flatnonzero((part >> bit) & 1)
            np.bitwise_or.at(out[sign, bit], at >> 6, np.uint64(1) << (at & 63).astype(np.uint64))
    return out


def weights(text: np.ndarray, bucket: np.ndarray, n_texts: int, planes: np.ndarray) -> np.ndarray:
    """The exact sum of gains of each text's features.

    A text's counts per bucket become planes too: bit j of all its counts is a plane, of which only words that are not 0
    are kept. Counts of bit j and gains of bit k that meet (AND) are counted (popcount) and weigh 2^(j + k).
    """
    out = np.zeros(n_texts, np.int64)
    places, counts = np.unique(text * (PLANE * 64) + bucket, return_counts=True)
    for j in range(int(counts.max(initial=0)).bit_length()):
        has = places[(counts >> j) & 1 == 1]
        word = has >> 6
        first = np.flatnonzero(np.append(True, word[1:] != word[:-1])[: len(word)])
        if not len(first):
            continue
        plane = np.bitwise_or.reduceat(np.uint64(1) << (has & 63).astype(np.uint64), first)
        owner, at = np.divmod(word[first], PLANE)
        total = np.zeros(len(plane), np.int64)
        for k in range(planes.shape[1]):
            more = np.bitwise_count(plane & planes[0, k][at]).astype(np.int64)
            less = np.bitwise_count(plane & planes[1, k][at])
            total += (more - less) << (j + k)
        edge = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
        out[owner[edge]] += np.add.reduceat(total, edge)
    return out


def weighed(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_features, weight) of every document."""
    planes = gain_planes(gains(bucket_counts(items), bucket_counts(documents)))
    shared = documents.sparkSession.sparkContext.broadcast(planes)

    def each(batches):
        for whole in batches:
            for batch in pieces(whole, "text"):
                tokens = Tokens(batch.column("text"), KINDS)
                text, bucket = features(tokens)
                columns = [tokens.counts, np.bincount(text, minlength=len(batch)), weights(text, bucket, len(batch), shared.value)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), *[pa.array(c.astype(np.int64)) for c in columns]], ["doc_id", "n_words", "n_features", "weight"]
                )

    source = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(each, "doc_id long, n_words long, n_features long, weight long")


def noise(doc_id: Column) -> Column:
    """Thousandths of a Gumbel draw that doc_id alone decides; a null id draws as an empty one."""
    digest = F.sha2(F.concat(F.lit(f"{SEED}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def resampled(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank) of every document; the drawn ones have a rank.

    Of the documents with LEAST_WORDS words or more, PERCENT % (rounded down) with the highest weight plus noise are
    drawn: draws without replacement in proportion to the exponent of the weight. The order is found by ranges of score
    and doc_id, so no task sees them all. Each row is a document, also where rows repeat; rows equal in score and doc_id are ranked in
    any order, a null id after the others. Null and wordless texts have no features, weight 0 and are not drawn. Empty
    tables are counts of 0. Other columns are not read.
    """
    rows = weighed(documents, items).withColumn("score", F.col("weight") + noise(F.col("doc_id")))
    rows = stored(rows.withColumn("row", F.monotonically_increasing_id()), "weighed")
    able = rows.where(F.col("n_words") >= LEAST_WORDS).withColumn("one", F.lit(1).cast("long"))
    drawn = able.count() * PERCENT // 100
    placed = running(able, [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("row")], {"rank": "one"}).drop("one")
    placed = placed.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    rest = rows.where(F.col("n_words") < LEAST_WORDS).withColumn("rank", F.lit(None).cast("long"))
    return placed.unionByName(rest).drop("row")


def op12_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weight, score and rank of every document against the benchmark."""
    found = resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


QUERIES = {"op12_resample": op12_resample}
_WORDS = "list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"
# The CRC-32 of a feature is taken byte by byte from its hexadecimal form, with the table of CRC-32 by byte made first.
SQL = {
    "op12_resample": f"""
with recursive bits(i, k, v) as (
  select cast(range as bigint), 0, cast(range as bigint) from range(256)
  union all select i, k + 1, case when v & 1 = 1 then xor(v >> 1, 3988292384) else v >> 1 end from bits where k < 8),
step as (select list(v order by i) as s from bits where k = 8),
w as (select true as doc, doc_id as id, {_WORDS} as w from documents union all select false, item_id, {_WORDS} from benchmark),
runs as (select doc, id, array_to_string(list_slice(w, i, i + n - 1), ' ') as f
  from (select doc, id, w, n, unnest(range(1, len(w) - n + 2)) as i from w, (select unnest([1, 2, 3]) as n) where len(w) >= n)),
counted as (select doc, id, f, count(*) as n from runs group by all),
bytes as (select f, list_transform(range(1, cast(len(hex(encode(f))) / 2 as bigint) + 1), lambda i: cast('0x' || substr(hex(encode(f)), 2 * i - 1, 2) as bigint)) as b
  from (select distinct f from counted)),
hashed as (select f, xor(list_reduce(b, lambda c, x: xor(s[(xor(c, x) & 255) + 1], c >> 8), 4294967295), 4294967295) % 10000 as bucket from bytes, step),
rows as (select doc, id, bucket, sum(n) as n from counted join hashed using (f) group by all),
buckets as (select range as bucket from range(10000)),
sums as (select bucket, coalesce(sum(n) filter (doc), 0)::double as s, coalesce(sum(n) filter (not doc), 0)::double as t from buckets left join rows using (bucket) group by bucket),
totals as (select sum(s) as big_s, sum(t) as big_t from sums),
gains as (select bucket, cast(floor(1000 * ln((t + 1) * (big_s + 10000) / ((s + 1) * (big_t + 10000)))) as bigint) as gain from sums, totals),
weights as (select id, cast(sum(n) as bigint) as n_features, cast(sum(n * gain) as bigint) as weight from rows join gains using (bucket) where doc group by id),
scored as (select w.id, len(w.w) as n_words, coalesce(n_features, 0) as n_features, coalesce(weight, 0) as weight,
  coalesce(weight, 0) + cast(floor(-1000 * ln(-ln((cast('0x' || substr(sha256('42:' || w.id), 1, 8) as bigint) + 0.5::double) / 4294967296::double))) as bigint) as score
  from w left join weights using (id) where doc),
able as (select id, row_number() over (order by score desc, id) as place, count(*) over () as n from scored where n_words >= 20)
select id as doc_id, n_features, weight, score, case when place <= n * 5 // 100 then place end as rank from scored left join able using (id)""",
}
