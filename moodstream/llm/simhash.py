"""Near duplicates by SimHash fingerprints, found by meeting in the middle."""

import re
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from moodstream.llm.components import connected
from moodstream.llm.shared import stored, table

BITS = 64
SEED = 42
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_AT_ONCE = 1 << 15


def fingerprint_of(text: str | None, size: int = 3) -> int:
    """The fingerprint of one text, unsigned: bit by bit what over half of the hashes of its `size`-word shingles say."""
    words = _WORD.findall(text.encode("utf-8", "surrogatepass").translate(_LOWER)) if text else []
    if not words:
        return 0
    n = max(1, len(words) - size + 1)
    ones = np.zeros(BITS, np.int64)
    digest, join = xxhash.xxh64_intdigest, b" ".join
    for at in range(0, n, _AT_ONCE):
        hashes = [digest(join(words[i : i + size]), SEED) for i in range(at, min(n, at + _AT_ONCE))]
        octets = np.array(hashes, np.uint64).view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return sum(1 << int(bit) for bit in np.flatnonzero(2 * ones > n))


def fingerprints(text: Column, size: int = 3) -> Column:
    """Fingerprints as signed 64-bit numbers. A null or wordless text has fingerprint zero."""

    @F.pandas_udf("long")
    def each(texts: pd.Series) -> pd.Series:
        values = np.array([fingerprint_of(t, size) for t in texts], np.uint64)
        return pd.Series(values.view(np.int64))

    return each(text)


def links(distinct: DataFrame, radius: int = 2) -> DataFrame:
    """Pairs (a, b), a < b, of different fingerprints at most `radius` bits apart, enough to tie all that are linked.

    Each fingerprint is sent to every value within half the radius of it; two that are within the radius meet at some
    value in the middle. At most as many fingerprints meet at one value as there are values within half the radius, so
    no group grows with the data. Where all that meet must be within the radius (even radius) each is paired with the
    smallest only; otherwise all pairs are formed. Every pair is verified by its distance.
    """
    if not 0 <= radius <= 4:
        raise ValueError("the radius must be 0 to 4")
    half = (radius + 1) // 2
    masks = [0] + [sum(1 << b for b in bits) for k in range(1, half + 1) for bits in combinations(range(BITS), k)]
    signed = np.array(masks, np.uint64).view(np.int64).tolist()
    sent = distinct.select("fingerprint", F.explode(F.lit(signed)).alias("flip"))
    sent = sent.select(F.col("fingerprint").bitwiseXOR(F.col("flip")).alias("middle"), "flip")
    if half == 1:
        # What meets at a value is told by which single bits differ: a mask and a flag hold the whole group.
        met = sent.groupBy("middle").agg(
            F.bit_or("flip").alias("bits"), F.max((F.col("flip") == 0).cast("int")).alias("itself")
        )
        met = met.where(F.bit_count("bits") + F.col("itself") > 1)
        ones = F.filter(F.lit(signed[1:]), lambda m: F.col("bits").bitwiseAND(m) != 0)
        members = F.transform(ones, lambda m: F.col("middle").bitwiseXOR(m))
        members = F.when(F.col("itself") == 1, F.array_append(members, F.col("middle"))).otherwise(members)
    else:
        met = sent.groupBy("middle").agg(F.collect_list("flip").alias("all")).where(F.size("all") > 1)
        members = F.transform("all", lambda m: F.col("middle").bitwiseXOR(m))
    groups = met.select(F.sort_array(members).alias("members"))
    if 2 * half <= radius:
        pairs = groups.select(F.get("members", F.lit(0)).alias("a"), F.explode("members").alias("b"))
    else:
        firsts = groups.select("members", F.explode("members").alias("a"))
        pairs = firsts.select("a", F.explode("members").alias("b"))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius
    return pairs.where((F.col("a") < F.col("b")) & near).distinct()


def near_duplicates(documents: DataFrame, radius: int = 2, size: int = 3) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of `documents` (doc_id, text; other columns are not read).

    Documents whose fingerprints are at most `radius` bits apart are linked; `component_id` is the smallest doc_id that
    links reach. Equal fingerprints are one node however many documents have them. Null and wordless texts have
    fingerprint zero and are linked like any other; repeated rows are returned as often as given; a null doc_id takes
    part but names no component unless all of it are null. An empty table gives no rows.
    """
    marked = stored(documents.select("doc_id", fingerprints(F.col("text"), size).alias("fingerprint")), "fingerprints")
    nodes = stored(marked.groupBy("fingerprint").agg(F.min("doc_id").alias("first_id")), "fingerprint-nodes")
    tied = connected(links(nodes, radius)).withColumnRenamed("node", "fingerprint")
    placed = nodes.join(tied, "fingerprint", "left").withColumn("component", F.coalesce("component", "fingerprint"))
    firsts = placed.groupBy("component").agg(F.min("first_id").alias("component_id"))
    placed = placed.join(firsts, "component").select("fingerprint", "component_id")
    return marked.join(placed, "fingerprint").select("doc_id", "fingerprint", "component_id")


def one_of_each(documents: DataFrame, radius: int = 2, size: int = 3) -> DataFrame:
    """`documents` with one document of each group of near duplicates: that with the smallest doc_id.

    Rows that repeat a doc_id count as one document, of which one row stays; a row without doc_id stays only in a group
    that has no other.
    """
    found = near_duplicates(documents, radius, size)
    keep = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select("doc_id").distinct()
    unique = documents.dropDuplicates(["doc_id"]) if _repeats(documents) else documents
    return unique.join(keep.withColumnRenamed("doc_id", "__kept"), F.col("doc_id").eqNullSafe(F.col("__kept")), "left_semi")


def _repeats(documents: DataFrame) -> bool:
    """Whether some doc_id stands in several rows; only then is it worth moving texts to compare rows."""
    again = documents.groupBy("doc_id").count().where("count > 1")
    return not again.isEmpty()


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and group of near duplicates of every document."""
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.withColumn("fingerprint", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")))


QUERIES = {"op7_simhash": op7_simhash}
SQL: dict[str, str] = {}
