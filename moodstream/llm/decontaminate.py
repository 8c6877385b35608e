"""Benchmark decontamination by a prefix-filtered join of shingles, verified over windows of item words."""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from moodstream.llm.hashing import Tokens, bitmap, in_map, pieces
from moodstream.llm.shared import stored, table, unused

WINDOW = 13
SHINGLE = 3
#: Bytes of text that a task hashes at once, which bounds the memory of its tables of powers and sums.
PIECE = 1 << 20
#: Bytes inside words: digits, small letters, all that is not ASCII; capitals stand as small letters. 0 is between words.
KINDS = np.zeros(256, np.uint8)
KINDS[0x30:0x3A] = np.arange(0x30, 0x3A)
KINDS[0x61:0x7B] = np.arange(0x61, 0x7B)
KINDS[0x41:0x5B] = np.arange(0x61, 0x7B)
KINDS[0x80:] = np.arange(0x80, 0x100)


def item_windows(items: DataFrame) -> DataFrame:
    """(item_id, window, n_words, shingle, k, offset): each window of each item with all its shingles.

    A window is WINDOW words in a row, or the whole item if it has fewer; a shingle is SHINGLE words, or the whole window
    if that has fewer. Items without words have no window.
    """

    def each(batches):
        for whole in batches:
            for batch in pieces(whole, "text", PIECE):
                found = Tokens(batch.column("text"), KINDS)
                shingled = {k: found.shingles(k).view(np.int64) for k in range(1, SHINGLE + 1)}
                ids = batch.column("item_id").to_pylist()
                rows = []
                for item, count in enumerate(found.counts):
                    first = int(found.firsts[item])
                    size = min(WINDOW, int(count))
                    k = min(SHINGLE, size)
                    for at in range(first, first + int(count) - size + 1 if size else first):
                        text = found.words(at, at + size).decode()
                        rows += [(ids[item], text, size, int(shingled[k][at + o]), k, o) for o in range(size - k + 1)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    names = ["item_id", "window", "n_words", "shingle", "k", "offset"]
    types = [pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int32(), pa.int32()]
    source = items.select(F.col("item_id").cast("long"), F.col("text"))
    return source.mapInArrow(each, "item_id long, window string, n_words int, shingle long, k int, offset int")


def _frequencies(documents: DataFrame, shingles: DataFrame, sizes: list[int]) -> DataFrame:
    """How often each benchmark shingle stands in the documents, counted batch by batch before the shuffle."""
    found = documents.sparkSession.sparkContext.broadcast(bitmap(shingles, "shingle"))

    def each(batches):
        for whole in batches:
            for batch in pieces(whole, "text", PIECE):
                tokens = Tokens(batch.column("text"), KINDS)
                got = [h[in_map(found.value, h) & (h != 0)] for h in (tokens.shingles(k) for k in sizes)]
                values, counts = np.unique(np.concatenate(got), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(counts)], ["shingle", "n"])

    rows = documents.select("text").mapInArrow(each, "shingle long, n long")
    return rows.groupBy("shingle").agg(F.sum("n").alias("n"))


def _candidates(documents: DataFrame, prefixes: DataFrame, sizes: list[int]) -> DataFrame:
    """A row for each document, and one for each place where it has a prefix shingle, with the words around it."""
    found = documents.sparkSession.sparkContext.broadcast(bitmap(prefixes, "shingle"))
    names = ["doc_id", "text_hash", "n_words", "shingle", "at", "before", "around"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.string()]

    def each(batches):
        for whole in batches:
            for batch in pieces(whole, "text", PIECE):
                tokens = Tokens(batch.column("text"), KINDS)
                ids, keys = batch.column("doc_id").to_pylist(), batch.column("text_hash").to_pylist()
                rows = [(ids[d], keys[d], int(n), None, None, None, None) for d, n in enumerate(tokens.counts)]
                for k in sizes:
                    hashes = tokens.shingles(k)
                    for at in np.flatnonzero(in_map(found.value, hashes) & (hashes != 0)).tolist():
                        d = int(tokens.text[at])
                        start = max(int(tokens.firsts[d]), at - WINDOW + k)
                        end = min(int(tokens.firsts[d + 1]), at + WINDOW)
                        around = tokens.words(start, end).decode()
                        place = at - int(tokens.firsts[d])
                        rows.append((ids[d], keys[d], None, int(hashes[at].view(np.int64)), place, at - start, around))
                        if len(rows) >= 20_000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
                            rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    schema = "doc_id long, text_hash long, n_words long, shingle long, at long, before int, around string"
    source = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    return source.mapInArrow(each, schema)


def contaminated(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, text_hash, n_words, n_hit, n_items, items_sha256, contaminated), a row per different doc_id and text.

    A document word is hit if it lies in a place where the document has all words of a window of an item in a row. To
    be contained, a window needs its rarest shingle: shingles are ordered by how often all documents have them, the
    rarest of each window (the whole prefix that full containment asks for) is joined, the place that the window would
    take must lie inside the document (length and position bounds), and its words are compared one by one. Equal windows
    are one; documents with equal sets of windows share one list of items. A bitmap of fixed size, whatever the
    benchmark's, keeps most document words out of the join. Null or wordless texts have no words, nothing hit and are
    not contaminated; wordless items never occur; an empty benchmark hits nothing; null ids are ids like any other, but
    a null item_id is not listed. Other columns are not read.
    """
    windows = stored(item_windows(items), "item-windows")
    sizes = sorted(r.k for r in windows.select("k").distinct().collect())  # 1 to SHINGLE at most
    rarity = stored(_frequencies(documents, windows.select("shingle"), sizes or [SHINGLE]), "shingle-counts")
    distinct = windows.select("window", "n_words", "shingle", "k", "offset").distinct().join(rarity, "shingle", "left")
    order = Window.partitionBy("window").orderBy(F.coalesce("n", F.lit(0)), "shingle", "offset")
    prefixes = distinct.withColumn("rank", F.row_number().over(order)).where("rank = 1")
    prefixes = stored(prefixes.select("window", F.col("n_words").alias("size"), "shingle", "offset"), "prefixes")
    rows = stored(_candidates(documents, prefixes.select("shingle"), sizes or [SHINGLE]), "candidates")
    texts = rows.where("shingle is null").select("doc_id", "text_hash", "n_words").distinct()
    places = rows.where("shingle is not null").drop("n_words").distinct()
    start = F.col("before") - F.col("offset")
    words = F.split("around", " ")
    hits = places.join(prefixes, "shingle").where((start >= 0) & (start + F.col("size") <= F.size(words)))
    hits = hits.where(F.array_join(F.slice(words, start + 1, F.col("size")), " ") == F.col("window"))
    hits = hits.select(
        "doc_id", "text_hash", (F.col("at") - F.col("offset")).alias("start"), "size", F.xxhash64("window").alias("window")
    )
    hits = stored(hits.distinct(), "hits")
    end = F.col("start") + F.col("size")
    text_rows = Window.partitionBy("doc_id", "text_hash").orderBy("start", "size")
    so_far = F.max(end).over(text_rows.rowsBetween(Window.unboundedPreceding, -1))
    new = F.greatest(F.lit(0), end - F.greatest("start", F.coalesce(so_far, F.lit(0))))
    covered = hits.select("doc_id", "text_hash", "window", new.alias("new"))
    covered = covered.groupBy("doc_id", "text_hash").agg(
        F.sum("new").alias("n_hit"), F.sort_array(F.collect_set("window")).alias("set")
    )
    covered = covered.withColumn("sign", F.sha2(F.array_join(F.transform("set", lambda w: w.cast("string")), ","), 256))
    covered = stored(covered, "covered")
    of_window = windows.select(F.xxhash64("window").alias("window"), "item_id").distinct()
    sets = covered.groupBy("sign").agg(F.first("set").alias("set")).select("sign", F.explode("set").alias("window"))
    named = sets.join(of_window, "window").where("item_id is not null").select("sign", F.col("item_id").cast("string").alias("item")).distinct()
    named = named.groupBy("sign").agg(F.sort_array(F.collect_list("item")).alias("items"))
    named = named.select("sign", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"))
    found = covered.join(named, "sign", "left").select(
        F.col("doc_id").alias("d"), F.col("text_hash").alias("t"), "n_hit", "n_items", "items_sha256"
    )
    same = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("t"))
    out = texts.join(found, same, "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return out.select(
        "doc_id",
        "text_hash",
        "n_words",
        n_hit.alias("n_hit"),
        F.coalesce("n_items", F.lit(0)).alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"),
        ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"),
    )


def marked(documents: DataFrame, items: DataFrame, into: str = "benchmark") -> DataFrame:
    """`documents` with a struct `into` of n_words, n_hit, n_items, items_sha256 and contaminated; repeated rows stay repeated."""
    unused(documents, into)
    found = contaminated(documents, items)
    names = ["n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    found = found.select(F.col("doc_id").alias("__d"), F.col("text_hash").alias("__t"), F.struct(*names).alias(into))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("__d")) & (F.xxhash64("text") == F.col("__t"))
    return documents.join(found, same).drop("__d", "__t")


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark hits of every document."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = contaminated(documents, table(spark, sf_dir, "benchmark"))
    # A row per document also where rows repeat: those are rare, so their counts are joined, not their texts.
    again = documents.groupBy(F.col("doc_id").alias("d"), F.xxhash64("text").alias("t")).agg(F.count("*").alias("rows"))
    again = again.where("rows > 1")
    same = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("t"))
    found = found.join(again, same, "left")
    found = found.withColumn("row", F.explode(F.sequence(F.lit(1), F.coalesce("rows", F.lit(1)).cast("int"))))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


QUERIES = {"op8_decontaminate": op8_decontaminate}
_WORDS = "list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"
SQL = {
    "op8_decontaminate": f"""
with d as (select doc_id, {_WORDS} as w from documents),
b as (select item_id, {_WORDS} as w from benchmark),
windows as (
  select item_id, least(13, len(w)) as size, array_to_string(list_slice(w, i, i + least(13, len(w)) - 1), ' ') as win
  from (select item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) as i from b where len(w) > 0)),
sizes as (select distinct size from windows),
places as (
  select doc_id, size, i, array_to_string(list_slice(w, i, i + size - 1), ' ') as win
  from (select doc_id, w, size, unnest(range(1, len(w) - size + 2)) as i from d cross join sizes where len(w) >= size)),
hits as (select p.doc_id, p.i, p.size, x.item_id from places p join windows x on p.win = x.win),
covered as (select doc_id, count(distinct pos) as n_hit from (select doc_id, unnest(range(i, i + size)) as pos from (select distinct doc_id, i, size from hits)) group by doc_id),
named as (select doc_id, count(*) as n_items, sha256(string_agg(item, ',' order by item)) as items_sha256
  from (select distinct doc_id, cast(item_id as varchar) as item from hits) group by doc_id)
select d.doc_id, len(d.w) as n_words, coalesce(c.n_hit, 0) as n_hit, coalesce(n.n_items, 0) as n_items,
  coalesce(n.items_sha256, sha256('')) as items_sha256, coalesce(c.n_hit, 0) > 0 and 20 * coalesce(c.n_hit, 0) >= len(d.w) as contaminated
from d left join covered c using (doc_id) left join named n using (doc_id)""",
}
