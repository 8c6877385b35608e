"""Ranked lexical search: bundles of items pass from one owner of terms to the next and gather integer scores."""

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from moodstream.llm.decontaminate import KINDS
from moodstream.llm.hashing import Tokens, bitmap, in_map, pieces
from moodstream.llm.shared import stored, table

TOP = 10
#: Items that travel together, and what of all documents a term of each owner occurs in at most: rare terms come first.
BUNDLE = 256
OWNERS = [1 / 256, 1 / 32, 1 / 8, 1.0]
#: No contribution of a term of weight w exceeds w times this.
MOST = 1_000_000
_INDEX = "block long, term string, docs array<int>, tfs array<int>, ids array<long>, sizes array<long>"


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, term, hash, repeats) of every item; rows alike in item_id and text count once."""

    def each(batches):
        for whole in batches:
            for batch in pieces(whole, "text"):
                found = Tokens(batch.column("text"), KINDS)
                terms = [found.words(k, k + 1).decode() for k in range(len(found.hashes))]
                ids = batch.column("item_id").take(pa.array(found.text))
                yield pa.RecordBatch.from_arrays([ids, pa.array(terms, pa.string()), pa.array(found.hashes.view(np.int64))], ["item_id", "term", "hash"])

    source = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    rows = source.dropDuplicates().mapInArrow(each, "item_id long, term string, hash long")
    return rows.groupBy("item_id", "term", "hash").agg(F.count("*").alias("repeats"))


def inverted(documents: DataFrame, terms: DataFrame) -> DataFrame:
    """Blocks of documents: a row without term holds their ids and sizes, one row per term the documents that have it.

    A block is a piece of an Arrow batch: at most the batch's rows and about 4 MB of text, or one longer text. Only terms
    that a bitmap of fixed size lets through are kept; the few it lets through wrongly match nothing later.
    """
    found = documents.sparkSession.sparkContext.broadcast(bitmap(terms, "hash"))

    def each(batches):
        block = TaskContext.get().partitionId() << 32
        for whole in batches:
            for batch in pieces(whole, "text"):
                tokens = Tokens(batch.column("text"), KINDS)
                use = np.flatnonzero(in_map(found.value, tokens.hashes))
                use = use[np.lexsort((tokens.text[use], tokens.hashes[use]))]
                hashes, docs = tokens.hashes[use], tokens.text[use]
                new_term = np.ones(len(use), bool)
                new_term[1:] = hashes[1:] != hashes[:-1]
                new = new_term.copy()
                new[1:] |= docs[1:] != docs[:-1]
                at = np.flatnonzero(new)
                tfs = np.diff(np.append(at, len(use)))
                first = np.flatnonzero(new_term[at])
                ends = np.append(first, len(at))
                names = [tokens.words(k, k + 1).decode() for k in use[at[first]].tolist()]
                n = len(names)
                # The documents' own row comes last.
                cuts = pa.array(np.append(ends, len(at)).astype(np.int32))
                own = pa.array(np.append(np.zeros(n + 1, np.int32), len(batch)).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(n + 1, block)),
                        pa.array([*names, None], pa.string()),
                        pa.ListArray.from_arrays(cuts, pa.array(docs[at].astype(np.int32))),
                        pa.ListArray.from_arrays(cuts, pa.array(tfs.astype(np.int32))),
                        pa.ListArray.from_arrays(own, batch.column("doc_id")),
                        pa.ListArray.from_arrays(own, pa.array(tokens.counts)),
                    ],
                    ["block", "term", "docs", "tfs", "ids", "sizes"],
                )
                block += 1

    source = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(each, _INDEX)


_BUNDLE = "block long, bundle long, ids array<long>, sizes array<long>, at array<int>, scores array<long>, best array<struct<slot:int,doc_id:long,score:long>>"


def _stage(n_docs: int, n_terms: int, top: int):
    """One owner's work on one bundle in one block: adds what its terms give, drops who can't reach the best any more."""

    def visit(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, sizes = left["ids"].combine_chunks()[0].values, left["sizes"].combine_chunks()[0].values.to_numpy()
        limits, rest = (left[c].combine_chunks()[0].values.to_numpy() for c in ("limits", "rest"))
        size = len(sizes)
        scores = np.zeros(len(limits) * size, np.int64)
        scores[left["at"].combine_chunks()[0].values.to_numpy()] = left["scores"].combine_chunks()[0].values.to_numpy()
        m = 25 + (75 * sizes * n_docs) // n_terms
        columns = [right[c].combine_chunks() for c in ("docs", "tfs", "slots", "repeats")]
        weights = right["weight"].to_numpy()
        for k in range(right.num_rows):
            docs, tfs, slots, repeats = (c[k].values.to_numpy() for c in columns)
            tfs = tfs.astype(np.int64)
            gives = weights[k] * ((1_000_000_000 * tfs) // (1000 * tfs + 8 * m[docs]))
            for slot, times in zip(slots.tolist(), repeats.tolist(), strict=True):
                scores[slot * size + docs] += times * gives
        at = np.flatnonzero(scores)
        slot = at // size
        able = scores[at] + rest[slot] >= limits[slot]
        at, slot = at[able], slot[able]
        got, doc = scores[at], at - slot * size
        keys = ids.fill_null(np.iinfo(np.int64).max).to_numpy()[doc]
        order = np.lexsort((ids.is_null().to_numpy(zero_copy_only=False)[doc], keys, -got, slot))
        firsts = np.searchsorted(slot[order], np.arange(len(limits)))
        best = order[np.arange(len(order)) - firsts[slot[order]] < top]
        best = pa.StructArray.from_arrays(
            [pa.array(slot[best].astype(np.int32)), ids.take(pa.array(doc[best])), pa.array(got[best])], ["slot", "doc_id", "score"]
        )

        def one(values):
            return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)

        columns = [left["block"], left["bundle"], one(ids), one(pa.array(sizes)), one(pa.array(at.astype(np.int32))), one(pa.array(got)), one(best)]
        return pa.table(columns, names=["block", "bundle", "ids", "sizes", "at", "scores", "best"])

    return visit


def ranked(documents: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """(item_id, rank, doc_id, score): the `top` documents of each item with the highest scores above 0.

    Terms belong to owners by how many documents have them, the rarest first; documents stand in blocks. A bundle of
    items visits its block's part of each owner in turn (a cogroup each) and carries a sparse score per item and document;
    an owner adds integers only. After each owner the `top`-th best score so far of an item is a bound: a document that can't reach it
    with all that is still to come is dropped, which loses nothing. Block and bundle bound every group, so a term that all
    documents have is spread like any other. The best of each block are ranked at the end.

    Each row of `documents` is a document, also where rows repeat; equal scores are ranked by doc_id, a null one last. Rows alike in item_id and
    text count once; one item_id with several texts is one item with all their terms. Null and wordless texts have no
    terms: such documents are never found, such items find nothing. Empty tables give no rows. Other columns are not read.
    """
    terms = stored(item_terms(items), "item-terms")
    index = stored(inverted(documents, terms), "inverted")
    blocks = index.where("term is null").select("block", "ids", "sizes")
    size = F.explode("sizes").alias("size")
    n_docs, n_terms = blocks.select(size).agg(F.count_if(F.col("size") > 0), F.coalesce(F.sum("size"), F.lit(0))).first()
    n_docs, n_terms = max(n_docs, 1), max(n_terms, 1)
    postings = index.where("term is not null").select("block", "term", "docs", "tfs")

    df = postings.groupBy("term").agg(F.sum(F.size("docs")).alias("df"))
    weight = F.floor(1000 * F.log(F.lit(2.0 * n_docs + 2) / (2 * F.col("df") + 1)))
    owner = sum((F.col("df") > F.lit(share * n_docs)).cast("int") for share in OWNERS[:-1])
    weighted = terms.join(df, "term").select("item_id", "term", "repeats", weight.cast("long").alias("weight"), owner.alias("owner"))
    weighted = stored(weighted, "weighted-terms")
    n_bundles = max(1, -(-weighted.select("item_id").distinct().count() // BUNDLE))
    bundle = F.pmod(F.xxhash64("item_id"), F.lit(n_bundles)).alias("bundle")
    slot = (F.row_number().over(Window.partitionBy("bundle").orderBy("item_id")) - 1).alias("slot")
    slots = stored(weighted.select("item_id", bundle).distinct().select("item_id", "bundle", slot), "slots")
    placed = weighted.join(slots, weighted.item_id.eqNullSafe(slots.item_id)).drop(slots.item_id)
    asked = placed.groupBy("term", "owner", "weight", "bundle").agg(F.sort_array(F.collect_list(F.struct("slot", "repeats"))).alias("asks"))
    asked = asked.select("term", "owner", "weight", "bundle", F.col("asks.slot").alias("slots"), F.col("asks.repeats").alias("repeats"))
    path = stored(postings.join(asked, "term").drop("term"), "owned")
    still = [F.sum(F.when(F.col("owner") > k, F.col("weight") * F.col("repeats") * MOST).otherwise(0)).alias(f"rest{k}") for k in range(len(OWNERS))]
    still = stored(placed.groupBy("bundle", "slot").agg(*still), "still-to-come")

    none = F.array().cast("array<int>"), F.array().cast("array<long>")
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_bundles - 1).cast("long")))
    bundles = blocks.select("block", every.alias("bundle"), "ids", "sizes", none[0].alias("at"), none[1].alias("scores"))
    limits = still.select("bundle", "slot", F.lit(1).cast("long").alias("limit"))
    for k in range(len(OWNERS)):
        known = limits.join(still.select("bundle", "slot", F.col(f"rest{k}").alias("rest")), ["bundle", "slot"])
        known = known.groupBy("bundle").agg(F.sort_array(F.collect_list(F.struct("slot", "limit", "rest"))).alias("known"))
        known = known.select("bundle", F.col("known.limit").alias("limits"), F.col("known.rest").alias("rest"))
        mine = path.where(F.col("owner") == k).drop("owner")
        visited = bundles.join(known, "bundle").groupBy("block", "bundle").cogroup(mine.groupBy("block", "bundle"))
        bundles = stored(visited.applyInArrow(_stage(n_docs, n_terms, top), _BUNDLE), f"bundles-{k}")
        best = bundles.select("bundle", F.explode("best").alias("b")).select("bundle", "b.*")
        order = Window.partitionBy("bundle", "slot").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        best = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
        if k + 1 < len(OWNERS):
            last = best.where(F.col("rank") == top).select("bundle", "slot", "score")
            limits = stored(
                still.select("bundle", "slot").join(last, ["bundle", "slot"], "left").select("bundle", "slot", F.coalesce("score", F.lit(1)).cast("long").alias("limit")),
                f"limits-{k}",
            )
    return best.join(slots, ["bundle", "slot"]).select("item_id", "rank", "doc_id", "score")


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of each benchmark item."""
    return ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op11_lexical_search": op11_lexical_search}
_TERMS = "list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"
SQL = {
    "op11_lexical_search": f"""
with d as (select doc_id, {_TERMS} as w from documents),
b as (select item_id, unnest({_TERMS}) as term from (select distinct item_id, text from benchmark)),
asked as (select item_id, term, count(*) as repeats from b group by item_id, term),
totals as (select cast(count(*) as bigint) as n_docs, cast(sum(len(w)) as bigint) as n_terms from d where len(w) > 0),
terms as (select distinct term from asked),
postings as (select doc_id, n, term, count(*) as tf
  from (select doc_id, len(w) as n, unnest(w) as term from d) semi join terms using (term) group by doc_id, n, term),
df as (select term, count(*) as df from postings group by term),
weights as (select term, cast(floor(1000 * ln((2 * n_docs + 2)::double / (2 * df + 1)::double)) as bigint) as weight from df, totals),
scored as (select a.item_id, p.doc_id, cast(sum(a.repeats * weight * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * n_docs) // n_terms)))) as bigint) as score
  from asked a join postings p using (term) join weights using (term), totals group by a.item_id, p.doc_id),
placed as (select item_id, cast(row_number() over (partition by item_id order by score desc, doc_id) as integer) as rank, doc_id, score from scored where score > 0)
select item_id, rank, doc_id, score from placed where rank <= 10""",
}
