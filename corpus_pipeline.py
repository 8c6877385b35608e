"""The corpus pipeline: quality rules, line dedup, near-dedup, decontamination and mixing, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read back as the next
one's docs. All but the last return the columns of documents. `run` applies them to the table of documents.

Null or empty texts fail the quality rules. A stage that meets an empty table returns an empty table; rows that repeat a
doc_id are one document from near-dedup on. Columns beyond those of documents are carried along.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moodstream.llm.decontaminate import marked
from moodstream.llm.lines import deduplicated
from moodstream.llm.mixing import with_copies
from moodstream.llm.quality import judged
from moodstream.llm.shared import stored, table
from moodstream.llm.simhash import one_of_each


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and lie near their language.

    Verdicts are stored before they are asked for: a filter on them would be moved below the steps that make them, and
    every step would be worked out again at each place that the filter's expression names it.
    """
    return stored(judged(docs, "__verdict"), "verdicts").where("__verdict.kept").drop("__verdict")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that stand earlier; those of which no word is left go. n_chars follows the text."""
    cut = deduplicated(docs, "__lines")
    empty = (F.col("__lines.n_removed") > 0) & ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    cut = cut.where(~F.coalesce(empty, F.lit(False)))
    if "n_chars" in docs.columns:
        length = F.when(F.col("__lines.n_removed") > 0, F.length("text")).otherwise(F.col("n_chars"))
        cut = cut.withColumn("n_chars", length.cast(docs.schema["n_chars"].dataType))
    return cut.drop("__lines")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: SimHash of three-word shingles, linked at two bits or fewer."""
    return one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by the benchmark."""
    return marked(docs, table(spark, sf_dir, "benchmark"), "__hits").where("not __hits.contaminated").drop("__hits")


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with size, source_size, target, copies and taken."""
    return with_copies(docs, into="__mix").select(*docs.columns, "__mix.*")


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("near-dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs


#: SimHash's 64-bit hashes and the rounding's draws have no DuckDB form; tests compare each stage with plain Python.
ORACLE_SQL = None
