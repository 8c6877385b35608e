"""What the operators share: given tables, stored intermediate tables, the meaning of a word."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from moodstream.session import fresh_dir

#: Characters between words, as a Java, RE2 and Python class.
SPACE = r"[\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table, whole."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(rows: DataFrame, name: str) -> DataFrame:
    """`rows` written to the shared folder and read back: cuts lineage, survives lost executors, is computed once."""
    path = fresh_dir(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def words(text: Column) -> Column:
    """The words of a text in order; none for a null."""
    return F.coalesce(F.array_remove(F.split(text, SPACE + "+"), ""), F.array().cast("array<string>"))


def bound(value: Column, body) -> Column:
    """`body` of a value that is evaluated once per row, also where lambdas inside `body` use it many times."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def unused(frame: DataFrame, *names: str) -> None:
    """An error if `frame` already has one of the columns that an operator is about to add."""
    taken = {c.lower() for c in frame.columns} & {n.lower() for n in names}
    if taken:
        raise ValueError(f"columns {sorted(taken)} exist; name the result otherwise")


def with_field(frame: DataFrame, name: str, kind: str) -> StructType:
    """The schema of `frame` and one more field."""
    return StructType(list(frame.schema.fields)).add(name, kind)
