"""What several operators share: words, written tables, free column names."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventmetrics.session import work_dir

# A word is a run of anything but these six characters.
BLANKS = " \t\n\x0b\f\r"
BLANK_RUN = "[\\x20\\x09-\\x0D]+"


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the folder that all executors share, and read back.

    Cuts the lineage: a lost executor costs the tasks that were running, not
    the steps before. The schema is given, so an empty table reads back too.
    """
    path = work_dir(df.sparkSession, f"llm-{label}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(columns: Iterable[str], wish: str) -> str:
    """``wish``, with underscores before it until no column has that name."""
    taken = {c.lower() for c in columns}
    while wish.lower() in taken:
        wish = f"_{wish}"
    return wish


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once per row, however often it is used."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    """The words of a text; none for null."""
    plain = F.translate(F.coalesce(text, F.lit("")), BLANKS[1:], " " * 5)
    return F.filter(F.split(plain, " "), lambda w: w != "")


def without(text: Column, characters: str) -> Column:
    return F.translate(text, characters, "")
