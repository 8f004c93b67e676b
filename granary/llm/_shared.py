"""What the operators of this package share: columns, and the folder that all executors see."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.storage import stored as durable  # noqa: F401
from ._bytes import LAST_ID

#: `[^\x20\x09-\x0D]+` as a pattern of Java's.
WORD = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def named(column: str) -> Column:
    """A column by its exact name, dots and all."""
    return F.col("`" + column.replace("`", "``") + "`")


def keyed(df: DataFrame, id_col: str, text_col: str, row_hash: str | None = None) -> DataFrame:
    """Only (id, text), whatever else the table holds, and the row's hash as x if its column is named; a null id counts as the last id."""
    more = [named(row_hash).alias("x")] if row_hash else []
    return df.select(F.coalesce(named(id_col).cast("long"), F.lit(LAST_ID)).alias("id"), named(text_col).cast("string").alias("text"), *more)


def id_out(name: str, column: str = "id") -> Column:
    return F.when(F.col(column) != LAST_ID, F.col(column)).alias(name)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df does not have in any case of letters."""
    have = {c.lower() for c in df.columns}
    while name in have:
        name += "_"
    return name


def over_rows(df: DataFrame, text_col: str, task: Callable, finish: Callable) -> DataFrame:
    """Run a task on (row, text) beside whole rows, without a join; finish(batch, result) makes the rows that go on.

    The task gives one batch of results for each batch it gets.
    """
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []

        def feed() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                held.append(batch)
                yield pa.RecordBatch.from_arrays([pa.array(range(batch.num_rows), pa.int64()), batch.column(at).cast(pa.string())], ["id", "text"])

        for result in task(feed()):
            yield finish(held.pop(0), result)

    return df.mapInArrow(run, df.schema)
