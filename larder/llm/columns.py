"""Columns of a caller's table beside those of an operator, whatever they are called."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def column(name: str) -> Column:
    """The column of just this name: blanks, dots and backticks in it mean nothing."""
    return F.col("`" + name.replace("`", "``") + "`")


def others(df: DataFrame, taken) -> list[str]:
    """The columns of df that are not called like one of taken, in any case."""
    gone = {c.lower() for c in taken}
    return [c for c in df.columns if c.lower() not in gone]


def extended(df: DataFrame, text: str, new: str, function, keep_text: bool = True, cut=None) -> DataFrame:
    """df with the columns of new, a list like "ids array<int>": function makes their arrays from the array of texts.

    Columns of df that are called like new ones, in any case, go; so does text without
    keep_text. cut() may cut the batches by their column of a given number before.
    """
    fields = StructType.fromDDL(new).fields
    names = [f.name for f in fields]
    kept = others(df, names + ([] if keep_text else [text]))
    rows = df.select(row(df, [*names, text]), column(text).alias("text"))
    again = [rows.schema["text"]] if text in kept else []

    def run(batches):
        for batch in cut(batches, 1) if cut else batches:
            arrays = function(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), *([batch.column(1)] if again else []), *arrays], ["row", *(["text"] if again else []), *names])

    # mapInArrow() reads dots in the names of columns, but not in those of a struct's fields
    done = rows.mapInArrow(run, StructType([rows.schema["row"], *again, *fields]))
    return done.select(*[F.col("text").alias(c) if c == text else F.col("row").getField(c).alias(c) for c in kept], *map(column, names))


def row(df: DataFrame, taken=()) -> Column:
    """All other columns of df in one struct, called row; unpacked() takes it apart."""
    kept = others(df, taken)
    spare = "_"
    while spare in {c.lower() for c in kept}:
        spare += "_"
    return F.struct(*[column(c).alias(c) for c in kept], F.lit(True).alias(spare)).alias("row")


def unpacked(kept: list[str]) -> list[Column]:
    return [F.col("row").getField(c).alias(c) for c in kept]
