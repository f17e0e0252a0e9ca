"""Character references of HTML in columns of texts.

The table is that of the HTML standard, as Python's library has it: over two thousand names, some of
them also without a semicolon, where the longest name that fits counts, and numbers of either base.
Only texts with an ampersand go to a worker; the others stay where they are.
"""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

#: Between entries of an array on their way to a worker; no reference stands for it.
BREAK = "\x01"


@F.pandas_udf(StringType())
def _unescaped(texts: pd.Series) -> pd.Series:
    return texts.map(html.unescape, na_action="ignore")


def decode(text: Column) -> Column:
    """The text without references."""
    marked = text.contains("&")
    return F.when(marked, _unescaped(F.when(marked, text))).otherwise(text)


def decoded(df: DataFrame, *names: str) -> DataFrame:
    """df with the references in string and array<string> columns decoded."""
    for name in names:
        if isinstance(df.schema[name].dataType, ArrayType):
            joined = F.array_join(name, BREAK)
            df = df.withColumn(name, F.when(joined.contains("&"), F.split(decode(joined), BREAK)).otherwise(F.col(name)))
        else:
            df = df.withColumn(name, decode(F.col(name)))
    return df
