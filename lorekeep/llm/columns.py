"""Word and shingle columns made of built-in Spark functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Everything ASCII but letters and digits parts words (text is lower-cased first).
BETWEEN_WORDS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: str | Column) -> Column:
    """The lower-cased words of a text; null and wordless texts have none."""
    text = F.col(text) if isinstance(text, str) else text
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), BETWEEN_WORDS), "")


def text_key(text: str | Column) -> Column:
    """The same for equal texts, different for different ones; null counts as empty."""
    text = F.col(text) if isinstance(text, str) else text
    return F.md5(F.coalesce(text, F.lit("")).cast("binary"))


def bounded(df: DataFrame, rows: int) -> DataFrame:
    """df marked for broadcast if it has at most so many rows (counted), else df as it is; df should be a saved table."""
    return F.broadcast(df) if df.count() <= rows else df


def whole_rows(df: DataFrame) -> DataFrame:
    """df as one column `row` that holds all its columns, so that columns of any names can stand beside them; `row.*` gives them back."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))
