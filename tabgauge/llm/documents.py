"""What the operators share about documents: row identity and words as columns."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Ids from here on stand for documents without one.
NO_ID = 1 << 62


def row_id() -> Column:
    """The doc_id, or a number from the text where there is none."""
    own = F.xxhash64("text").bitwiseAND(NO_ID - 1).bitwiseOR(F.lit(NO_ID))
    return F.coalesce(F.col("doc_id").cast("long"), own)


def identified(docs: DataFrame, *more: str) -> DataFrame:
    """id, doc_id, text and more text columns; id is never null."""
    return docs.select(
        row_id().alias("id"),
        F.col("doc_id").cast("long").alias("doc_id"),
        *[F.col(c).cast("string").alias(c) for c in ("text", *more)],
    )


def without(docs: DataFrame, rows: DataFrame, most: int, **checks: Column) -> DataFrame:
    """docs, all its columns, without the rows of a stored table (id and checks).

    checks are what, besides the id, tells rows apart; up to `most` rows of the table
    are sent to all executors.
    """
    values = {"id": row_id(), **checks}
    names = {column: f"_{column}" for column in values}
    while set(names.values()) & set(docs.columns):
        names = {column: f"_{name}" for column, name in names.items()}
    left = docs.withColumns({names[column]: value for column, value in values.items()})
    right = rows.select(*[F.col(column).alias(name) for column, name in names.items()]).distinct()
    return left.join(sent(right, rows.count(), most), list(names.values()), "left_anti").select(
        *docs.columns
    )


def lowered(text: Column) -> Column:
    """A-Z in lower case, all else as it is."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def sent(table: DataFrame, rows: int, most: int) -> DataFrame:
    """A small table of counted rows goes to all executors; a larger one is left to shuffles."""
    return F.broadcast(table) if rows <= most else table
