"""The columns of a caller's table travel in one struct, so that no name of theirs meets a name an operator uses.

The one rule of all corpus operators: the result has the input's columns in their order, then those the operator adds; an
input column with the name of an added one, in whatever case, is replaced by it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def packed(docs: DataFrame, name: str = "doc") -> DataFrame:
    """docs as one struct column."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(name))


def unpacked(df: DataFrame, docs: DataFrame, name: str = "doc", **added: Column) -> DataFrame:
    """The columns of docs from the struct, with the added ones."""
    return df.select(*kept(docs, *added, name=name), *[c.alias(k) for k, c in added.items()])


def kept(docs: DataFrame, *added: str, name: str | None = None) -> list[Column]:
    """The columns of docs that an operator's own columns do not replace."""
    taken = {a.lower() for a in added}
    return [F.col(f"{name}.`{c}`" if name else f"`{c}`") for c in docs.columns if c.lower() not in taken]
