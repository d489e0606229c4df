"""Columns that an operator passes through under names that its own can't clash with."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: The columns of documents that operators read.
KNOWN = ("doc_id", "text", "source", "lang", "n_chars")


def hidden(docs: DataFrame, known: tuple[str, ...] = KNOWN) -> DataFrame:
    """``docs`` with every column but ``known`` named by its place; ``toDF(*docs.columns)`` gives the names back."""
    return docs.toDF(*[c if c in known else f"other_{i}_" for i, c in enumerate(docs.columns)])
