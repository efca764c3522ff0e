"""A join for keys of very uneven weight."""

from __future__ import annotations

from pyspark.sql import DataFrame


def lookup_join(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """Left join of ``rows`` with a table that has each ``key`` once; rows without an answer are kept.

    Only ``rows`` can be skewed, which is the side that adaptive execution splits in a left join, so rows that share a
    hot key are dealt over many tasks and the answers need no copies.
    """
    return rows.join(table, key, "left")
