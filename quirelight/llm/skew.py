"""Joins of very many rows with a table of one row per key, where a few keys may hold most of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Keys that hold more than this share of the rows go another way: there are at most as many of them, whatever the data.
SHARES = 200


def spread_join(rows: DataFrame, table: DataFrame, key: str, weight: str) -> DataFrame:
    """rows joined (inner) with table, whose column weight says how many rows a key has.

    Frequent keys, at most SHARES, are broadcast and their rows stay where they are; only the rows of the others are shuffled.
    Both should be written tables, as they are read twice.
    """
    total = table.agg(F.sum(weight)).first()[0] or 0
    often = F.broadcast(table.where(F.col(weight) * SHARES > total))
    rest = rows.join(often.select(key), key, "left_anti").join(table.where(F.col(weight) * SHARES <= total), key)
    return rows.join(often, key).unionByName(rest)
