"""Joins in which a few keys may hold most of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key with more than this share of the rows goes another way; there are fewer of them than its inverse.
SHARE = 0.005


def join_frequent(rows: DataFrame, table: DataFrame, key: str, weight: str, share: float = SHARE) -> DataFrame:
    """rows joined (inner) with table (one row a key), whose column weight is the key's number of rows.

    Frequent keys' rows of the table are broadcast (fewer than 1 / share), so their rows are not moved; the others are shuffled.
    """
    total = table.agg(F.coalesce(F.sum(weight), F.lit(0))).first()[0]
    frequent = F.broadcast(table.where(F.col(weight) > total * share))
    return rows.join(frequent, key).unionByName(rows.join(frequent.select(key), key, "left_anti").join(table.where(F.col(weight) <= total * share), key))
