"""What both vector operators need: which vectors take part."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def usable(v: str, zero: bool) -> Column:
    """Whether the array column is not null and not empty and holds finite numbers only; zero: whether zero vectors pass."""
    fine = F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf"))), F.lit(False)) & (F.size(v) > 0)
    return fine if zero else fine & F.exists(v, lambda x: x != 0)
