"""Routing at two levels and batches under a budget: what goes to a translator, and in which calls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from . import enhance as E
from .toc import lines


def _wide(text: Column) -> Column:
    """The number of ideographs, by what is left without them: matches are runs, not letters."""
    return (F.length(text) - F.length(F.regexp_replace(text, r"[\x{4E00}-\x{9FFF}]+", ""))).cast("long")


def tokens(text: Column) -> Column:
    """About the tokens of a text: ideographs, and a third of the other letters, rounded up (our decision)."""
    wide = _wide(text)
    return wide + F.ceil((F.length(text) - wide) / 3).cast("long")


def _ratio(text: Column) -> Column:
    """Share of ideographs, 0 of a text that is blank."""
    shown = F.length(F.regexp_replace(text, rf"{X.WS}+", ""))
    return F.coalesce(_wide(text).cast("double") / F.nullif(shown, F.lit(0)), F.lit(0.0))


def route_paragraphs(rows: DataFrame, terms: list[str]) -> DataFrame:
    """id, place, text, gate, route, tokens of the paragraphs (lines that are not blank) of (id, text).

    The gate looks at the whole text: it is skipped or translated as a whole, or mixed. Only a mixed text's paragraphs are routed one by one,
    by their own ratio and density of terms; in a text that is translated, a paragraph with many terms still keeps them.
    """
    rated = rows.where("text is not null").select("id", "text", _ratio(F.col("text")).alias("ratio"))
    gated = rated.select("id", "text", E.language_gate(F.col("ratio")).alias("gate"))
    each = lines(gated, "gate").where(X.strip(F.col("line")) != "")
    # columns of their own: inside one expression each would be computed wherever it is compared
    each = each.withColumn("ratio", _ratio(F.col("line"))).withColumn("density", E.term_density(F.col("line"), terms))
    each = each.withColumn("own", E.route(F.col("ratio"), F.col("density")))
    own = F.col("own")
    # a density that would skip a paragraph of a text to be translated only protects its terms
    route = F.when(F.col("gate") == "skip", "skip").when(F.col("gate") == "mixed", own).otherwise(F.when(own == "translate", own).otherwise("translate_protected"))
    return each.select("id", "place", F.col("line").alias("text"), "gate", route.alias("route"), tokens(F.col("line")).alias("tokens"))


def batched(paragraphs: DataFrame, budget: int) -> DataFrame:
    """paragraphs with batch (from 0, by id; null if the route skips them): runs of paragraphs of one text whose tokens fit a call.

    The running sum of tokens before a paragraph, in whole budgets, numbers the batches. A batch holds less than twice the budget, a paragraph beyond it alone more.
    """
    sent = F.startswith("route", F.lit("translate"))
    before = Window.partitionBy("id").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    held = F.coalesce(F.sum(F.when(sent, F.col("tokens")).otherwise(0)).over(before), F.lit(0))
    return paragraphs.withColumn("batch", F.when(sent, F.floor(held / budget)))
