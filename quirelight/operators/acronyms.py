"""Technical terms found in texts, not listed: acronyms and what they stand for, and categories from the words around a term.

An acronym in brackets after its expansion, or before it in brackets, is aligned with the initials of the words beside it: as many words as letters, or more by small words
that an expansion may skip. Other terms get a category from the nouns that stand right behind them ("the Foo framework"), by majority over the corpus.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Words that have no letter in an acronym. Fixed values.
SMALL = "of the and for in a to on".split()
PATTERN = r"((?:[A-Za-z][A-Za-z0-9-]*[ \t]+){2,12})\(([A-Z]{2,8})\)"
REVERSED = r"\b([A-Z]{2,8})[ \t]+\(((?:[A-Za-z][A-Za-z0-9-]*[ \t]*){2,12})\)"
#: The noun behind a term, and the category it speaks for. Fixed values.
NOUNS = {"framework": "framework", "library": "framework", "language": "language", "protocol": "protocol", "model": "model", "algorithm": "algorithm", "database": "system", "server": "system", "class": "class", "interface": "class", "license": "license"}


def _significant(words: str) -> str:
    small = ", ".join(f"'{w}'" for w in SMALL)
    return f"filter({words}, w -> lower(w) not in ({small}))"


def pairs(rows: DataFrame) -> DataFrame:
    """acronym, expansion, n_texts of the acronyms that (id, text) explain, in either order, by the number of texts.

    The initials of the last words before the bracket (small words skipped, unless they are needed) must be the acronym's letters, in order.
    """
    first = rows.select("id", F.explode(F.arrays_zip(F.regexp_extract_all("text", F.lit(PATTERN), F.lit(1)).alias("words"), F.regexp_extract_all("text", F.lit(PATTERN), F.lit(2)).alias("acronym"))).alias("m"))
    second = rows.select("id", F.explode(F.arrays_zip(F.regexp_extract_all("text", F.lit(REVERSED), F.lit(2)).alias("words"), F.regexp_extract_all("text", F.lit(REVERSED), F.lit(1)).alias("acronym"))).alias("m"))
    found = first.withColumn("behind", F.lit(False)).unionByName(second.withColumn("behind", F.lit(True))).select("id", "behind", F.col("m.acronym").alias("acronym"), F.expr("filter(split(m.words, '[ \\t]+'), w -> w <> '')").alias("words"))
    # the shortest run of words next to the bracket whose significant initials spell the acronym
    initials = "upper(array_join(transform({0}, w -> left(w, 1)), ''))"
    run = "if(behind, words, slice(words, greatest(1, size(words) - n + 1), least(n, size(words))))"
    fits = f"case when {initials.format(run)} = acronym or {initials.format(_significant(run))} = acronym then array_join({run}, ' ') end"
    spelled = f"get(filter(transform(sequence(2, greatest(2, size(words))), n -> {fits}), x -> x is not null), 0)"
    each = found.withColumn("expansion", F.lower(F.expr(spelled))).where("expansion is not null")
    return each.groupBy("acronym", "expansion").agg(F.count_distinct("id").alias("n_texts"))


def categorised(rows: DataFrame, at_least: int = 1) -> DataFrame:
    """term, category, votes, total: capitalised names that stand before a noun of NOUNS in (id, text), with the category most of their places speak for; ties go to the first by name."""
    nouns = "|".join(NOUNS)
    pattern = rf"\b([A-Z][A-Za-z0-9+#.-]*[A-Za-z0-9+#])[ \t]+((?i:{nouns}))\b"
    table = F.create_map(*(F.lit(x) for kv in NOUNS.items() for x in kv))
    hits = rows.select(F.explode(F.arrays_zip(F.regexp_extract_all("text", F.lit(pattern), F.lit(1)).alias("term"), F.regexp_extract_all("text", F.lit(pattern), F.lit(2)).alias("noun"))).alias("m"))
    votes = hits.groupBy(F.col("m.term").alias("term"), table[F.lower("m.noun")].alias("category")).agg(F.count("*").alias("votes"))
    best = Window.partitionBy("term").orderBy(F.desc("votes"), "category")
    ranked = votes.withColumn("total", F.sum("votes").over(Window.partitionBy("term"))).withColumn("k", F.row_number().over(best))
    return ranked.where(F.col("k") == 1).where(F.col("votes") >= at_least).select("term", "category", "votes", "total")
