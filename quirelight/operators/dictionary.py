"""Substring join of texts with a dictionary of any size, through the different words of the texts.

A word is a run of characters that are not white space (or of white space, if a term is blank). A term of one run can only be in a text that has it in a word, so
each different word of all texts is searched once, however many texts hold it: terms are filed under their rarest gram (substrings of GRAM letters; a shorter
term is its own gram), an equi-join finds the words that hold the gram, and these are verified. A term of several runs is filed by its longest one and verified
against the texts that hold that. Nothing is compared pair by pair.

Rarity is counted over the dictionary: a gram that very many terms have is a term's only if all its grams are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .joins import join_frequent
from .staged import written

GRAM = 4
#: Grams of a dictionary, and words with terms, below which they are broadcast; more of them are joined by a shuffle.
FEW = 200_000
#: Letters of a word from which grams are taken at once.
PIECE = 64


def _grams(text: Column, n: int) -> Column:
    """The substrings of n letters, at every place: a look-ahead takes them in one pass."""
    return F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1))


def _keyed(terms: DataFrame) -> DataFrame:
    """term, key of each different term: the first of its longest words, of a blank term itself."""
    words = F.regexp_extract_all("term", F.lit(r"\S+"), F.lit(0))
    longest = F.array_sort(F.transform(words, lambda w, i: F.struct((-F.length(w)).alias("n"), i.alias("i"), w.alias("w"))))
    rows = terms.select("term").where("term is not null and term <> ''").distinct()
    return rows.select("term", F.coalesce(F.get(longest, F.lit(0))["w"], "term").alias("key"))


def _of_keys(keyed: DataFrame) -> DataFrame:
    """key, gram of each different key."""
    grams = F.when(F.length("key") >= GRAM, _grams(F.col("key"), GRAM)).otherwise(F.array("key"))
    return keyed.select("key").distinct().select("key", F.explode(F.array_distinct(grams)).alias("gram"))


def _filed(grams: DataFrame) -> DataFrame:
    """key, gram: each key under the gram that the fewest keys have; of equally rare ones under the smallest."""
    rarity = grams.groupBy("gram").agg(F.count("*").alias("n"))
    return grams.join(rarity, "gram").groupBy("key").agg(F.min(F.struct("n", "gram")).alias("best")).select("key", "best.gram")


def _of_texts(rows: DataFrame, blank: bool) -> DataFrame:
    """id, word of the different words of each text. The outer form keeps the array from being computed twice, once to filter and once to unfold."""
    words = F.array_distinct(F.regexp_extract_all("text", F.lit(r"\S+|\s+" if blank else r"\S+"), F.lit(0)))
    return rows.select("id", F.explode_outer(words).alias("word")).where("word is not null")


def _holding(words: DataFrame, index: DataFrame, lengths: list[int], few: bool) -> DataFrame:
    """word, n_texts, key: each different word of (id, word) with each key that it holds and its number of rows. index: (key, gram).

    substring() walks from the start, so grams are taken from pieces of PIECE letters, which overlap by a gram.
    """
    piece = F.when(F.length("word") <= PIECE, F.array("word")).otherwise(F.regexp_extract_all("word", F.lit(f"(?s)(?=(.{{1,{PIECE + GRAM - 1}}})).{{1,{PIECE}}}"), F.lit(1)))
    each = words.groupBy("word").agg(F.count("*").alias("n_texts")).select("word", "n_texts", F.explode_outer(piece).alias("piece"))
    each = each.select("word", "n_texts", "piece", F.explode_outer(F.sequence(F.lit(1), F.length("piece"))).alias("at"))
    here = F.array(*(F.when(F.col("at") + n - 1 <= F.length("piece"), F.substring("piece", F.col("at"), F.lit(n))) for n in lengths))
    each = each.select("word", "n_texts", F.explode_outer(here).alias("gram")).where("gram is not null")
    return each.join(F.broadcast(index) if few else index, "gram").where(F.contains("word", F.col("key"))).select("word", "n_texts", "key").distinct()


def terms_in(texts: DataFrame, terms: DataFrame) -> DataFrame:
    """id, term of each term that is a substring of a text. texts: (id unique, text); terms: (term), repeats and empty or null ones count for nothing.

    Null ids and texts take no part.
    """
    rows = texts.where("id is not null and text is not null").select("id", "text")
    keyed = _keyed(terms)
    grams = _of_keys(keyed)
    sizes = grams.agg(F.collect_set(F.length("gram")).alias("lengths"), F.count("*").alias("n")).first()
    kinds = keyed.agg(F.max(~F.col("key").rlike(r"\S")).alias("blank"), F.max(F.col("term") != F.col("key")).alias("several")).first()
    if not sizes["lengths"]:
        return rows.select("id", F.lit("").alias("term")).limit(0)
    words = _of_texts(rows, kinds["blank"])
    held = written(_holding(words, _filed(grams), sorted(sizes["lengths"]), sizes["n"] < FEW), "words")
    # most texts' words are few different ones: these are broadcast, fewer than FEW of them, and only rare ones are moved
    hits = words.join(F.broadcast(held), "word") if held.count() < FEW else join_frequent(words, held, "word", "n_texts", 1 / FEW)
    # a text's rows follow each other, so its terms are gathered before the shuffle
    found = hits.groupBy("id").agg(F.collect_set("key").alias("terms")).select("id", F.explode("terms").alias("term"))
    if not kinds["several"]:
        return found
    whole = found.join(keyed.where("term = key").select("term"), "term", "left_semi")
    parts = found.withColumnRenamed("term", "key").join(keyed.where("term <> key"), "key").select("id", "term")
    return whole.select("id", "term").unionByName(rows.join(parts, "id").where(F.contains("text", F.col("term"))).select("id", "term"))


def lost_terms(paired: DataFrame, terms: DataFrame) -> DataFrame:
    """key, term of each term of an original that its translation does not hold."""
    found = terms_in(paired.select(F.col("key").alias("id"), F.col("original").alias("text")), terms)
    rows = paired.select(F.col("key").alias("id"), "translated").join(found, "id")
    return rows.where(~F.contains("translated", F.col("term"))).select(F.col("id").alias("key"), "term")
