"""Chapter tables: filters, keys, pairing, statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X


def is_chapter(name: str = "file_name") -> Column:
    return ~F.startswith(F.col(name), F.lit("00_")) & ~F.contains(F.col(name), F.lit("_report"))


def key_of(name: str = "file_name") -> Column:
    """Leading digits, compared as text; empty if there are none (our decision: ASCII digits)."""
    return F.regexp_extract(name, "^([0-9]+)_", 1)


def chapters(files: DataFrame) -> DataFrame:
    return files.where(is_chapter())


def numbered(files: DataFrame) -> DataFrame:
    return chapters(files).where(key_of() != "")


def first_by_key(translated: DataFrame) -> DataFrame:
    """One file for each key: the smallest name (the order of a directory is not defined). The translated side keeps reports."""
    w = Window.partitionBy("key").orderBy("file_name")
    keyed = translated.withColumn("key", key_of()).where("key <> ''")
    return keyed.withColumn("_n", F.row_number().over(w)).where("_n = 1").select("key", F.col("file_name").alias("translated_file"), F.col("content").alias("translated"))


def pairs(original: DataFrame, translated: DataFrame) -> DataFrame:
    """key, original_file, original, translated_file, translated of chapters that have a translation."""
    left = numbered(original).select(key_of().alias("key"), F.col("file_name").alias("original_file"), F.col("content").alias("original"))
    return left.join(first_by_key(translated), "key")


def sample_first(original: DataFrame, n: int = 3) -> DataFrame:
    """The first n files by name, filtered afterwards."""
    return original.orderBy("file_name").limit(n).where(is_chapter()).where(key_of() != "")


def stats(paired: DataFrame) -> DataFrame:
    o, t = F.col("original"), F.col("translated")
    return paired.select(
        F.expr("try_cast(key as bigint)").alias("chapter_num"),
        F.regexp_replace("original_file", r"\.[^.]+$", "").alias("chapter_title"),
        "original_file", "translated_file",
        F.length(o).cast("long").alias("original_chars"), F.length(t).cast("long").alias("translated_chars"),
        X.words(o).alias("original_words"), X.words(t).alias("translated_words"),
    )
