"""A corpus pipeline of five stages over documents: language, near duplicates, personal data, mixture, packing."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirelight.llm import stage
from quirelight.llm.language_id import OUT as PREDICTED
from quirelight.llm.language_id import SYMBOLS, fit, predict
from quirelight.llm.mixing import OUT as MIXED
from quirelight.llm.mixing import mix
from quirelight.llm.ngram_join import folded, ngram_jaccard_join
from quirelight.llm.packing import pack_documents
from quirelight.llm.pii import sanitise
from quirelight.llm.queries import _word_bpe

#: Share of the tokens that the mixture keeps.
BUDGET = 0.8


def hidden(docs: DataFrame, names: tuple[str, ...]) -> tuple[DataFrame, dict[str, str]]:
    """docs with columns that are named as an operator's own under other names, and the way back: their values are not the operator's."""
    clash = {c: f"__kept_{k}" for k, c in enumerate(docs.columns) if c.lower() in names}
    return docs.withColumnsRenamed(clash), {v: k for k, v in clash.items()}


def free(docs: DataFrame, name: str) -> str:
    """name, with as many underscores behind it as make it no column of docs."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages learned from the labelled rows; lang becomes the predicted one.

    Rejected: texts that are null or have no letter, and texts that no language's model codes below the uniform code.
    """
    rows, back = hidden(docs, PREDICTED)
    out = predict(rows, fit(docs), [c for c in rows.columns if c != "lang"])
    out = out.where("lang_pred <> 'und'").where(F.col("bits_per_byte") < math.log2(SYMBOLS))
    out = out.drop("score", "bits_per_byte").withColumnRenamed("lang_pred", "lang")
    return out.withColumnsRenamed(back).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of documents with alike shingles, the one with the smallest doc_id.

    Rows that repeat a doc_id are one document: of the kept id's rows one stays, of different texts the one with the smallest MD5.
    Rows without a doc_id belong to no component and stay.
    """
    cls = free(docs, "text_class")
    found = ngram_jaccard_join(docs, width=5, percent=75).where("doc_id = component_id")
    kept = found.groupBy("doc_id").agg(F.count("*").alias("rows"), F.min("text_class").alias(cls))
    kept = stage.written(spark, kept, "kept")
    once = docs.join(kept.where("rows = 1").select("doc_id"), "doc_id", "left_semi")
    # a repeated id: its rows with the chosen text, of which any stands for the others
    text = F.md5(folded(F.coalesce("text", F.lit(""))))
    rows = docs.withColumn(cls, text).join(kept.where("rows > 1").select("doc_id", cls), ["doc_id", cls], "left_semi")
    own = [F.col(f"`{c}`") for c in docs.columns]
    several = rows.groupBy("doc_id").agg(F.min_by(F.struct(*own), F.xxhash64(*own)).alias("row")).select("row.*")
    return once.select(*docs.columns).unionByName(several).unionByName(docs.where("doc_id is null"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data and what reveals it replaced."""
    rows, back = hidden(docs, ("spans", "sanitised"))
    out = sanitise(rows).withColumn("text", F.col("sanitised")).drop("spans", "sanitised")
    return out.withColumn("n_chars", F.length("text").cast("long")).withColumnsRenamed(back).select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents sampled so that tokens meet the target marginals of source, language and topic.

    The draw goes by doc_id: rows without one, which the stages before keep, cannot be drawn and go here.
    """
    rows, back = hidden(docs, MIXED)
    return mix(rows, budget=BUDGET).where("kept").drop(*MIXED).withColumnsRenamed(back).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, packed into sequences of 2048 tokens."""
    return pack_documents(docs, _word_bpe, size=2048)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("personal_data", personal_data), ("mixture", mixture), ("packing", packing)]

#: Language models, trees and packing have no SQL form; the tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with stage.temporary(spark):  # only the last stage's table stays
        for name, step in STAGES:
            docs = stage.written(spark, step(spark, docs, sf_dir), name)
    return docs
