"""Queries whose time grew too fast with the texts: the results on odd rows, and that costly steps are planned once."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from quirelight.functions.lexicon import TERMS
from quirelight.operators import dictionary, listening, paragraphs

SF = "/root/testdata/sf0.001"


def plan_of(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("few", [dictionary.FEW, 1, 3])
def test_dictionary_searches_each_different_word_once(spark, monkeypatch, few):
    monkeypatch.setattr(dictionary, "FEW", few)
    texts = ["over " * 50, "x" * 200 + "needle" + "y" * 200, "the needle", "q" * 61 + "abcdefg" + "q" * 300, "  a \t\n b", "日本語のtext 日本", "", None, "needleneedle x.y"]
    terms = ["needle", "abcdefg", "he", "x", "日本語の", "e n", "\t\n", "  ", "the needle", "a \t", "x.y", "absent", "", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = dictionary.terms_in(rows, spark.createDataFrame([(t,) for t in terms], "term string"))
    assert sorted((r["id"], r["term"]) for r in got.collect()) == sorted((i, t) for i, x in enumerate(texts) for t in terms if x and t and t in x)
    # no text is moved to verify terms of one word
    assert "Contains(text" not in plan_of(dictionary.terms_in(rows, spark.createDataFrame([("needle",)], "term string")))


def test_terms_of_a_paragraph_are_looked_for_once(spark):
    plan = plan_of(entry.queries()["route_paragraphs"](spark, SF))
    assert 0 < plan.count("Contains(line") < len(TERMS)


def test_ratio_and_tokens_of_odd_texts(spark):
    texts = ["", " \t\u3000\n", "日本語", "ab 日本 c", "x", "\u00a0é日\u2003", "𠀀日"]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").select("text", paragraphs._ratio(F.col("text")).alias("ratio"), paragraphs.tokens(F.col("text")).alias("tokens"))
    wide = lambda t: sum("\u4e00" <= c <= "\u9fff" for c in t)
    shown = lambda t: len("".join(t.split()))
    assert [(r["ratio"], r["tokens"]) for r in rows.collect()] == [(wide(t) / shown(t) if shown(t) else 0.0, wide(t) + -(-(len(t) - wide(t)) // 3)) for t in texts]


def test_the_report_aligns_both_editions_once(spark):
    plan = plan_of(entry.queries()["verification_template"](spark, SF))
    # one fold of the costs and one back along the steps
    assert plan.count("aggregate(sequence(1") == 2


def test_lines_read_are_counted_without_being_made(spark):
    long = "word " * 30
    texts = ["", "short. two.\n\n  \n", long, long + ".", long + "。！" + long + "?! " + long, ". " * 60, "。" * 100, "x" * 80, "x" * 81 + ". ", "\u00a0\n" + long + " \u3000.\u3000\n" + long]
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    got = rows.select(listening.lines_read(F.col("text")).alias("n"), F.size(listening.long_sentences(F.col("text"))).alias("made")).collect()
    assert [r["n"] for r in got] == [r["made"] for r in got]
    assert "flatten(" not in plan_of(entry.queries()["run_counters"](spark, SF))


def test_issues_of_chapters_are_found_once(spark):
    plan = plan_of(entry.queries()["chapter_report_lines"](spark, SF))
    # statistics and issues, each of one pairing of both editions
    assert plan.count("Relation [") == 4


def test_base_columns_of_personal_data_are_those_of_the_operator_without_its_tables(spark):
    from quirelight.llm import stage

    queries, before = entry.queries(), len(stage._WRITTEN)
    base = queries["pii_base"](spark, SF)
    assert len(stage._WRITTEN) == before
    whole = queries["op4_pii"](spark, SF).drop("spans")
    assert base.schema == whole.schema and sorted(map(tuple, base.collect())) == sorted(map(tuple, whole.collect()))
