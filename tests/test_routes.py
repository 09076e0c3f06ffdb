"""Routes of texts without a letter or without text, against the SQL."""

from __future__ import annotations

import math
import re

from pyspark.sql import functions as F

from quirelight import queries as Q
from quirelight.functions.lexicon import TERMS
from quirelight.operators import enhance as E
from quirelight.operators import listening as H

BLANK = ["", " ", " \t\n\r\x0b\x0c\x1c\x1f\x85\xa0 　"]
SHOWN = ["日本", "ab 日本 c", "日 abcdefg", "𠀀日😀", "String", "x " * 30 + "String Map", "x " * 9 + "class", "plain words alone", "​"]


def test_blank_texts_are_routed_as_in_sql(spark, tmp_path):
    import duckdb

    rows = list(enumerate([None, *BLANK, *SHOWN]))
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = sorted(con.execute(Q.ORACLES["translation_route"]).fetchall())
    assert len(want) == len(rows) and {r[1] for r in want} == {"skip", "translate", "translate_protected"}
    assert sorted(map(tuple, Q.QUERIES["translation_route"](spark, str(tmp_path)).collect())) == want


def test_ratio_of_blank_chapters_is_no_number(spark):
    files = spark.createDataFrame([(str(k), t) for k, t in enumerate([*BLANK, None, "日a b"])], "file_name string, content string")
    got = [r[0] for r in files.select(E.chinese_ratio(F.col("content"))).collect()]
    assert all(map(math.isnan, got[:3])) and got[3:] == [None, 1 / 3]
    assert [r["route"] for r in H.routed(files).orderBy("file_name").collect()] == ["skip"] * 3 + ["translate", "skip"]
    assert [r[0] for r in files.select(E.language_gate(E.chinese_ratio(F.col("content")))).collect()] == ["skip"] * 3 + ["mixed"] * 2


def test_ratio_and_density_are_computed_once(spark):
    plan = Q.QUERIES["translation_route"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    for term in (t for t in TERMS if t.islower()):
        assert len(re.findall(rf"Contains\(text#\d+, {term}\)", plan)) == 1
