"""Chapters of documents whose ids have more than five digits."""

from __future__ import annotations

from quirelight.fixtures import editions
from quirelight.operators import chapters


def test_long_ids_keep_their_own_chapters(spark, tmp_path):
    ids = [7, 12345, *range(100001, 100010), 1000001]
    spark.createDataFrame([(i, f"text {i}") for i in ids], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    original, translated = editions(spark, str(tmp_path))
    names = {r["doc_id"]: (r["chapter_key"], r["file_name"]) for r in original.collect()}
    assert names[7] == ("00007", "00007_ch.md") and names[12345] == ("12345", "12345_ch.md") and names[1000001] == ("1000001", "1000001_ch.md")
    assert {r["file_name"] for r in translated.collect()} == {f"{i:05d}_zh.md" for i in ids if i % 11}
    rows = chapters.pairs(original, translated).collect()
    want = {f"{i:05d}" for i in ids if i % 11 and i % 97 and i % 89}
    assert {r["key"] for r in rows} == want and len(rows) == len(want)
    assert all(f"public class A{int(r['key'])} " in r["original"] and f"# 条目 {int(r['key'])}\n" in r["translated"] for r in rows)
