"""Quirks of the audits, golden cases, and every query of the audit against its SQL."""

from __future__ import annotations

import zipfile

import pytest

from quirelight import queries as Q
from quirelight.functions.lexicon import IDENTIFIERS, TERMS
from quirelight.operators import chapters as C
from quirelight.operators import checks as K
from quirelight.operators import enhance as E
from quirelight.sources.files import read_archives, read_chapters, read_epub, write_epub

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    return f"{v:.9g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(Q.ORACLES))
def test_equals_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    cur = con.execute(Q.ORACLES[name])
    cols = [c[0] for c in cur.description]
    want = sorted(tuple(plain(r[cols.index(c)]) for c in sorted(cols)) for r in cur.fetchall())
    df = Q.QUERIES[name](spark, SF)
    assert sorted(df.columns) == sorted(cols)
    assert sorted(tuple(plain(r[c]) for c in sorted(cols)) for r in df.collect()) == want


def files(spark, rows):
    return spark.createDataFrame(rows, "file_name string, content string")


def test_dictionaries():
    assert len(TERMS) == len(set(TERMS)) == 116 and len(IDENTIFIERS) == 27 and IDENTIFIERS.count("valueOf") == 2


def test_limit_comes_before_filter(spark):
    o = files(spark, [(f"0{k}_x.md", "") for k in range(5)])
    assert [r[0] for r in C.sample_first(o).select("file_name").collect()] == ["01_x.md", "02_x.md"]


def test_keys_are_text_and_reports_stay_on_the_translated_side(spark):
    o = files(spark, [("1_a.md", "String"), ("01_b.md", "String"), ("intro.md", "")])
    t = files(spark, [("01_z.md", "x"), ("01_a_report.md", "y")])
    got = C.pairs(o, t).select("original_file", "translated_file").collect()
    assert [tuple(r) for r in got] == [("01_b.md", "01_a_report.md")]
    assert K.chapter_totals(o, t).first()[:] == (3, 1)


def test_terms_are_substrings_and_identifiers_have_boundaries(spark):
    o = files(spark, [("01_a.md", "SCRIPT ArrayList valueOf")])
    t = files(spark, [("01_t.md", "调用valueOf方法")])
    p = C.pairs(o, t)
    assert {r["original"] for r in K.missing_terms(p).collect()} == {"IP", "ArrayList", "List"}
    rows = [r for r in K.identifier_check(p).collect() if r["original"] == "valueOf"]
    assert [r["status"] for r in rows] == ["FAIL", "FAIL"]


def test_missing_folders_pass(spark):
    empty = files(spark, [])
    assert K.chapter_mapping(empty, empty).first()["status"] == "PASS"


def test_title_is_not_doubled(spark):
    from pyspark.sql import functions as F

    d = spark.createDataFrame([("# T\nx",), ("x",), ("#T\n",)], "c string")
    got = [r[0] for r in d.select(E.dedupe_title(F.col("c"), F.lit("T"))).collect()]
    assert got == ["# T\nx", "# T\n\nx", "#T\n"]


def test_files_and_books(spark, tmp_path):
    (tmp_path / "md").mkdir()
    (tmp_path / "md" / "02_b c.md").write_bytes(b"x\r\ny\rz")
    (tmp_path / "md" / "01_a.md").write_text("é")
    (tmp_path / "md" / "n.txt").write_text("no")
    got = [tuple(r) for r in read_chapters(spark, str(tmp_path / "md")).collect()]
    assert got == [("01_a.md", "é"), ("02_b c.md", "x\ny\nz")]
    write_epub(files(spark, [("02.md", "<p>b</p>"), ("01.md", "<p>a</p>")]), str(tmp_path / "b.epub"), "T", "A", b"png")
    book = read_epub(spark, str(tmp_path)).orderBy("ord").collect()
    assert [(r["title"], r["author"], "<p>a</p>" in r["content"]) for r in book] == [("T", "A", True), ("T", "A", False)]
    entries = read_archives(spark, str(tmp_path)).select("archive", "ord", "name")
    assert [r["name"] for r in E.cover_pick(entries).collect()] == ["OEBPS/cover.png"]
    assert zipfile.ZipFile(tmp_path / "b.epub").namelist()[0] == "mimetype"


def test_golden_cases_of_code_and_keywords(spark):
    from pyspark.sql import functions as F

    from quirelight.operators import listening as H

    code = "void work_thread_routine(){\nTask t = TaskQueue.pop();\nServiceConnection c = CPool.GetServiceConnection();\nc.Send(packet);\n}"
    text = f"工作线程的典型工作流伪代码是这样的：\n{code}\n\n获取Service连接的CPool.GetServiceConnection()返回任何一个可用Service连接。"
    got = H.enhance_code(files(spark, [("1.md", text), ("2.md", "CPool.GetServiceConnection(long id)\nServiceConnection\nList<String>\nMAX_SIZE"), ("3.md", f"```java\n{code}\n```")])).orderBy("file_name").collect()
    assert got[0]["content"] == f"工作线程的典型工作流伪代码是这样的：\n\n```java\n{code}\n```\n\n获取Service连接的`CPool.GetServiceConnection()`返回任何一个可用Service连接。"
    assert got[1]["content"] == "`CPool.GetServiceConnection(long id)`\n`ServiceConnection`\n`List<String>`\n`MAX_SIZE`" and got[1]["keywords_highlighted"] == 4
    assert got[2]["content"] == f"```java\n{code}\n```" and got[2]["code_blocks_wrapped"] == 0
    assert H.run_counters(files(spark, [("1.md", text)])).first()["code_blocks_wrapped"] == 1
    assert files(spark, [("1", "* a\n#T\n\n\n\n```\nx  ")]).select(H.clean_format(F.col("content"))).first()[0] == "- a\n# T\n\n```\nx\n```"


def upper():
    """A provider that fails on one word; made here, so that it travels by value."""

    def call(requests):
        if any("boom" in x for x in requests):
            raise RuntimeError("the model is away")
        return [x.upper() for x in requests]

    return call


def test_translation_keeps_code_and_terms_and_falls_back(spark):
    from pyspark.sql import functions as F

    from quirelight.operators import providers as V

    rows = spark.createDataFrame([(1, "Item 3: use `code` and ArrayList here", "translate"), (2, "boom", "translate"), (3, "keep", "skip"), (4, None, "translate")], "id int, text string, route string")
    got = {r["id"]: r["translated"] for r in V.translate(rows.repartition(4, "id"), upper(), F.col("route"), ["ArrayList"]).collect()}
    assert got == {1: "Item 3: USE `code` AND ArrayList HERE", 2: "boom", 3: "keep", 4: None}
    off = V.translate(rows, upper(), F.col("route"), [], enabled=False).collect()
    assert [r["translated"] for r in off if r["id"] == 1] == ["Item 3: use `code` and ArrayList here"]
    images = spark.createDataFrame([("diagram",), ("x",)], "name string")
    assert [r["image_class"] for r in V.classify_images(images, upper()).orderBy("name").collect()] == ["DIAGRAM", "OTHER"]
    assert V.ask(images, "name", V.Echo("> ")).where("answer = concat('> ', name) and answered").count() == 2


def test_a_compatible_server_answers(spark):
    import http.server
    import json
    import threading

    from quirelight.operators import providers as V

    class Answer(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            asked = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            body = json.dumps({"choices": [{"message": {"content": asked["model"] + ":" + asked["messages"][-1]["content"]}}]}).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *args):
            pass

    server = http.server.HTTPServer(("127.0.0.1", 0), Answer)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    rows = spark.createDataFrame([("a",), ("b",)], "x string")
    got = V.ask(rows, "x", V.ChatEndpoint(f"http://127.0.0.1:{server.server_port}/v1", "m", "k")).orderBy("x").collect()
    server.shutdown()
    assert [r["answer"] for r in got] == ["m:a", "m:b"]


PNG = b"\x89PNG\r\n\x1a\n\0\0\0\rIHDR" + (640).to_bytes(4, "big") + (480).to_bytes(4, "big")


def test_folders_covers_images_and_writers(spark, tmp_path):
    from quirelight.sources import files as S

    box = tmp_path / "box"
    box.mkdir()
    (box / "02_b.md").write_text("two")
    write_epub(files(spark, [("01.md", "<p>a</p>"), ("02.md", "<p>b</p>")]), str(box / "book.epub"), "T", "A", PNG)
    got = [(r["kind"], r["file_name"], r["ord"]) for r in S.read_folder(spark, str(box)).collect()]
    assert got == [("markdown", "02_b.md", 0), ("epub", "book.epub", 0), ("epub", "book.epub", 1)]
    assert S.epub_metadata(spark, str(box)).first()["chapters"] == 2
    assert [(r["width"], r["height"]) for r in S.read_epub_images(spark, str(box)).collect()] == [(640, 480)]
    entries = read_archives(spark, str(box))
    picked = S.cover_or_package(entries, E.cover_pick(entries.select("archive", "ord", "name")))
    assert S.write_cover(picked, str(tmp_path / "cover.png")) and (tmp_path / "cover.png").read_bytes() == PNG
    write_epub(files(spark, [("01.md", "x")]), str(tmp_path / "bare.epub"), "T", "A")
    entries = read_archives(spark, str(tmp_path / "bare.epub"))
    picked = S.cover_or_package(entries, E.cover_pick(entries.select("archive", "ord", "name")))
    assert picked.first()["excerpt"].startswith("<?xml") and not S.write_cover(picked, str(tmp_path / "none.png"))
    S.write_chapters(files(spark, [("a_1.md", "é"), ("b.md", "")]), str(tmp_path / "out" / "deep"))
    assert sorted((p.name, p.read_text()) for p in (tmp_path / "out" / "deep").iterdir()) == [("a_1.md", "é"), ("b.md", "")]
    (tmp_path / "out" / "deep" / "x.png").write_bytes(PNG)
    (tmp_path / "out" / "y.PNG").write_bytes(PNG)
    assert [tuple(r) for r in S.read_image_files(spark, str(tmp_path / "out")).collect()] == [("x.png", len(PNG))]
    sizes = {S._size(x) for x in (b"GIF89a" + (3).to_bytes(2, "little") + (4).to_bytes(2, "little"), b"\xff\xd8\xff\xc0\0\x11\x08\0\x05\0\x06", b"no", None)}
    assert sizes == {(3, 4), (6, 5), (None, None)}


def test_command_line(spark, tmp_path, capsys):
    from quirelight.cli import main

    for side, text in (("o", "# A\nString"), ("t", "# 甲\n字符串")):
        (tmp_path / side).mkdir()
        (tmp_path / side / "01_a.md").write_text(text)
    assert main(["issues", str(tmp_path / "o"), str(tmp_path / "gone")]) == 1 and "Translated directory not found" in capsys.readouterr().err
    report = tmp_path / "r.md"
    assert main(["issues", str(tmp_path / "o"), str(tmp_path / "t"), str(report)]) == 0
    lines = report.read_text().splitlines()
    assert lines[0] == "# EPUB Quality Comparison Report" and "### Technical_Term Issues (1)" in lines and "### Chapter 1: 01_a" in lines and '  - [high] Technical term "String" not preserved in translation' in lines
    assert main(["verify", str(tmp_path / "o"), str(tmp_path / "t"), str(report)]) == 0
    assert "### 章节结构" in report.read_text() and "## 总结" in report.read_text() and "pass" in capsys.readouterr().out


def test_sample_is_deterministic(spark):
    first, again = (Q.QUERIES["sample_chapters"](spark, SF).collect() for _ in range(2))
    assert first == again and len(first) == 5
