"""Alignment, dictionaries, headings, tables, images, paragraphs, samples and kept answers on small cases against plain versions."""

from __future__ import annotations

import math
import os
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from quirelight.functions.lexicon import TERMS
from quirelight.operators import acronyms, alignment, answers, assets, dictionary, paragraphs, sampling, tables, toc
from quirelight.operators.enhance import chinese_number, detect_language, image_description

DOCS = "/root/testdata/sf0.001/documents.parquet"


def rows_of(spark, texts, schema="id string, text string"):
    return spark.createDataFrame(list(texts), schema)


# --- alignment -------------------------------------------------------------------------------------------------------------------------


def plain_alignment(original, translated):
    """Cost of the best alignment, by a plain table over rows."""

    def cut(text):
        out = []
        for x in re.findall("(?m)^" + alignment.BLOCK, text):
            kind = next((k for k, starts in (("code", ("```", "<blockquote")), ("image", ("![", "<img")), ("heading", ("#",)), ("quote", (">",)), ("table", ("|",)), ("item", ("- ", "* "))) if x.startswith(starts)), "paragraph")
            name = re.search('src="(?:[^"]*/)?([^"/]*)"', x) if x.startswith("<img") else re.search('([^/("]+)[)"]', x) if x.startswith("![") else None
            out.append((kind, len(x), name[1] if name else ""))
        return out

    o, t = cut(original), cut(translated)
    size = lambda x: max(1, sum(b[1] for b in x))
    far = lambda a, b: math.floor(100 * abs(a * size(t) - b * size(o)) / (a * size(t) + b * size(o)))

    def cost(a, b):
        if len(a) + len(b) == 1:
            return alignment.SKIP
        if len(a) == len(b) == 1:
            (k, n, name), (k2, n2, name2) = a[0], b[0]
            if k == k2 == "image":
                return 0 if name == name2 else alignment.OTHER_IMAGE
            if (k, k2) == ("image", "code"):
                return alignment.RECOGNISED
            return far(n, n2) // 2 if k == k2 else alignment.KIND + far(n, n2) // 4
        if {x[0] for x in a + b} != {"paragraph"}:
            return math.inf
        return alignment.JOIN + far(sum(x[1] for x in a), sum(x[1] for x in b)) // 2

    best = {(0, 0): (0, ())}
    for i in range(len(o) + 1):
        for j in range(len(t) + 1):
            if i + j:
                options = [(best[i - x, j - y][0] + cost(o[i - x : i], t[j - y : j]), k, (i - x, j - y, x, y)) for k, (x, y) in enumerate(alignment.STEPS) if i >= x and j >= y]
                total, _, last = min(options)
                best[i, j] = total, (*best[last[0], last[1]][1], last)
    return best[len(o), len(t)][1]


CASES = {
    "same": ("# A\n\none two three\n\n![x](a/1.png)\n\nfour five", "# B\n\neins zwei drei\n\n![y](b/1.png)\n\nvier funf"),
    "image_lost": ("# A\n\ntext text text\n![x](1.png)\nlast words here", "# A\n\ntext text text\nlast words here"),
    "image_other": ("![x](1.png)", "![x](2.png)"),
    "recognised": ("words before it\n![x](1.png)\nwords after it", "words before it\n```java\nint a;\n```\nwords after it"),
    "split": ("a long paragraph of two halves that is cut\nnext one is here", "a long paragraph of\ntwo halves that is cut\nnext one is here"),
    "note": ("plain words\n![x](1.png)", "plain words\n![x](1.png)\n> a note on it"),
    "empty": ("", "only here"),
    "nothing": ("\n \n", ""),
    "code": ("```\n# no heading\n\n```\nafter", "```\n# no heading\n\n```\nafter"),
}


def test_alignment_is_that_of_a_plain_table(spark):
    rng = random.Random(4)
    cases = dict(CASES)
    for k in range(40):
        make = lambda: "\n".join(rng.choice(["# h", "- item", "> note", "| a |", "![x](%d.png)" % rng.randrange(3), "w" * rng.randrange(1, 90), "v" * rng.randrange(1, 30), ""]) for _ in range(rng.randrange(0, 9)))
        cases[f"r{k}"] = make(), make()
    df = spark.createDataFrame([(k, *v) for k, v in cases.items()] + [("null", None, None)], "key string, original string, translated string")
    found = {}
    for r in alignment.aligned(df).orderBy("key", "step").collect():
        found.setdefault(r["key"], []).append(r)
    for key, (a, b) in cases.items():
        got = tuple((r["o_from"] - 1, r["t_from"] - 1, r["o_blocks"], r["t_blocks"]) for r in found.get(key, []))
        assert got == plain_alignment(a, b), key
    names = lambda key: [r["difference"] for r in found[key]]
    assert names("same") == ["same"] * 4 and names("image_lost") == ["same", "same", "missing", "same"]
    assert names("image_other") == ["image"] and names("recognised") == ["same", "recognised", "same"] and names("split") == ["split", "same"]
    assert names("note") == ["same", "same", "added"] and [r["expected"] for r in found["note"]] == [True] * 3
    assert [r["expected"] for r in found["image_lost"]] == [True, True, False, True]
    assert names("empty") == ["added"] and "nothing" not in found and "null" not in found


# --- dictionaries ----------------------------------------------------------------------------------------------------------------------


def test_dictionaries_of_any_size(spark):
    docs = spark.read.parquet(DOCS).select(F.col("doc_id").alias("id"), "text")
    odd = [(900, "x"), (901, "the a\nb"), (902, None), (903, ""), (None, "the"), (904, "日本語のtext"), (905, "ab" * 3000)]
    texts = docs.unionByName(spark.createDataFrame(odd, "id long, text string"))
    words = sorted({w for r in spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select(F.explode(F.array_distinct(F.split("text", r"\s+"))).alias("w")).distinct().collect() for w in [r["w"]]})[:100_000]
    assert len(words) == 100_000
    con = duckdb.connect()
    held_texts = texts.toPandas()  # noqa: F841  read by name below
    for terms in (TERMS, words + ["", None, "a", "b", "e b", "a\nb", "語の", "the", "the", "abab"]):
        dictionary_rows = spark.createDataFrame([(t,) for t in terms], "term string")
        got = dictionary.terms_in(texts, dictionary_rows)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan
        want_terms = dictionary_rows.toPandas()  # noqa: F841  read by name below
        want = con.sql("SELECT t.id, w.term FROM held_texts t JOIN (SELECT DISTINCT term FROM want_terms WHERE term <> '') w ON contains(t.text, w.term) WHERE t.id IS NOT NULL").fetchall()
        assert sorted((r["id"], r["term"]) for r in got.collect()) == sorted((int(i), t) for i, t in want)
    assert dictionary.terms_in(texts, spark.createDataFrame([], "term string")).count() == 0
    assert dictionary.terms_in(texts.limit(0), spark.createDataFrame([("a",)], "term string")).count() == 0


# --- headings --------------------------------------------------------------------------------------------------------------------------

BOOK = "# One\ntext\n### Deep\n## Two ##\n```\n# code\n```\n### Three\n#Four\n# Five\n###### Six\n## Seven\n####### no\n#\n"


def test_tree_of_headings(spark):
    rows = toc.tree(toc.headings(rows_of(spark, [("b", BOOK), ("n", None), ("e", ""), ("p", "no heading")]))).orderBy("place").collect()
    assert [(r["title"], r["level"], r["depth"], r["sibling"], r["path"]) for r in rows] == [
        ("One", 1, 1, 1, "One"), ("Deep", 3, 2, 1, "One / Deep"), ("Two", 2, 2, 2, "One / Two"), ("Three", 3, 3, 1, "One / Two / Three"),
        ("Five", 1, 1, 2, "Five"), ("Six", 6, 2, 1, "Five / Six"), ("Seven", 2, 2, 2, "Five / Seven"),
    ]
    assert [r["parent"] for r in rows] == [None, 1, 1, 4, None, 10, 10]


def test_tree_against_a_stack(spark):
    rng = random.Random(1)
    texts = [(str(k), "\n".join("#" * rng.randrange(1, 7) + f" t{i}" for i in range(rng.randrange(0, 40)))) for k in range(60)]
    want = []
    for key, text in texts:
        stack = []
        for place, line in enumerate(text.split("\n"), 1):
            if line:
                level = len(line.split()[0])
                while stack and stack[-1][0] >= level:
                    stack.pop()
                want.append((key, place, stack[-1][1] if stack else None, len(stack) + 1, " / ".join([*(s[2] for s in stack), line.split()[1]])))
                stack.append((level, place, line.split()[1]))
    got = toc.tree(toc.headings(rows_of(spark, texts))).select("id", "place", "parent", "depth", "path").collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_outlines_compared(spark):
    df = spark.createDataFrame([("a", "# x\n## y", "# 甲\n## 乙"), ("b", "# x\n## y", "# 甲\n# 乙"), ("c", "none", "# 甲"), ("d", None, None)], "key string, original string, translated string")
    got = {r["key"]: tuple(r)[1:] for r in toc.compared(df).collect()}
    assert got == {"a": (2, 2, 2, 2, True), "b": (2, 2, 2, 1, False), "c": (0, 1, 0, 1, False), "d": (0, 0, 0, 0, True)}


# --- tables ----------------------------------------------------------------------------------------------------------------------------


def test_tables_told(spark):
    text = "before\n| name | size |\n|:---|---:|\n| a \\| b | 1 |\n| c | |\n\nx | y\nz | w\nend\n|only|\n| h |\n|---|"
    got = [(r["place"], r["row"], r["sentence"]) for r in tables.told(rows_of(spark, [("t", text), ("n", None), ("e", "")])).orderBy("place").collect()]
    assert got == [(4, 1, "name：a | b，size：1。"), (5, 2, "name：c。"), (7, 1, "第1列：x，第2列：y。"), (8, 2, "第1列：z，第2列：w。"), (10, 1, "第1列：only。"), (11, 2, "第1列：h。")]


# --- images ----------------------------------------------------------------------------------------------------------------------------


def test_paths_are_resolved(spark):
    cases = {"./a.png": "book/ch/a.png", "../images/a.png": "book/images/a.png", "../../a.png": "a.png", "../../../a.png": None, "/root/a.png": "root/a.png", "a/./b/../c.png?x#y": "book/ch/a/c.png", "http://x/a.png": None, "": None, "a%20b+c.png": "book/ch/a b+c.png", "data:image/png;x": None}
    got = spark.createDataFrame([(k,) for k in cases], "r string").select("r", assets.resolved(F.lit("book/ch"), F.col("r")).alias("p")).collect()
    assert {r["r"]: r["p"] for r in got} == cases


def test_images_that_lead_nowhere(spark):
    files = spark.createDataFrame([("a.md", "![x](./1.png) ![y](../2.png)\n![z](../../../3.png)"), ("b.md", '<img src="1.png" alt=""/>'), ("c.md", None)], "file_name string, content string")
    have = spark.createDataFrame([("book/ch/1.png",), ("book/ch/1.png",), ("book/9.png",)], "path string")
    got = {(r["problem"], r["file_name"], r["path"]) for r in assets.dangling(assets.references(files, F.lit("book/ch")), have).collect()}
    assert got == {("missing", "a.md", "book/2.png"), ("outside", "a.md", None), ("unused", None, "book/9.png")}


# --- paragraphs and samples -------------------------------------------------------------------------------------------------------------


def test_paragraphs_of_mixed_texts_are_routed_one_by_one(spark):
    mixed = "全部都是中文的段落\nplain english words only here\nString ArrayList of words that are seen here and there now"
    rows = rows_of(spark, [("m", mixed), ("z", "都是中文\nplain"), ("e", "only english\n\nString API"), ("n", None), ("b", " \n ")])
    got = {(r["id"], r["place"]): (r["gate"], r["route"]) for r in paragraphs.route_paragraphs(rows.where("id <> 'z'").unionByName(rows_of(spark, [("z", "都是中文都是中文都是中文\nplain")])), TERMS).collect()}
    assert got["e", 1] == ("translate_all", "translate") and got["e", 3] == ("translate_all", "translate_protected")
    assert got["z", 2] == ("skip", "skip") and ("n", 1) not in got and ("b", 1) not in got
    gate = got["m", 1][0]
    assert gate in ("mixed", "translate_all") and (gate != "mixed" or got["m", 1][1] == "skip")


def test_batches_keep_the_budget(spark):
    rng = random.Random(3)
    rows = [("a", k, rng.choice(["translate", "skip", "translate_protected"]), rng.randrange(1, 60)) for k in range(200)]
    df = spark.createDataFrame(rows, "id string, place int, route string, tokens long")
    sums, last = {}, -1
    for r in paragraphs.batched(df, 100).orderBy("place").collect():
        assert (r["batch"] is None) == (r["route"] == "skip")
        if r["batch"] is not None:
            assert r["batch"] >= last
            last = r["batch"]
            sums[last] = sums.get(last, 0) + r["tokens"]
    assert max(sums.values()) < 200


def test_samples(spark):
    df = spark.createDataFrame([(k, "abc"[k % 3] if k % 7 else None) for k in range(100)], "id long, kind string")
    got = sampling.stratified(df, "id", F.col("kind"), F.when(F.col("kind") == "a", 3).otherwise(2)).collect()
    again = sampling.stratified(df.orderBy(F.desc("id")).repartition(7), "id", F.col("kind"), F.when(F.col("kind") == "a", 3).otherwise(2)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again)) and len(got) == 3 + 2 * 3
    quotas = {r["stratum"]: r["quota"] for r in sampling.shares(df, F.col("kind"), 10).collect()}
    assert sum(quotas.values()) == 10 and min(quotas.values()) >= 1
    checked = spark.createDataFrame([("x", k < 9) for k in range(10)] + [("y", True)], "stratum string, ok boolean")
    rates = {r["stratum"]: r for r in sampling.success(checked, F.col("ok")).collect()}
    assert rates["x"]["rate"] == 0.9 and 0.55 < rates["x"]["low"] < 0.9 < rates["x"]["high"] < 1 and rates["y"]["high"] <= 1 + 1e-12 and rates["y"]["low"] < 0.25


# --- descriptions, languages, terms -------------------------------------------------------------------------------------------------------


def test_descriptions_of_any_number_of_points(spark):
    df = spark.createDataFrame([("bar chart", "sales grow", "axes", ";".join(f"p{k}" for k in range(12))), ("x", "y", "z", ""), ("x", "y", "z", " ; a;")], "kind string, conclusion string, elements string, points string")
    notes = [r["n"] for r in df.select(image_description().alias("n")).collect()]
    assert notes[0].startswith("> **图片说明**：This is a bar chart.\n> 核心结论是：sales grow\n> 关键元素包括：axes\n> 要点总结：\n> - 第一，p0\n") and notes[0].endswith("第十二，p11")
    assert notes[1].endswith("要点总结：") and notes[2].endswith("\n> - 第一，a")
    said = [r["s"] for r in spark.createDataFrame([(k,) for k in (1, 9, 10, 11, 20, 21, 99, 100)], "n int").select(chinese_number(F.col("n")).alias("s")).collect()]
    assert said == ["一", "九", "十", "十一", "二十", "二十一", "九十九", "100"]


def test_languages_are_counted_once(spark):
    plan = spark.range(1).select(detect_language(F.col("id").cast("string")).alias("l"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("def |import") <= 1


def test_acronyms_and_categories(spark):
    texts = [
        "the large language model (LLM) and the Department of Energy (DOE) met", "We use HTTP (hypertext terms) and not (XYZ)", "see the quick notes (ABC) here", "a Foo framework and the Foo library, the Bar protocol", "the Foo language",
        "graphics processing unit (GPU) or GPU (graphics processing unit)",
    ]
    rows = rows_of(spark, [(str(k), t) for k, t in enumerate(texts)])
    got = {(r["acronym"], r["expansion"]): r["n_texts"] for r in acronyms.pairs(rows).collect()}
    assert got == {("LLM", "large language model"): 1, ("DOE", "department of energy"): 1, ("GPU", "graphics processing unit"): 1}
    kinds = {r["term"]: (r["category"], r["votes"], r["total"]) for r in acronyms.categorised(rows).collect()}
    assert kinds == {"Foo": ("framework", 2, 3), "Bar": ("protocol", 1, 1)}


# --- kept answers ------------------------------------------------------------------------------------------------------------------------


def counting(folder, fails=()):
    """A provider that leaves a file for each request it is sent, and fails on some; and what it was sent."""

    def provide(requests):
        import uuid

        for x in requests:
            with open(f"{folder}/{uuid.uuid4().hex}", "w") as f:
                f.write(x)
        if set(fails) & set(requests):
            raise RuntimeError("no answer")
        return [x.upper() for x in requests]

    return provide, lambda: sorted(open(f"{folder}/{n}").read() for n in os.listdir(folder))


def test_equal_requests_are_sent_once_and_never_again(spark, tmp_path):
    rows = spark.createDataFrame([(k, f"p{k % 5}" if k % 11 else None, "x") for k in range(200)] + [(200 + k, "hot", "y") for k in range(500)], "id long, text string, answer2 string").repartition(6)
    (tmp_path / "one").mkdir(), (tmp_path / "two").mkdir()
    first, sent = counting(str(tmp_path / "one"), fails=["p3"])
    out = answers.ask_kept(rows, "text", first, "m-1", str(tmp_path / "store"), batch=1).collect()
    assert sent() == ["hot", "p0", "p1", "p2", "p3", "p4"]
    assert all(r["answer"] == (None if r["text"] is None else "p3" if r["text"] == "p3" else r["text"].upper()) and r["answered"] == (r["text"] not in (None, "p3")) for r in out) and len(out) == 700
    second, sent = counting(str(tmp_path / "two"))
    out = answers.ask_kept(rows.unionByName(spark.createDataFrame([(999, "new", "z")], rows.schema)), "text", second, "m-1", str(tmp_path / "store"), batch=1).collect()
    assert sent() == ["new", "p3"] and all(r["answered"] == (r["text"] is not None) for r in out)
    answers.ask_kept(rows.limit(0), "text", second, "m-2", str(tmp_path / "store")).collect()
    assert sent() == ["new", "p3"]


@pytest.mark.parametrize("name", ["toc_tree", "table_sentences", "dangling_images", "route_paragraphs", "edition_differences", "dictionary_terms", "sample_success"])
def test_queries_equal_their_sql(spark, name):
    import __spark_entry__ as entry

    where = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{where}/documents.parquet'")
    con.sql(f"CREATE VIEW benchmark AS SELECT * FROM '{where}/benchmark.parquet'")
    got = entry.queries()[name](spark, where)
    columns = sorted(got.columns)
    want = con.sql(f"SELECT {', '.join(columns)} FROM ({entry.oracle_sql()[name]})").fetchall()
    close = lambda rows: sorted((tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in rows), key=repr)
    assert close(map(tuple, got.select(columns).collect())) == close(want)


# --- files by name -----------------------------------------------------------------------------------------------------------------------


def test_files_appear_together_or_not_at_all(spark, tmp_path):
    from quirelight.sources.named_files import write_named

    rows = spark.createDataFrame([(f"{k:03}_ch.md", f"text {k}\r\né") for k in range(50)], "name string, content string").repartition(5)
    good = str(tmp_path / "good")
    write_named(rows, good)
    assert sorted(os.listdir(good)) == [f"{k:03}_ch.md" for k in range(50)]
    assert open(f"{good}/007_ch.md", newline="").read() == "text 7\r\né"
    # one task fails: no file, nothing left behind, what was there stays
    bad = rows.withColumn("content", F.when(F.col("name") == "031_ch.md", F.raise_error(F.lit("lost"))).otherwise(F.lit("new")))
    with pytest.raises(Exception, match="lost"):
        write_named(bad, good)
    with pytest.raises(Exception, match="not a file name"):
        write_named(rows.withColumn("name", F.when(F.col("name") == "001_ch.md", "../x").otherwise(F.col("name"))), str(tmp_path / "none"))
    # a task that was still at work may leave its hidden folder
    shown = lambda folder: [n for n in os.listdir(folder) if not n.startswith(".job-")]
    assert shown(tmp_path / "none") == [] and len(shown(good)) == 50 and open(f"{good}/007_ch.md", newline="").read() == "text 7\r\né"
    with pytest.raises(Exception, match="twice"):
        write_named(rows.withColumn("name", F.lit("same.md")), str(tmp_path / "twice"))
    assert shown(tmp_path / "twice") == []
    write_named(spark.createDataFrame([("b.bin", bytearray(b"\0\1")), ("n.bin", None)], "name string, content binary"), good, overwrite=True)
    assert sorted(shown(good)) == ["b.bin", "n.bin"] and open(f"{good}/b.bin", "rb").read() == b"\0\1"


def test_a_task_that_fails_once_leaves_no_second_copy(tmp_path):
    """In a session that tries tasks again: the first attempt of one task dies after it wrote some files."""
    import subprocess
    import sys

    code = f"""
import os, sys
sys.path.insert(0, {str(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))!r})
from pyspark.sql import SparkSession
from quirelight.sources.named_files import write_named
spark = SparkSession.builder.master("local[2,3]").config("spark.ui.enabled", "false").getOrCreate()
spark.sparkContext.setLogLevel("OFF")
mark = {str(tmp_path / "mark")!r}
def once(batches):
    for b in batches:
        for k in range(b.num_rows):
            if b.column(0)[k].as_py() == "17.md" and not os.path.exists(mark):
                open(mark, "w").close()
                raise RuntimeError("dies once")
            yield b.slice(k, 1)
rows = spark.range(20).selectExpr("concat(id, '.md') as name", "concat('t', id) as content").coalesce(2).mapInArrow(once, "name string, content string")
write_named(rows, {str(tmp_path / "out")!r})
"""
    subprocess.run([sys.executable, "-c", code], check=True, timeout=240, capture_output=True)
    assert os.path.exists(tmp_path / "mark")
    assert sorted(os.listdir(tmp_path / "out")) == sorted(f"{k}.md" for k in range(20))


def test_long_tables_and_code_do_not_nest_calls(spark):
    from quirelight.operators import listening

    table = "| a | b |\n|---|---|\n" + "| x | y |\n" * 50_000
    code = "int a;\n" * 50_000
    df = rows_of(spark, [("t", "before\n" + table + "after"), ("c", "text\n" + code + "end"), ("s", "```\nint a;\n```\n| h |\n|---|\n"), ("n", None)])
    got = {r["id"]: r for r in df.select("id", listening.describe_notes(F.col("text")).alias("d"), listening.add_notes(F.col("text")).alias("a"), listening.fence_code(F.col("text")).alias("f")).collect()}
    assert got["t"]["d"].endswith("> 【表格说明】2 列，50000 行：a、b\nafter") and got["t"]["a"].count("【表格说明】") == 1
    assert got["c"]["f"].count("```") == 2 and "```java" in got["c"]["f"]
    assert got["s"]["d"] == "```\nint a;\n```\n> 【代码说明】java，1 行\n| h |\n|---|\n> 【表格说明】1 列，0 行：h\n"
    assert got["n"]["d"] is None


# --- images and providers -----------------------------------------------------------------------------------------------------------------


def test_images_reach_the_provider(spark):
    import json

    from quirelight.operators import providers

    def see(requests):
        import base64

        out = []
        for x in requests:
            seen = base64.b64decode(x.split(",", 1)[1]).decode() if x.startswith("data:image/") else x
            out.append("code_screenshot" if "code" in seen else "chart" if x.startswith("data:image/jpeg") else "what?")
        return out

    rows = spark.createDataFrame([("a.png", bytearray(b"code"), 1), ("b.jpg", bytearray(b"bars"), 2), ("c.gif", None, 3), ("code.gif", bytearray(b""), 4)], "name string, data binary, size int")
    got = {r["name"]: r["image_class"] for r in providers.classify_images(rows, see).collect()}
    assert got == {"a.png": "CODE_SCREENSHOT", "b.jpg": "CHART", "c.gif": "OTHER", "code.gif": "CODE_SCREENSHOT"}

    def tell(requests):
        return [json.dumps({"kind": "line chart", "conclusion": "it grows", "elements": "axes", "points": ["up; up", "b"]}) if x.startswith("data:") else "no json" for x in requests]

    notes = {r["name"]: r["note"] for r in providers.describe_images(rows, tell).collect()}
    assert notes["a.png"] == "> **图片说明**：This is a line chart.\n> 核心结论是：it grows\n> 关键元素包括：axes\n> 要点总结：\n> - 第一，up； up\n> - 第二，b"
    assert notes["c.gif"] is None and notes["code.gif"] is None

    def broken(requests):
        raise RuntimeError

    assert {r["note"] for r in providers.describe_images(rows, broken).collect()} == {None}
    assert {r["image_class"] for r in providers.classify_images(rows, broken).collect()} == {"OTHER"}


def test_template_report(spark):
    from quirelight.fixtures import editions
    from quirelight.plans.verification import template_report

    text = template_report(*editions(spark, "/root/testdata/sf0.001"), "验证报告", "2026-03-24")
    heads = [line for line in text.split("\n") if line.startswith("#")]
    assert heads == ["# 验证报告", "## 验证时间", "## 结构完整性", "## 图片处理统计", "## OCR 准确性", "## 翻译质量", "## 异常问题列表"]
    assert "| 目录层级 | 1 | 1 | ✅ |" in text and re.search(r"- 抽样数量: 10\n- 准确数量: \d+\n- 准确率: \d+%", text) and "- 抽样章节: 3" in text
