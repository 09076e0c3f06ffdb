"""Preparation for listening. Rules that the documentation leaves open are decided here, in each docstring."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from . import chapters as C

L = F.lit


def image_comment_to_quote(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)<!-- IMAGE_DESCRIPTION: (.*?) -->", "\n> 【图片描述】$1\n")


def image_path_fix(text: Column) -> Column:
    return F.replace(text, L("./images/"), L("../images/"))


def strip_suffix(name: Column) -> Column:
    return F.replace(name, L("_with_descriptions.md"), L(".md"))


def dedupe_title(text: Column, title: Column) -> Column:
    """The title is put before the text unless its first line is that heading already."""
    first = F.regexp_replace(F.split_part(F.regexp_replace(text, rf"^{X.WS}+", ""), L("\n"), L(1)), rf"{X.WS}+\z", "")
    return F.when((first == F.concat(L("# "), title)) | (first == F.concat(L("#"), title)), text).otherwise(F.concat(L("# "), title, L("\n\n"), text))


def merge_chapters(files: DataFrame) -> DataFrame:
    """The merged book as pieces (file_name, piece) in the order of names: written one after the other they are the book. A corpus never has to fit one row."""
    rows = files.where(~F.startswith("file_name", L("00_")) & ~F.endswith("file_name", L("_report.md")))
    first = rows.agg(F.min("file_name").alias("first"))  # one row
    piece = F.when(F.col("file_name") == F.col("first"), F.col("content")).otherwise(F.concat(L("\n\n---\n\n"), "content"))
    return rows.crossJoin(F.broadcast(first)).select("file_name", piece.alias("piece")).orderBy("file_name")


def chinese_ratio(text: Column) -> Column:
    """Ideographs U+4E00 to U+9FFF over characters that are not white space (our decision); NaN of a blank text, as 0 over 0 is in SQL.

    Both are counted by what is left without the others: an array would hold a string for each letter.
    """
    wide = F.length(text) - F.length(F.regexp_replace(text, r"[\x{4E00}-\x{9FFF}]+", ""))
    shown = F.length(F.regexp_replace(text, rf"{X.WS}+", ""))
    # a plain division by zero ends the job in ANSI mode
    return F.coalesce(F.try_divide(wide.cast("double"), shown), F.when(text.isNotNull(), L(float("nan"))))


def term_density(text: Column, terms: list[str]) -> Column:
    """Different terms found over words (our decision)."""
    return F.size(X.known(text, terms)).cast("double") / F.greatest(L(1), X.words(text))


def term_categories(docs: DataFrame, categories: dict[str, list[str]]) -> DataFrame:
    """Number of documents with each named term."""
    table = F.array(*(F.struct(L(c).alias("category"), L(t).alias("term")) for c, ts in categories.items() for t in ts))
    hits = docs.select(F.inline(F.filter(table, lambda x: F.contains(F.col("text"), x["term"]))))
    return hits.groupBy("category", "term").agg(F.count("*").alias("n_documents"))


def route(ratio: Column, density: Column) -> Column:
    return F.when(ratio >= 0.3, "skip").when(density > 0.15, "skip").when((density > 0.05) & (ratio < 0.15), "translate_protected").otherwise("translate")


def language_gate(ratio: Column) -> Column:
    """Between 30 and 70 percent paragraphs are routed one by one (our decision)."""
    return F.when(ratio > 0.7, "skip").when(ratio < 0.3, "translate_all").otherwise("mixed")


def mask_terms(text: Column, terms: list[str]) -> Column:
    """Terms to placeholders, longer ones first as given; unmask_terms restores them."""
    for k, t in enumerate(terms):
        text = F.replace(text, L(t), L(f"⟦T{k}⟧"))
    return text


def unmask_terms(text: Column, terms: list[str]) -> Column:
    for k, t in enumerate(terms):
        text = F.replace(text, L(f"⟦T{k}⟧"), L(t))
    return text


END_MARKS = "。！？；.!?;"


def sentences(text: Column) -> Column:
    """Sentences with their end marks, stripped, without empty ones."""
    found = F.transform(X.every(text, f"[^{END_MARKS}]+[{END_MARKS}]*|[{END_MARKS}]+"), X.strip)
    return F.filter(found, lambda s: s != "")


def list_items(text: Column) -> Column:
    return X.every(text, r"(?dm)^[-*] (.*)$", 1)


def narrate_tables(rows: DataFrame) -> DataFrame:
    """A sentence "header：cell，…。" for each row below the rule of a Markdown table."""
    cells = F.transform(X.every(F.col("body"), r"(?dm)^\|(.*)\|$", 1), lambda y: F.transform(F.split(y, r"\|"), lambda z: F.trim(z)))
    found = rows.select("id", cells.alias("x")).where(F.size("x") > 2)
    found = found.select("id", F.col("x")[0].alias("head"), F.posexplode(F.slice("x", 3, F.greatest(F.size("x") - 2, L(0)))).alias("i", "row_cells"))
    said = F.transform(F.arrays_zip(F.col("head").alias("h"), F.col("row_cells").alias("c")), lambda z: F.concat(z["h"], L("："), z["c"]))
    return found.select("id", (F.col("i") + 1).alias("row"), F.concat(F.array_join(said, "，"), L("。")).alias("sentence"))


def cap_headings(text: Column) -> Column:
    """At most three levels (our decision)."""
    return F.regexp_replace(text, r"(?dm)^#{4,}", "###")


def structure_diff(paired: DataFrame) -> DataFrame:
    """Whether paragraphs, list items and images are equal in number."""
    same = lambda p: X.count(F.col("original"), p) == X.count(F.col("translated"), p)
    return paired.select("key", same(r"[^\n]+(\n[^\n]+)*").alias("paragraphs_equal"), same(r"(?dm)^[-*] ").alias("items_equal"), same(X.MD_IMAGE).alias("images_equal"))


def structure_summary(original: DataFrame, translated: DataFrame) -> DataFrame:
    one = lambda df, name: C.chapters(df).agg(F.count("*").alias("n_chapters"), F.sum(X.count(F.col("content"), X.MD_IMAGE)).alias("n_images")).select(L(name).alias("edition"), "n_chapters", "n_images")
    return one(original, "original").unionByName(one(translated, "translated"))


def input_kind(name: Column) -> Column:
    low = F.lower(name)
    return F.when(low.endswith(".epub"), "epub").when(low.endswith(".pdf"), "pdf").when(low.endswith(".md") | low.endswith(".markdown"), "markdown").when(~F.contains(name, L(".")), "folder").otherwise("unknown")


def cover_pick(entries: DataFrame) -> DataFrame:
    """Of each archive the first cover image in archive order; where there is none, its .opf entries."""
    low = F.lower("name")
    is_cover = low.contains("cover") & low.rlike("[.](jpg|jpeg|png)$")
    w = Window.partitionBy("archive").orderBy("ord")
    cover = entries.where(is_cover).withColumn("_n", F.row_number().over(w)).where("_n = 1").select("archive", "ord", "name", L("cover").alias("kind"))
    opf = entries.where(F.endswith("name", L(".opf"))).join(entries.where(is_cover).select("archive").distinct(), "archive", "left_anti")
    return cover.unionByName(opf.select("archive", "ord", "name", L("opf").alias("kind")))


def is_image(name: str) -> Column:
    return F.col(name).rlike("[.](jpg|png|gif|webp)$")


def image_passes() -> Column:
    return ~(F.lower("name").rlike("qr_?code|cover|author|decoration|emoji|icon") | (F.col("size") < 500) | (F.col("width") < 50) | (F.col("height") < 50))


def image_route() -> Column:
    name, body, comment = F.col("name"), F.col("body"), F.concat(L("<!-- "), F.col("name"), L(" -->\n"))
    kind = F.col("image_class")
    return (
        F.when(kind == "CODE_SCREENSHOT", F.concat(comment, L("```java\n"), body, L("\n```\n> 【代码说明】")))
        .when(kind == "TABLE_IMAGE", F.concat(comment, body, L("\n> 【表格说明】")))
        .when(kind == "TEXT_SCREENSHOT", body)
        .otherwise(F.concat(L("![]("), name, L(")\n> 【图片描述】"), body))
    )


def cover_decision() -> Column:
    return F.when(F.col("user_cover") != "", "user").when((F.col("original_cover") != "") & (F.col("accepted") == 1), "original").when(F.col("has_api_key") == 1, "ai").otherwise("programmatic")


def chinese_number(n: Column) -> Column:
    """1 to 99 in words, other numbers in digits."""
    digit = lambda k: F.get(F.array(*map(L, ["", *"一二三四五六七八九"])), k)
    tens, ones = F.floor(n / 10).cast("int"), (n % 10).cast("int")
    return F.when(n.between(1, 99), F.concat(F.when(tens == 0, "").when(tens == 1, "十").otherwise(F.concat(digit(tens), L("十"))), digit(ones))).otherwise(n.cast("string"))


def image_description() -> Column:
    """The description of an image as a note of as many lines as it has points, from kind, conclusion, elements and points (semicolons between).

    Fixed wording: readers of the note look for it. Points that are blank are left out.
    """
    points = F.filter(F.transform(F.split("points", ";"), lambda x: F.trim(x)), lambda x: x != "")
    lines = F.transform(points, lambda x, i: F.concat(L("\n> - 第"), chinese_number(i + 1), L("，"), x))
    return F.concat(L("> **图片说明**：This is a "), "kind", L(".\n> 核心结论是："), "conclusion", L("\n> 关键元素包括："), "elements", L("\n> 要点总结："), F.array_join(lines, ""))


#: Language and the words that speak for it; the most hits win, ties go to the first (our decision).
LANGUAGES = [
    ("java", r"(?:public|private|protected|void|class|new|int|String) "),
    ("python", r"(?:def |import |elif |self\.|return )"),
    ("javascript", r"(?:const |let |function |=> )"),
    ("sql", r"(?:SELECT |FROM |WHERE |JOIN )"),
    ("bash", r"(?:echo |cd |&& |\$[A-Z])"),
]


def detect_language(code: Column) -> Column:
    """The hits of each language are counted once: the largest count with the first name is taken from one array."""
    counts = F.array(*(F.struct(X.count(code, p).alias("n"), L(-k).alias("first"), L(name).alias("name")) for k, (name, p) in enumerate(LANGUAGES)))
    # a lambda's argument is computed once
    return F.get(F.transform(F.array(F.array_max(counts)), lambda best: F.when(best["n"] == 0, "text").otherwise(best["name"])), L(0))


LANGUAGE_SQL = (
    "SELECT code, CASE WHEN greatest(" + ", ".join(f"n{k}" for k in range(len(LANGUAGES))) + ") = 0 THEN 'text' "
    + " ".join(f"WHEN n{k} = greatest({', '.join(f'n{j}' for j in range(len(LANGUAGES)))}) THEN '{name}'" for k, (name, _) in enumerate(LANGUAGES))
    + " END AS language FROM (SELECT code, " + ", ".join(f"len(regexp_extract_all(code, '{p}')) AS n{k}" for k, (_, p) in enumerate(LANGUAGES)) + " FROM input)"
)
