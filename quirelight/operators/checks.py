"""The two audits: issue rows of the first, result rows of the second. check_ord keeps the order in which checks run."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.lexicon import CONCEPTS, IDENTIFIERS, TERMS
from . import chapters as C

S = F.lit


# Fixed values below: the wordings, kinds and severities of issues and results are part of what the audits return.
ISSUE = ("check_ord", "type", "severity", "location", "description", "original", "translated", "suggestion")


def _entry(check: int, kind: str, severity: str, location: str, description: Column, original: Column, translated: Column, suggestion: Column) -> Column:
    values = (S(check), S(kind), S(severity), S(location), description, original, translated, suggestion)
    return F.struct(*(v.alias(n) for v, n in zip(values, ISSUE)))


def _issues(paired: DataFrame, found: Column) -> DataFrame:
    """A row for each entry of an array. The outer form keeps the array from being computed twice, once to filter and once to unfold."""
    rows = paired.select(F.expr("try_cast(key as bigint)").alias("chapter_num"), "original_file", F.inline_outer(found)).where("check_ord is not null")
    return rows.select("chapter_num", "original_file", *ISSUE)


def _lost_terms() -> Column:
    lost = F.filter(X.known(F.col("original"), TERMS), lambda t: ~F.contains(F.col("translated"), t))
    return F.transform(lost, lambda t: _entry(1, "technical_term", "high", "content", F.format_string('Technical term "%s" not preserved in translation', t), t, S("[MISSING]"), F.format_string('Keep "%s" in English', t)))


def _mismatch(check: int, severity: str, location: str, head: str, unit: str, suggestion: str, o: Column, t: Column) -> Column:
    entry = _entry(check, "formatting", severity, location, F.format_string(f"{head} count mismatch: %d original vs %d translated", o, t), F.format_string(f"%d {unit}", o), F.format_string(f"%d {unit}", t), S(suggestion))
    return F.when(o != t, F.array(entry)).otherwise(F.array().cast(EMPTY))


EMPTY = "array<struct<check_ord: int, type: string, severity: string, location: string, description: string, original: string, translated: string, suggestion: string>>"


def _code_mismatch() -> Column:
    return _mismatch(2, "high", "code blocks", "Code block", "code blocks", "Ensure all code blocks are preserved", X.code_count(F.col("original")), X.code_count(F.col("translated")))


def _image_mismatch() -> Column:
    return _mismatch(3, "medium", "images", "Image", "images", "Ensure all images are preserved", X.count(F.col("original"), X.MD_IMAGE), X.count(F.col("translated"), X.MD_IMAGE))


def missing_terms(paired: DataFrame) -> DataFrame:
    """Dictionary terms in the original and not in the translation, as raw substrings. Every pattern hit that is a dictionary word is a substring too."""
    return _issues(paired, _lost_terms())


def code_block_counts(paired: DataFrame) -> DataFrame:
    return _issues(paired, _code_mismatch())


def image_counts(paired: DataFrame) -> DataFrame:
    return _issues(paired, _image_mismatch())


def all_issues(paired: DataFrame) -> DataFrame:
    """Issues of all pairs, in one pass over them. Our order: chapter number, file, check, term."""
    return _issues(paired, F.concat(_lost_terms(), _code_mismatch(), _image_mismatch()))


def chapter_totals(original: DataFrame, translated: DataFrame) -> DataFrame:
    one = lambda df, name: C.chapters(df).agg(F.count("*").alias(name))
    return one(original, "o").crossJoin(one(translated, "t"))  # two single rows


def chapter_count_issue(original: DataFrame, translated: DataFrame) -> DataFrame:
    """At most one row; not part of the issue totals."""
    rows = chapter_totals(original, translated).where("o <> t").select(S(None).cast("string").alias("key"), S(None).cast("string").alias("original_file"), "o", "t")
    o, t = F.col("o"), F.col("t")
    entry = _entry(0, "formatting", "high", "chapter structure", F.format_string("Chapter count mismatch: %d original vs %d translated", o, t), F.format_string("%d chapters", o), F.format_string("%d chapters", t), S("Ensure all chapters are translated"))
    return _issues(rows, F.array(entry)).drop("chapter_num", "original_file", "check_ord")


def _result(rows: DataFrame, file: Column, check: int, pos: Column, category: str, item: Column, status: Column, details: Column, original: Column, translated: Column) -> DataFrame:
    return rows.select(
        file.alias("file_name"), S(check).alias("check_ord"), pos.cast("int").alias("pos"), S(category).alias("category"), item.alias("item"), status.alias("status"), details.alias("details"),
        F.coalesce(original, S("")).alias("original"), F.coalesce(translated, S("")).alias("translated"),
    )


def chapter_mapping(original: DataFrame, translated: DataFrame) -> DataFrame:
    """One row on the chapter counts, one for each numbered original."""
    n = chapter_totals(original, translated)
    o, t = F.col("o"), F.col("t")
    head = _result(n, S(""), 0, S(0), "章节结构", S("章节数量"), F.when(o == t, "PASS").otherwise("WARNING"), F.format_string("原文 %d 章，译文 %d 章", o, t), o.cast("string"), t.cast("string"))
    rows = C.numbered(original).withColumn("key", C.key_of()).join(C.first_by_key(translated).drop("translated"), "key", "left")
    found = F.col("translated_file").isNotNull()
    body = _result(rows, F.col("file_name"), 0, S(1), "章节结构", F.format_string("章节 %s 对应", F.col("key")), F.when(found, "PASS").otherwise("FAIL"), F.when(found, "找到对应译文文件").otherwise("缺少对应译文文件"), F.col("file_name"), F.coalesce("translated_file", S("[缺失]")))
    return head.unionByName(body)


def concept_check(paired: DataFrame) -> DataFrame:
    """Concepts of the original (any case): Chinese form, else English form (same case), else a warning."""
    table = F.array(*(F.struct(S(k).alias("ord"), S(e).alias("eng"), S(c).alias("chn")) for k, (e, c) in enumerate(CONCEPTS)))
    hit = F.filter(table, lambda x: F.contains(F.lower(F.col("original")), F.lower(x["eng"])))
    rows = paired.select("original_file", "translated", F.explode_outer(hit).alias("x")).where("x is not null").select("original_file", "translated", "x.*")
    e, c, t = F.col("eng"), F.col("chn"), F.col("translated")
    is_c, is_e = F.contains(t, c), F.contains(t, e)
    kept = ~is_c & is_e
    return _result(
        rows, F.col("original_file"), 1, F.col("ord"), "语义一致性", F.concat(S("'"), e, F.when(kept, "' 保留").otherwise("' 翻译")),
        F.when(is_c | is_e, "PASS").otherwise("WARNING"),
        F.when(is_c, F.concat(S("正确翻译为 '"), c, S("'"))).when(is_e, "在上下文中保留英文（可能是代码或专有名词）").otherwise("未找到对应翻译"), e,
        F.when(is_c, c).when(is_e, e).otherwise("[未找到]"),
    )


def identifier_check(paired: DataFrame) -> DataFrame:
    """Identifiers of the original at word boundaries; a name listed twice gives two rows."""
    table = F.array(*(F.when(X.has_identifier(F.col("original"), n), F.struct(S(k).alias("ord"), S(n).alias("name"), X.has_identifier(F.col("translated"), n).alias("kept"))) for k, n in enumerate(IDENTIFIERS)))
    rows = paired.select("original_file", F.explode_outer(F.array_compact(table)).alias("x")).where("x is not null").select("original_file", "x.*")
    n, kept = F.col("name"), F.col("kept")
    return _result(rows, F.col("original_file"), 2, F.col("ord"), "技术术语保留", F.concat(S("'"), n, S("' 类名/方法名")), F.when(kept, "PASS").otherwise("FAIL"), F.when(kept, "正确保留英文").otherwise("技术术语丢失"), n, F.when(kept, n).otherwise("[丢失]"))


def html_code_check(paired: DataFrame) -> DataFrame:
    rows = paired.select("original_file", X.count(F.col("original"), X.HTML_CODE).alias("o"), X.count(F.col("translated"), X.HTML_CODE).alias("t"))
    o, t = F.col("o"), F.col("t")
    return _result(rows, F.col("original_file"), 3, S(0), "代码块检查", S("代码块数量"), F.when(o == t, "PASS").otherwise("WARNING"), F.format_string("原文 %d 个代码块，译文 %d 个代码块", o, t), o.cast("string"), t.cast("string"))


def code_block_pairs(paired: DataFrame) -> DataFrame:
    """The first five blocks of both sides, paired by place up to the shorter side."""
    a, b = X.every(F.col("original"), X.HTML_CODE, 1), X.every(F.col("translated"), X.HTML_CODE, 1)
    rows = paired.select("original_file", a.alias("a"), b.alias("b")).withColumn("n", F.least(F.lit(5), F.size("a"), F.size("b")))
    zipped = F.arrays_zip(F.slice("a", 1, F.col("n")).alias("a"), F.slice("b", 1, F.col("n")).alias("b"))
    rows = rows.select("original_file", F.posexplode(zipped).alias("i", "z")).select("original_file", "i", X.squeeze(F.col("z.a")).alias("a"), X.squeeze(F.col("z.b")).alias("b"))
    same = F.col("a") == F.col("b")
    return _result(rows, F.col("original_file"), 3, F.col("i") + 1, "代码块检查", F.format_string("代码块 %d 内容", F.col("i") + 1), F.when(same, "PASS").otherwise("WARNING"), F.when(same, "代码内容完全保留").otherwise("代码内容有差异"), X.preview(F.col("a")), F.when(same, "[一致]").otherwise(X.preview(F.col("b"))))


def image_alt_check(paired: DataFrame) -> DataFrame:
    """One row on the counts, then the first five images of the translation."""
    n = paired.select("original_file", X.count(F.col("original"), X.HTML_IMAGE).alias("o"), X.count(F.col("translated"), X.HTML_IMAGE).alias("t"))
    o, t = F.col("o"), F.col("t")
    head = _result(n, F.col("original_file"), 4, S(0), "图片检查", S("图片数量"), F.when(t >= o, "PASS").otherwise("WARNING"), F.format_string("原文 %d 张图片（可能为链接），译文 %d 张图片", o, t), o.cast("string"), t.cast("string"))
    rows = paired.select("original_file", F.posexplode(F.slice(X.every(F.col("translated"), X.HTML_IMAGE, 2), 1, 5)).alias("i", "alt"))
    alt = F.col("alt")
    good = (alt != "") & (alt != "图片")
    body = _result(rows, F.col("original_file"), 4, F.col("i") + 1, "图片检查", F.format_string("图片 %d 描述", F.col("i") + 1), F.when(good, "PASS").otherwise("WARNING"), F.when(good, F.concat(S("有描述性alt文本: '"), alt, S("'"))).otherwise("缺少描述性alt文本"), S(""), F.when(good, alt).when(alt == "", "[无]").otherwise(alt))
    return head.unionByName(body)


def all_results(original: DataFrame, translated: DataFrame) -> DataFrame:
    """The second audit: structure of all chapters, content of the sample."""
    sample = C.pairs(C.sample_first(original), translated)
    return reduce(DataFrame.unionByName, [chapter_mapping(original, translated), concept_check(sample), identifier_check(sample), html_code_check(sample), code_block_pairs(sample), image_alt_check(sample)])
