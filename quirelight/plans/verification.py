"""The verification report by its template: structure, images, recognised code, translation, what somebody has to look at."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import alignment as A
from ..operators import chapters as C
from ..operators import checks as K
from ..operators import sampling as S
from ..operators import toc as T

#: Code blocks and chapters that are checked for the report.
BLOCKS, CHAPTERS = 10, 3


def _mark(good: Column) -> Column:
    return F.when(good, "✅").otherwise("❌")


def structure(original: DataFrame, translated: DataFrame) -> DataFrame:
    """One row: chapters, images and depth of headings of both editions."""

    def side(df: DataFrame, name: str) -> DataFrame:
        own = C.chapters(df)
        found = T.tree(T.headings(own.select(F.col("file_name").alias("id"), F.col("content").alias("text"))))
        counts = own.agg(F.count("*").alias(f"{name}_chapters"), F.coalesce(F.sum(F.regexp_count("content", F.lit(X.MD_IMAGE))), F.lit(0)).cast("long").alias(f"{name}_images"))
        return counts.crossJoin(found.agg(F.coalesce(F.max("depth"), F.lit(0)).alias(f"{name}_depth")))  # single rows

    return side(original, "o").crossJoin(side(translated, "t"))


def structure_lines(original: DataFrame, translated: DataFrame) -> DataFrame:
    rows = [("章节数", "chapters"), ("图片数", "images"), ("目录层级", "depth")]
    line = lambda k, label, c: F.struct(F.lit(k).alias("ord"), F.concat(F.format_string(f"| {label} | %d | %d | ", f"o_{c}", f"t_{c}"), _mark(F.col(f"o_{c}") == F.col(f"t_{c}")), F.lit(" |")).alias("line"))
    return structure(original, translated).select(F.lit(0).alias("part"), F.inline(F.array(*(line(k, *r) for k, r in enumerate(rows)))))


def code_lines(paired: DataFrame) -> DataFrame:
    """A sample of code blocks of all chapters, and how many are the same in both editions."""
    rows = K.code_block_pairs(paired).withColumn("name", F.concat_ws("#", "file_name", "pos"))
    drawn = S.stratified(rows, "name", F.lit("code"), F.lit(BLOCKS))
    counts = drawn.agg(F.count("*").alias("n"), F.count_if(F.col("status") == "PASS").alias("good"))
    rate = F.when(F.col("n") > 0, F.concat(F.round(100 * F.col("good") / F.col("n")).cast("long").cast("string"), F.lit("%"))).otherwise("-")
    lines = [F.format_string("- 抽样数量: %d", "n"), F.format_string("- 准确数量: %d", "good"), F.concat(F.lit("- 准确率: "), rate)]
    return counts.select(F.lit(2).alias("part"), F.inline(F.array(*(F.struct(F.lit(k).alias("ord"), x.alias("line")) for k, x in enumerate(lines)))))


def translation_lines(paired: DataFrame) -> DataFrame:
    """A sample of chapters, and whether their identifiers are kept."""
    drawn = S.stratified(paired, "key", F.lit("chapter"), F.lit(CHAPTERS))
    lost = K.identifier_check(drawn).agg(F.count_if(F.col("status") == "FAIL").alias("lost"))
    rows = drawn.agg(F.count("*").alias("n")).crossJoin(lost)  # single rows
    lines = [F.format_string("- 抽样章节: %d", "n"), F.concat(F.lit("- 技术术语保留: "), _mark(F.col("lost") == 0))]
    return rows.select(F.lit(3).alias("part"), F.inline(F.array(*(F.struct(F.lit(k).alias("ord"), x.alias("line")) for k, x in enumerate(lines)))))


def difference_lines(paired: DataFrame) -> DataFrame:
    """What became of the original's images: kept, recognised as code, replaced by another, of another kind, or missing, each with its share.

    And the differences that are not expected, by kind of block and class, the most frequent first. Both come from one alignment: its summary has a row for
    each kind and class and becomes one row.
    """
    ways = [("same", "保留"), ("recognised", "OCR"), ("image", "替换"), ("kind", "其他"), ("missing", "缺失")]
    rows = A.summary(paired).withColumn("image", F.col("kind") == "image")
    counted = lambda c: F.coalesce(F.sum(F.when(F.col("image") & c, F.col("n_steps"))), F.lit(0))
    problem = F.struct((-F.col("n_steps")).alias("order"), "kind", "difference", "n_steps", "n_chapters")
    # an image that was added is none of the original's
    one = rows.agg(counted(F.col("difference") != "added").alias("n"), *(counted(F.col("difference") == c).alias(c) for c, _ in ways), F.array_sort(F.collect_list(F.when(~F.col("expected"), problem))).alias("problems"))
    share = lambda c: F.when(F.col("n") > 0, F.concat(F.round(100 * F.col(c) / F.col("n")).cast("long").cast("string"), F.lit("%"))).otherwise("-")
    row = lambda part, k, line: F.struct(F.lit(part).alias("part"), k.cast("int").alias("ord"), line.alias("line"))
    images = F.array(*(row(1, F.lit(k), F.concat(F.format_string(f"| 图片 | %d | {way} | ", c), share(c), F.lit(" |"))) for k, (c, way) in enumerate(ways)))
    told = lambda x, k: row(4, k + 1, F.concat((k + 1).cast("string"), F.format_string(". %s %s：%d 处，%d 章", x["kind"], x["difference"], x["n_steps"], x["n_chapters"])))
    return one.select(F.inline(F.concat(images, F.transform("problems", told))))


def template_lines(original: DataFrame, translated: DataFrame) -> DataFrame:
    """part, ord, line of the report's five sections, to be joined in that order under their headings."""
    paired = C.pairs(original, translated)
    return reduce(DataFrame.unionByName, [structure_lines(original, translated), difference_lines(paired), code_lines(paired), translation_lines(paired)])


#: Headings of the sections and heads of their tables.
HEADINGS = [
    "## 结构完整性\n| 指标 | 原版 | 新版 | 状态 |\n|------|------|------|------|", "## 图片处理统计\n| 类型 | 数量 | 处理方式 | 成功率 |\n|------|------|----------|--------|",
    "## OCR 准确性", "## 翻译质量", "## 异常问题列表",
]


def template_report(original: DataFrame, translated: DataFrame, title: str, generated: str) -> str:
    """The report as one text; its lines are few: sections of fixed length, and one line for each kind of problem."""
    rows = template_lines(original, translated).orderBy("part", "ord").collect()
    out = [f"# {title}", f"\n## 验证时间\n{generated}"]
    for k, head in enumerate(HEADINGS):
        out += ["", head, *(r["line"] for r in rows if r["part"] == k)]
    return "\n".join(out) + "\n"
