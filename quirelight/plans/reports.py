"""Aggregations and report lines over issue and result rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators import chapters as C

ISSUE_ORDER = ["chapter_num", "original_file", "check_ord", "original"]
RESULT_ORDER = ["check_ord_group", "file_name", "check_ord", "pos", "item"]


def issue_summary(issues: DataFrame, paired: DataFrame) -> DataFrame:
    severity = lambda s: F.count_if(F.col("severity") == s).alias(s)
    return issues.agg(F.count("*").alias("total_issues"), severity("high"), severity("medium"), severity("low")).crossJoin(paired.agg(F.count("*").alias("chapters_compared")))


def issues_by_type(issues: DataFrame) -> DataFrame:
    return issues.groupBy("type").agg(F.count("*").alias("n_issues"), F.count_if(F.col("severity") == "high").alias("n_high"))


def _first(issues: DataFrame, by: list[str], n: int) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(*ISSUE_ORDER)
    return issues.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def issues_by_type_top(issues: DataFrame, n: int = 10) -> DataFrame:
    return _first(issues, ["type"], n).select("type", "rank", "chapter_num", "severity", "description", "suggestion")


def chapter_issue_detail(issues: DataFrame, paired: DataFrame, n: int = 5) -> DataFrame:
    """Statistics, number of issues and the first n issues of each chapter that has any."""
    keys = ["chapter_num", "original_file"]
    # numbers and issues come from one pass over the issues: they are found from the texts each time they are asked for
    ranked = F.row_number().over(Window.partitionBy(*keys).orderBy(*ISSUE_ORDER))
    total = F.count("*").over(Window.partitionBy(*keys))
    shown = issues.withColumn("rank", ranked).withColumn("n_issues", total).where(F.col("rank") <= n).select(*keys, "n_issues", "rank", "severity", "description")
    return C.stats(paired).join(shown, keys).drop("translated_file")


def chapter_comparison(issues: DataFrame, paired: DataFrame) -> DataFrame:
    """A row per pair, with or without issues."""
    total = issues.groupBy("original_file").agg(F.count("*").alias("n_issues"))
    return C.stats(paired).join(total, "original_file", "left").na.fill(0, ["n_issues"])


def title_of(kind: Column) -> Column:
    """str.title() keeps the underscore and capitalises after it."""
    return F.array_join(F.transform(F.split(kind, "_"), F.initcap), "_")


def issue_report_lines(issues: DataFrame, paired: DataFrame) -> DataFrame:
    """The Markdown report as rows (part, a, b, c, line), to be joined in that order; without the time stamp."""
    severities = ("high", "medium", "low")
    # totals of each type and of all in one pass; the row of all types has no type
    counts = issues.rollup("type").agg(F.grouping("type").alias("every"), F.count("*").alias("n"), *(F.count_if(F.col("severity") == x).alias(x) for x in severities))
    compared = paired.agg(F.count("*").alias("chapters_compared"))
    row = lambda part, a, b, c, line: F.struct(F.lit(part).alias("part"), a.cast("string").alias("a"), F.lit(b).cast("int").alias("b"), F.lit(c).alias("c"), line.alias("line"))
    none = F.lit("")
    total = [("- Chapters compared: %d", "chapters_compared"), ("- Total issues found: %d", "n"), ("  - High severity: %d", "high"), ("  - Medium severity: %d", "medium"), ("  - Low severity: %d", "low")]
    heads = F.when(F.col("every") == 1, F.array(*(row(1, none, 0, k, F.format_string(text, F.col(c))) for k, (text, c) in enumerate(total))))
    heads = heads.otherwise(F.array(row(2, F.col("type"), 0, 0, F.format_string("### %s Issues (%d)", title_of(F.coalesce("type", none)), F.col("n")))))
    out = counts.crossJoin(F.broadcast(compared)).select(F.inline(heads))
    shown = F.array(row(2, F.col("type"), 0, 0, F.format_string("- **[%s]** %s", F.upper("severity"), F.col("description"))), F.when(F.col("suggestion").isNotNull(), row(2, F.col("type"), 0, 1, F.format_string("  - Suggestion: %s", F.col("suggestion")))))
    top = _first(issues, ["type"], 10).select("rank", F.explode(F.array_compact(shown)).alias("x"))
    return out.unionByName(top.select("x.part", "x.a", F.col("rank").alias("b"), "x.c", "x.line"))


def verification_summary(results: DataFrame) -> DataFrame:
    status = lambda s: F.count_if(F.col("status") == s).alias(s.lower())
    return results.agg(status("PASS"), status("FAIL"), status("WARNING"), F.count("*").alias("total"))


def results_by_category(results: DataFrame) -> DataFrame:
    """Categories in the order first seen, which is the order of the checks."""
    return results.groupBy("category").agg(F.min("check_ord").alias("first_seen"), F.count("*").alias("n_items"), F.count_if(F.col("status") == "PASS").alias("n_pass"))


def verification_report_lines(results: DataFrame) -> DataFrame:
    icon = F.when(F.col("status") == "PASS", "✅").when(F.col("status") == "FAIL", "❌").otherwise("⚠️")
    lines = F.array(
        F.concat(icon, F.lit(" **"), "item", F.lit("**: "), "status"),
        F.concat(F.lit("   - "), "details"),
        F.when((F.col("original") != "") | (F.col("translated") != ""), F.concat(F.lit("   - 原文: `"), "original", F.lit("` → 译文: `"), "translated", F.lit("`"))),
    )
    return results.select("check_ord", "file_name", "pos", F.posexplode(lines).alias("c", "line")).where("line is not null")


def chapter_report_lines(issues: DataFrame, paired: DataFrame) -> DataFrame:
    """The part on chapters of the issue report, as rows (chapter_num, original_file, c, line): those with issues, and the first five of each."""
    rows = chapter_issue_detail(issues, paired)
    head = F.array(
        F.format_string("### Chapter %d: %s", "chapter_num", "chapter_title"),
        F.format_string("- Original: %d chars, %d words", "original_chars", "original_words"),
        F.format_string("- Translated: %d chars, %d words", "translated_chars", "translated_words"),
        F.format_string("- Issues: %d", "n_issues"),
    )
    keys = ["chapter_num", "original_file"]
    # the first issue of a chapter brings the heading with it
    own = F.array(F.struct((F.col("rank") + 3).alias("c"), F.format_string("  - [%s] %s", "severity", "description").alias("line")))
    heads = F.transform(head, lambda x, k: F.struct(k.alias("c"), x.alias("line")))
    return rows.select(*keys, F.inline(F.when(F.col("rank") == 1, F.concat(heads, own)).otherwise(own)))


def verification_heading_lines(results: DataFrame) -> DataFrame:
    """The totals and the headings of categories of the second report, as rows (part, a, line)."""
    s = verification_summary(results)
    lines = F.array(F.format_string("- ✅ 通过: %d", "pass"), F.format_string("- ❌ 失败: %d", "fail"), F.format_string("- ⚠️ 警告: %d", "warning"))
    totals = s.select(F.lit(0).alias("part"), F.posexplode(lines).alias("a", "line"))
    return totals.unionByName(results_by_category(results).select(F.lit(1).alias("part"), F.col("first_seen").alias("a"), F.concat(F.lit("### "), "category").alias("line")))


def success_rates(results: DataFrame) -> DataFrame:
    """Share of the items of each category that passed."""
    return results.groupBy("category").agg(F.count("*").alias("n_items"), (F.count_if(F.col("status") == "PASS") / F.count("*")).alias("rate"))


def counter_report_lines(counters: DataFrame) -> DataFrame:
    """The counters of a run as lines of a report."""
    named = F.array(*(F.struct(F.lit(k).alias("ord"), F.format_string(f"- {c}: %d", F.col(c)).alias("line")) for k, c in enumerate(counters.columns)))
    return counters.select(F.inline(named))


def structure_report_lines(summary: DataFrame) -> DataFrame:
    """The table of both editions' structure, given structure_summary()."""
    one = summary.agg(*(F.max(F.when(F.col("edition") == e, F.col(c))).alias(f"{e}_{c}") for e in ("original", "translated") for c in ("n_chapters", "n_images")))
    row = lambda k, label, c: F.struct(F.lit(k).alias("ord"), F.format_string(f"| {label} | %d | %d | %s |", f"original_{c}", f"translated_{c}", F.when(F.col(f"original_{c}") == F.col(f"translated_{c}"), "✅").otherwise("❌")).alias("line"))
    return one.select(F.inline(F.array(row(0, "章节数", "n_chapters"), row(1, "图片数", "n_images"))))


def issue_report(issues: DataFrame, paired: DataFrame, generated: str) -> str:
    """The whole issue report as one text; generated is its time stamp. Its lines are few: totals, ten issues a type, five a chapter."""
    rows = issue_report_lines(issues, paired).orderBy("part", "a", "b", "c").collect()
    out = ["# EPUB Quality Comparison Report", f"Generated: {generated}", "## Summary", *(r["line"] for r in rows if r["part"] == 1), "## Issues by Type", *(r["line"] for r in rows if r["part"] == 2), "## Chapter Details"]
    out += [r["line"] for r in chapter_report_lines(issues, paired).orderBy("chapter_num", "original_file", "c").toLocalIterator()]
    return "\n".join(out) + "\n"


def verification_report(results: DataFrame, generated: str) -> str:
    """The whole second report as one text."""
    heads = verification_heading_lines(results).orderBy("part", "a").collect()
    out = ["# EPUB 详细质量核对报告", f"生成时间: {generated}", "## 总结", *(r["line"] for r in heads if r["part"] == 0), "## 详细结果"]
    lines = verification_report_lines(results).orderBy("check_ord", "file_name", "pos", "c").collect()  # of three sampled chapters and the mapping
    for head in (r for r in heads if r["part"] == 1):
        out += [head["line"], *(r["line"] for r in lines if r["check_ord"] == head["a"])]
    return "\n".join(out) + "\n"
