"""Queries over the driver's tables and their SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .fixtures import CHAPTERS, editions
from .functions import text as X
from .functions.lexicon import CATEGORIES, CONCEPTS, IDENTIFIERS, TERMS
from .operators import chapters as C
from .operators import checks as K
from .operators import enhance as E
from .operators import listening as H
from .operators import sampling as S
from .plans import reports as R

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _values(rows: list[tuple]) -> str:
    quote = lambda v: str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    return ", ".join("(" + ", ".join(map(quote, r)) + ")" for r in rows)


W = r"[\p{L}\p{N}_]"
WS = r"[\t-\r\x1c-\x20\x{85}\p{Z}]"
#: Common table expressions, each used by the ones below it.
BASE = CHAPTERS.rstrip() + rf""",
o AS (SELECT file_name, content, regexp_extract(file_name, '^([0-9]+)_', 1) AS key FROM original_chapters WHERE NOT starts_with(file_name, '00_') AND NOT contains(file_name, '_report')),
t AS (SELECT file_name, content, regexp_extract(file_name, '^([0-9]+)_', 1) AS key, row_number() OVER (PARTITION BY regexp_extract(file_name, '^([0-9]+)_', 1) ORDER BY file_name) AS n FROM translated_chapters),
pairs AS (SELECT o.key, o.file_name AS original_file, o.content AS original, t.file_name AS translated_file, t.content AS translated FROM o JOIN t ON o.key = t.key AND t.n = 1 AND o.key <> ''),
terms(term) AS (VALUES {_values([(t,) for t in TERMS])}),
concepts(ord, eng, chn) AS (VALUES {_values([(k, *c) for k, c in enumerate(CONCEPTS)])}),
identifiers(ord, name) AS (VALUES {_values(list(enumerate(IDENTIFIERS)))}),
totals AS (SELECT (SELECT count(*) FROM o) AS o, (SELECT count(*) FROM translated_chapters WHERE NOT starts_with(file_name, '00_') AND NOT contains(file_name, '_report')) AS t),
counted AS (SELECT *, len(regexp_extract_all(original, '```[\s\S]*?```')) + len(regexp_extract_all(original, '(?m)^>')) AS oc, len(regexp_extract_all(translated, '```[\s\S]*?```')) + len(regexp_extract_all(translated, '(?m)^>')) AS tc,
  len(regexp_extract_all(original, '!\[.*?\]\(.*?\)')) AS oi, len(regexp_extract_all(translated, '!\[.*?\]\(.*?\)')) AS ti FROM pairs),
issues AS (
  SELECT CAST(key AS BIGINT) AS chapter_num, original_file, 1 AS check_ord, 'technical_term' AS type, 'high' AS severity, 'content' AS location, 'Technical term "' || term || '" not preserved in translation' AS description, term AS original, '[MISSING]' AS translated, 'Keep "' || term || '" in English' AS suggestion
  FROM pairs, terms WHERE contains(original, term) AND NOT contains(translated, term)
  UNION ALL SELECT CAST(key AS BIGINT), original_file, 2, 'formatting', 'high', 'code blocks', 'Code block count mismatch: ' || oc || ' original vs ' || tc || ' translated', oc || ' code blocks', tc || ' code blocks', 'Ensure all code blocks are preserved' FROM counted WHERE oc <> tc
  UNION ALL SELECT CAST(key AS BIGINT), original_file, 3, 'formatting', 'medium', 'images', 'Image count mismatch: ' || oi || ' original vs ' || ti || ' translated', oi || ' images', ti || ' images', 'Ensure all images are preserved' FROM counted WHERE oi <> ti),
stats AS (SELECT CAST(key AS BIGINT) AS chapter_num, regexp_replace(original_file, '\.[^.]+$', '') AS chapter_title, original_file, translated_file, length(original) AS original_chars, length(translated) AS translated_chars,
  CAST(len(regexp_extract_all(original, '[^\t-\r\x1c-\x20\x{{85}}\p{{Z}}]+')) AS BIGINT) AS original_words, CAST(len(regexp_extract_all(translated, '[^\t-\r\x1c-\x20\x{{85}}\p{{Z}}]+')) AS BIGINT) AS translated_words FROM pairs),
first3 AS (SELECT * FROM (SELECT file_name FROM original_chapters ORDER BY file_name LIMIT 3) WHERE NOT starts_with(file_name, '00_') AND NOT contains(file_name, '_report') AND regexp_matches(file_name, '^[0-9]+_'))"""


def checks_sql(pairs: str, name: str) -> str:
    """The content checks of the second audit over a table of pairs, as name0 (concepts) to name4."""
    code = r"'(?s)<blockquote[^>]*>(.*?)</blockquote>', 1"
    image = "'<img[^>]*src=\"([^\"]+)\"[^>]*alt=\"([^\"]*)\"[^>]*/?>'"
    squeezed = lambda x: f"regexp_replace(regexp_replace({x}, '{WS}+', ' ', 'g'), '^ | $', '', 'g')"
    short = lambda x: f"CASE WHEN length({x}) > 50 THEN substring({x}, 1, 50) || '...' ELSE {x} END"
    return rf""",
{name}1 AS (SELECT original_file AS file_name, 1 AS check_ord, CAST(ord AS INTEGER) AS pos, '语义一致性' AS category, '''' || eng || CASE WHEN NOT contains(translated, chn) AND contains(translated, eng) THEN ''' 保留' ELSE ''' 翻译' END AS item,
  CASE WHEN contains(translated, chn) OR contains(translated, eng) THEN 'PASS' ELSE 'WARNING' END AS status,
  CASE WHEN contains(translated, chn) THEN '正确翻译为 ''' || chn || '''' WHEN contains(translated, eng) THEN '在上下文中保留英文（可能是代码或专有名词）' ELSE '未找到对应翻译' END AS details, eng AS original,
  CASE WHEN contains(translated, chn) THEN chn WHEN contains(translated, eng) THEN eng ELSE '[未找到]' END AS translated FROM {pairs}, concepts WHERE contains(lower(original), lower(eng))),
{name}2 AS (SELECT original_file AS file_name, 2 AS check_ord, CAST(ord AS INTEGER) AS pos, '技术术语保留' AS category, '''' || name || ''' 类名/方法名' AS item, CASE WHEN kept THEN 'PASS' ELSE 'FAIL' END AS status,
  CASE WHEN kept THEN '正确保留英文' ELSE '技术术语丢失' END AS details, name AS original, CASE WHEN kept THEN name ELSE '[丢失]' END AS translated
  FROM (SELECT *, regexp_matches(translated, '(?:^|[^\p{{L}}\p{{N}}_])' || name || '(?:$|[^\p{{L}}\p{{N}}_])') AS kept FROM {pairs}, identifiers WHERE regexp_matches(original, '(?:^|[^\p{{L}}\p{{N}}_])' || name || '(?:$|[^\p{{L}}\p{{N}}_])'))),
{name}3a AS (SELECT original_file AS file_name, regexp_extract_all(original, {code}) AS a, regexp_extract_all(translated, {code}) AS b FROM {pairs}),
{name}3 AS (SELECT file_name, 3 AS check_ord, 0 AS pos, '代码块检查' AS category, '代码块数量' AS item, CASE WHEN len(a) = len(b) THEN 'PASS' ELSE 'WARNING' END AS status, '原文 ' || len(a) || ' 个代码块，译文 ' || len(b) || ' 个代码块' AS details, CAST(len(a) AS VARCHAR) AS original, CAST(len(b) AS VARCHAR) AS translated FROM {name}3a),
{name}3b AS (SELECT file_name, CAST(i AS INTEGER) AS i, {squeezed('a[i]')} AS a, {squeezed('b[i]')} AS b FROM (SELECT *, unnest(range(1, least(5, len(a), len(b)) + 1)) AS i FROM {name}3a)),
{name}4 AS (SELECT file_name, 3 AS check_ord, i AS pos, '代码块检查' AS category, '代码块 ' || i || ' 内容' AS item, CASE WHEN a = b THEN 'PASS' ELSE 'WARNING' END AS status, CASE WHEN a = b THEN '代码内容完全保留' ELSE '代码内容有差异' END AS details, {short('a')} AS original, CASE WHEN a = b THEN '[一致]' ELSE {short('b')} END AS translated FROM {name}3b),
{name}5a AS (SELECT original_file AS file_name, len(regexp_extract_all(original, {image})) AS o, regexp_extract_all(translated, {image}, 2) AS alts FROM {pairs}),
{name}5 AS (SELECT file_name, 4 AS check_ord, 0 AS pos, '图片检查' AS category, '图片数量' AS item, CASE WHEN len(alts) >= o THEN 'PASS' ELSE 'WARNING' END AS status, '原文 ' || o || ' 张图片（可能为链接），译文 ' || len(alts) || ' 张图片' AS details, CAST(o AS VARCHAR) AS original, CAST(len(alts) AS VARCHAR) AS translated FROM {name}5a
  UNION ALL SELECT file_name, 4, CAST(i AS INTEGER), '图片检查', '图片 ' || i || ' 描述', CASE WHEN alts[i] NOT IN ('', '图片') THEN 'PASS' ELSE 'WARNING' END, CASE WHEN alts[i] NOT IN ('', '图片') THEN '有描述性alt文本: ''' || alts[i] || '''' ELSE '缺少描述性alt文本' END, '', CASE WHEN alts[i] = '' THEN '[无]' ELSE alts[i] END
  FROM (SELECT *, unnest(range(1, least(5, len(alts)) + 1)) AS i FROM {name}5a)),
{name}0 AS (SELECT '' AS file_name, 0 AS check_ord, 0 AS pos, '章节结构' AS category, '章节数量' AS item, CASE WHEN o = t THEN 'PASS' ELSE 'WARNING' END AS status, '原文 ' || o || ' 章，译文 ' || t || ' 章' AS details, CAST(o AS VARCHAR) AS original, CAST(t AS VARCHAR) AS translated FROM totals
  UNION ALL SELECT o.file_name, 0, 1, '章节结构', '章节 ' || o.key || ' 对应', CASE WHEN t.key IS NULL THEN 'FAIL' ELSE 'PASS' END, CASE WHEN t.key IS NULL THEN '缺少对应译文文件' ELSE '找到对应译文文件' END, o.file_name, coalesce(t.file_name, '[缺失]') FROM o LEFT JOIN t ON o.key = t.key AND t.n = 1 WHERE o.key <> ''),
{name} AS (SELECT * FROM {name}0 UNION ALL SELECT * FROM {name}1 UNION ALL SELECT * FROM {name}2 UNION ALL SELECT * FROM {name}3 UNION ALL SELECT * FROM {name}4 UNION ALL SELECT * FROM {name}5)"""


CHECKED = BASE + checks_sql("pairs", "c")
RESULTS = BASE + ",\nsampled AS (SELECT pairs.* FROM pairs JOIN first3 ON original_file = first3.file_name)" + checks_sql("sampled", "r")


def both(name: str, sql: str, with_: str = BASE):
    """Register a query over (original, translated) chapters."""

    def put(f: Callable[[DataFrame, DataFrame], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(*editions(spark, sf_dir))
        ORACLES[name] = with_ + "\n" + sql if with_ else sql
        return f

    return put


def table(name: str, source: str, sql: str | None):
    """Register a query over one driver table."""

    def put(f: Callable[[DataFrame], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(spark.read.parquet(f"{sf_dir}/{source}.parquet"))
        if sql is not None:
            ORACLES[name] = sql
        return f

    return put


def derived(name: str, columns: str, sql: str):
    """Register a query over columns that SQL of both engines derives from the documents."""

    def put(f: Callable[[DataFrame], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(spark.read.parquet(f"{sf_dir}/documents.parquet").select(*(F.expr(c) for c in columns.split("; "))))
        made = columns.replace("; ", ", ")
        ORACLES[name] = f"WITH input AS (SELECT {made} FROM documents)\n{sql}"
        return f

    return put


P = C.pairs
both("scan_chapters", "SELECT file_name, length(content) AS n_chars, md5(content) AS content_md5 FROM original_chapters")(lambda o, t: o.select("file_name", X.newlines(F.col("content")).alias("c")).select("file_name", F.length("c").cast("long").alias("n_chars"), F.md5("c").alias("content_md5")))
both("filter_chapters", "SELECT file_name FROM o")(lambda o, t: C.chapters(o).select("file_name"))
both("filter_numbered", "SELECT file_name FROM o WHERE key <> ''")(lambda o, t: C.numbered(o).select("file_name"))
both("chapter_key", "SELECT file_name, regexp_extract(file_name, '^([0-9]+)_', 1) AS key FROM original_chapters")(lambda o, t: o.select("file_name", C.key_of().alias("key")))
both("chapter_pairs", "SELECT key, original_file, translated_file FROM pairs")(lambda o, t: P(o, t).select("key", "original_file", "translated_file"))
both("chapter_stats", "SELECT * FROM stats")(lambda o, t: C.stats(P(o, t)))
both("missing_terms", "SELECT * FROM issues WHERE check_ord = 1")(lambda o, t: K.missing_terms(P(o, t)))
both("code_block_counts", "SELECT * FROM issues WHERE check_ord = 2")(lambda o, t: K.code_block_counts(P(o, t)))
both("image_counts", "SELECT * FROM issues WHERE check_ord = 3")(lambda o, t: K.image_counts(P(o, t)))
both("chapter_count_issue", "SELECT 'formatting' AS type, 'high' AS severity, 'chapter structure' AS location, 'Chapter count mismatch: ' || o || ' original vs ' || t || ' translated' AS description, o || ' chapters' AS original, t || ' chapters' AS translated, 'Ensure all chapters are translated' AS suggestion FROM totals WHERE o <> t")(K.chapter_count_issue)
both("chapter_count_check", "SELECT o AS n_original, t AS n_translated FROM totals")(lambda o, t: K.chapter_totals(o, t).select(F.col("o").alias("n_original"), F.col("t").alias("n_translated")))
both("all_issues", "SELECT * FROM issues")(lambda o, t: K.all_issues(P(o, t)))
both("issue_summary", "SELECT count(*) AS total_issues, count(*) FILTER (severity = 'high') AS high, count(*) FILTER (severity = 'medium') AS medium, count(*) FILTER (severity = 'low') AS low, (SELECT count(*) FROM pairs) AS chapters_compared FROM issues")(lambda o, t: R.issue_summary(K.all_issues(P(o, t)), P(o, t)))
both("issues_by_type", "SELECT type, count(*) AS n_issues, count(*) FILTER (severity = 'high') AS n_high FROM issues GROUP BY type")(lambda o, t: R.issues_by_type(K.all_issues(P(o, t))))
both("issues_by_type_top10", "SELECT type, CAST(row_number() OVER (PARTITION BY type ORDER BY chapter_num, original_file, check_ord, original) AS INTEGER) AS rank, chapter_num, severity, description, suggestion FROM issues QUALIFY rank <= 10")(lambda o, t: R.issues_by_type_top(K.all_issues(P(o, t))))
both("chapter_issue_detail", "SELECT stats.* EXCLUDE translated_file, n_issues, rank, severity, description FROM stats JOIN (SELECT *, CAST(row_number() OVER (PARTITION BY original_file ORDER BY check_ord, original) AS INTEGER) AS rank, count(*) OVER (PARTITION BY original_file) AS n_issues FROM issues) i ON i.original_file = stats.original_file AND rank <= 5")(lambda o, t: R.chapter_issue_detail(K.all_issues(P(o, t)), P(o, t)))
both("chapter_comparison", "SELECT stats.*, (SELECT count(*) FROM issues WHERE issues.original_file = stats.original_file) AS n_issues FROM stats")(lambda o, t: R.chapter_comparison(K.all_issues(P(o, t)), P(o, t)))
both(
    "issue_report_lines",
    """, s AS (SELECT count(*) AS n, count(*) FILTER (severity = 'high') AS h, count(*) FILTER (severity = 'medium') AS m, count(*) FILTER (severity = 'low') AS l FROM issues),
ranked AS (SELECT *, row_number() OVER (PARTITION BY type ORDER BY chapter_num, original_file, check_ord, original) AS rank FROM issues QUALIFY rank <= 10)
SELECT 1 AS part, '' AS a, 0 AS b, 0 AS c, '- Chapters compared: ' || (SELECT count(*) FROM pairs) AS line
UNION ALL SELECT 1, '', 0, 1, '- Total issues found: ' || n FROM s UNION ALL SELECT 1, '', 0, 2, '  - High severity: ' || h FROM s UNION ALL SELECT 1, '', 0, 3, '  - Medium severity: ' || m FROM s UNION ALL SELECT 1, '', 0, 4, '  - Low severity: ' || l FROM s
UNION ALL SELECT 2, type, 0, 0, '### ' || CASE type WHEN 'technical_term' THEN 'Technical_Term' ELSE 'Formatting' END || ' Issues (' || count(*) || ')' FROM issues GROUP BY type
UNION ALL SELECT 2, type, CAST(rank AS INTEGER), 0, '- **[' || upper(severity) || ']** ' || description FROM ranked UNION ALL SELECT 2, type, CAST(rank AS INTEGER), 1, '  - Suggestion: ' || suggestion FROM ranked""",
)(lambda o, t: R.issue_report_lines(K.all_issues(P(o, t)), P(o, t)))
both("chapter_mapping", "SELECT * FROM c0", CHECKED)(K.chapter_mapping)
both("concept_check", "SELECT * FROM c1", CHECKED)(lambda o, t: K.concept_check(P(o, t)))
both("identifier_check", "SELECT * FROM c2", CHECKED)(lambda o, t: K.identifier_check(P(o, t)))
both("html_code_check", "SELECT * FROM c3", CHECKED)(lambda o, t: K.html_code_check(P(o, t)))
both("code_block_pairs", "SELECT * FROM c4", CHECKED)(lambda o, t: K.code_block_pairs(P(o, t)))
both("image_alt_check", "SELECT * FROM c5", CHECKED)(lambda o, t: K.image_alt_check(P(o, t)))
both("sample_first3", "SELECT file_name FROM first3")(lambda o, t: C.sample_first(o).select("file_name"))
both("all_results", "SELECT * FROM r", RESULTS)(K.all_results)
both("verification_summary", "SELECT count(*) FILTER (status = 'PASS') AS pass, count(*) FILTER (status = 'FAIL') AS fail, count(*) FILTER (status = 'WARNING') AS warning, count(*) AS total FROM r", RESULTS)(lambda o, t: R.verification_summary(K.all_results(o, t)))
both("results_by_category", "SELECT category, min(check_ord) AS first_seen, count(*) AS n_items, count(*) FILTER (status = 'PASS') AS n_pass FROM r GROUP BY category", RESULTS)(lambda o, t: R.results_by_category(K.all_results(o, t)))
both(
    "verification_report_lines",
    """, icons AS (SELECT *, CASE status WHEN 'PASS' THEN '✅' WHEN 'FAIL' THEN '❌' ELSE '⚠️' END AS icon FROM r)
SELECT check_ord, file_name, pos, 0 AS c, icon || ' **' || item || '**: ' || status AS line FROM icons UNION ALL SELECT check_ord, file_name, pos, 1, '   - ' || details FROM icons
UNION ALL SELECT check_ord, file_name, pos, 2, '   - 原文: `' || original || '` → 译文: `' || translated || '`' FROM icons WHERE original <> '' OR translated <> ''""",
    RESULTS,
)(lambda o, t: R.verification_report_lines(K.all_results(o, t)))
both(
    "md_prose",
    r", a AS (SELECT file_name, regexp_replace(regexp_replace(regexp_replace(regexp_replace(content, '```[\s\S]*?```', '', 'g'), '`[^`]+`', '', 'g'), '!\[.*?\]\(.*?\)', '', 'g'), '\[([^\]]+)\]\([^)]+\)', '\1', 'g') AS x FROM original_chapters)" + f"\nSELECT file_name, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(x, '(?m)^#+{WS}+', '', 'g'), '(?m)^>{WS}+', '', 'g'), '(?m)^---+$', '', 'g'), '^{WS}+|{WS}+\\z', '', 'g')) AS prose_md5 FROM a",
)(lambda o, t: o.select("file_name", F.md5(X.md_prose(F.col("content"))).alias("prose_md5")))
both("code_blocks", r"SELECT file_name, CAST(i AS INTEGER) AS pos, regexp_extract_all(content, '```[\s\S]*?```')[i] AS code FROM (SELECT *, unnest(range(1, len(regexp_extract_all(content, '```[\s\S]*?```')) + 1)) AS i FROM original_chapters)")(lambda o, t: o.select("file_name", F.posexplode(X.every(F.col("content"), X.FENCE)).alias("i", "code")).select("file_name", (F.col("i") + 1).alias("pos"), "code"))
both("html_code_blocks", r"SELECT file_name, unnest(regexp_extract_all(content, '(?s)<blockquote[^>]*>(.*?)</blockquote>', 1)) AS code FROM original_chapters")(lambda o, t: o.select("file_name", F.explode(X.every(F.col("content"), X.HTML_CODE, 1)).alias("code")))
both("md_images", r"SELECT file_name, unnest(regexp_extract_all(content, '!\[(.*?)\]\((.*?)\)', 1)) AS alt, unnest(regexp_extract_all(content, '!\[(.*?)\]\((.*?)\)', 2)) AS src FROM original_chapters")(lambda o, t: o.select("file_name", F.inline(X.images(F.col("content"), X.MD_IMAGE, 1, 2))))
both("html_images", "SELECT file_name, unnest(regexp_extract_all(content, '<img[^>]*src=\"([^\"]+)\"[^>]*alt=\"([^\"]*)\"[^>]*/?>', 2)) AS alt, unnest(regexp_extract_all(content, '<img[^>]*src=\"([^\"]+)\"[^>]*alt=\"([^\"]*)\"[^>]*/?>', 1)) AS src FROM translated_chapters")(lambda o, t: t.select("file_name", F.inline(X.images(F.col("content"), X.HTML_IMAGE, 2, 1))))
both("known_terms", "SELECT file_name, term FROM original_chapters, terms WHERE contains(content, term)")(lambda o, t: o.select("file_name", F.explode(X.known(F.col("content"), TERMS)).alias("term")))
both("dict_terms", "SELECT term, count(file_name) AS n_chapters FROM terms LEFT JOIN original_chapters ON contains(content, term) GROUP BY term")(lambda o, t: o.select(F.inline(F.array(*(F.struct(F.lit(x).alias("term"), F.contains("content", F.lit(x)).alias("held")) for x in TERMS)))).groupBy("term").agg(F.count_if("held").alias("n_chapters")))
both("image_comment_to_quote", r"SELECT doc_id, md5(regexp_replace('<!-- IMAGE_DESCRIPTION: ' || content || ' -->', '(?s)<!-- IMAGE_DESCRIPTION: (.*?) -->', chr(10) || '> 【图片描述】\1' || chr(10), 'g')) AS text_md5 FROM original_chapters")(lambda o, t: o.select("doc_id", F.md5(E.image_comment_to_quote(F.concat(F.lit("<!-- IMAGE_DESCRIPTION: "), F.col("content"), F.lit(" -->")))).alias("text_md5")))
both("image_path_fix", "SELECT file_name, md5(replace(content, './images/', '../images/')) AS text_md5 FROM original_chapters")(lambda o, t: o.select("file_name", F.md5(E.image_path_fix(F.col("content"))).alias("text_md5")))
both("strip_suffix", "SELECT replace(replace(file_name, '.md', '_with_descriptions.md'), '_with_descriptions.md', '.md') AS file_name FROM original_chapters")(lambda o, t: o.select(E.strip_suffix(F.replace("file_name", F.lit(".md"), F.lit("_with_descriptions.md"))).alias("file_name")))
both("dedupe_title", f"SELECT file_name, md5(CASE WHEN regexp_replace(split_part(regexp_replace(content, '^{WS}+', ''), chr(10), 1), '{WS}+\\z', '') IN ('# Item 7', '#Item 7') THEN content ELSE '# Item 7' || chr(10) || chr(10) || content END) AS text_md5 FROM original_chapters")(lambda o, t: o.select("file_name", F.md5(E.dedupe_title(F.col("content"), F.lit("Item 7"))).alias("text_md5")))
both("fence_line_count", "SELECT CAST(sum(len(regexp_extract_all(content, '(?m)^.*```.*$'))) // 2 AS BIGINT) AS n_blocks FROM original_chapters")(lambda o, t: o.agg(F.floor(F.sum(X.count(F.col("content"), "(?dm)^.*```.*$")) / 2).cast("long").alias("n_blocks")))
both("merge_chapters", "SELECT file_name, md5(CASE WHEN row_number() OVER (ORDER BY file_name) = 1 THEN content ELSE chr(10) || chr(10) || '---' || chr(10) || chr(10) || content END) AS piece_md5 FROM original_chapters WHERE NOT starts_with(file_name, '00_') AND NOT ends_with(file_name, '_report.md')")(lambda o, t: E.merge_chapters(o).select("file_name", F.md5("piece").alias("piece_md5")))
both("toc_count", r"SELECT CAST(len(regexp_extract_all(string_agg('[ch:' || key || ']', ' '), '\[ch:')) AS BIGINT) AS n_entries FROM o")(lambda o, t: C.chapters(o).agg(F.count("*").alias("n_entries")))
both("structure_diff", r"SELECT key, len(regexp_extract_all(original, '[^\n]+(\n[^\n]+)*')) = len(regexp_extract_all(translated, '[^\n]+(\n[^\n]+)*')) AS paragraphs_equal, len(regexp_extract_all(original, '(?m)^[-*] ')) = len(regexp_extract_all(translated, '(?m)^[-*] ')) AS items_equal, oi = ti AS images_equal FROM counted")(lambda o, t: E.structure_diff(P(o, t)))
both("structure_summary", r"SELECT 'original' AS edition, count(*) AS n_chapters, CAST(sum(len(regexp_extract_all(content, '!\[.*?\]\(.*?\)'))) AS BIGINT) AS n_images FROM o UNION ALL SELECT 'translated', count(*), CAST(sum(len(regexp_extract_all(content, '!\[.*?\]\(.*?\)'))) AS BIGINT) FROM translated_chapters WHERE NOT starts_with(file_name, '00_') AND NOT contains(file_name, '_report')")(E.structure_summary)
both("chinese_ratio", rf"SELECT file_name, CAST(len(regexp_extract_all(content, '[\x{{4E00}}-\x{{9FFF}}]')) AS DOUBLE) / len(regexp_extract_all(content, '[^\t-\r\x1c-\x20\x{{85}}\p{{Z}}]')) AS ratio FROM translated_chapters")(lambda o, t: t.select("file_name", E.chinese_ratio(F.col("content")).alias("ratio")))
both("doc_language_gate", rf"SELECT file_name, CASE WHEN r > 0.7 THEN 'skip' WHEN r < 0.3 THEN 'translate_all' ELSE 'mixed' END AS gate FROM (SELECT file_name, CAST(len(regexp_extract_all(content, '[\x{{4E00}}-\x{{9FFF}}]')) AS DOUBLE) / len(regexp_extract_all(content, '[^\t-\r\x1c-\x20\x{{85}}\p{{Z}}]')) AS r FROM translated_chapters)")(lambda o, t: t.select("file_name", E.language_gate(E.chinese_ratio(F.col("content"))).alias("gate")))
both("cap_headings", r"SELECT file_name, md5(regexp_replace(replace(content, '# Item', '##### Item'), '(?m)^#{4,}', '###', 'g')) AS text_md5 FROM original_chapters")(lambda o, t: o.select("file_name", F.md5(E.cap_headings(F.replace("content", F.lit("# Item"), F.lit("##### Item")))).alias("text_md5")))
both("mask_terms", "SELECT file_name, md5(replace(replace(content, 'ArrayList', '⟦T0⟧'), 'String', '⟦T1⟧')) AS text_md5 FROM original_chapters")(lambda o, t: o.select("file_name", F.md5(E.mask_terms(F.col("content"), ["ArrayList", "String"])).alias("text_md5")))
table("html_prose", "pages", rf"""SELECT page_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?s)<style[^>]*>.*?</style>', '', 'g'), '(?s)<blockquote[^>]*>.*?</blockquote>', '', 'g'), '(?s)<div class="image-container">.*?</div>', '', 'g'), '<[^>]+>', ' ', 'g'), '{WS}+', ' ', 'g'), '^ | $', '', 'g')) AS prose_md5 FROM pages""")(lambda d: d.select("page_id", F.md5(X.html_prose(F.col("html"))).alias("prose_md5")))
table("caps_terms", "documents", r"SELECT DISTINCT doc_id, term FROM (SELECT doc_id, unnest(regexp_extract_all(regexp_replace(text, '([^\p{L}\p{N}_])', '\1\1', 'g'), '(?:^|[^\p{L}\p{N}_])([A-Z]{2,})(?:$|[^\p{L}\p{N}_])', 1)) AS term FROM documents)")(lambda d: d.select("doc_id", F.explode(F.array_distinct(X.every(F.col("text"), X.CAPS))).alias("term")))
table("camel_terms", "pages", r"SELECT DISTINCT page_id, term FROM (SELECT page_id, unnest(regexp_extract_all(regexp_replace(html, '([^\p{L}\p{N}_])', '\1\1', 'g'), '(?:^|[^\p{L}\p{N}_])([A-Z][a-z]+(?:[A-Z][a-z]+)+)(?:$|[^\p{L}\p{N}_])', 1)) AS term FROM pages)")(lambda d: d.select("page_id", F.explode(F.array_distinct(X.every(F.col("html"), X.CAMEL))).alias("term")))
table("method_terms", "pages", r"SELECT DISTINCT page_id, term FROM (SELECT page_id, unnest(regexp_extract_all(regexp_replace(html, '([^\p{L}\p{N}_])', '\1\1', 'g'), '(?:^|[^\p{L}\p{N}_])([a-z][a-zA-Z0-9]*)\(', 1)) AS term FROM pages)")(lambda d: d.select("page_id", F.explode(F.array_distinct(X.every(F.col("html"), X.METHOD))).alias("term")))
table("table_line_count", "documents", r"SELECT CAST(sum(len(regexp_extract_all(text, '(?m)^.*\|.*\|.*$'))) AS BIGINT) AS n_lines FROM documents")(lambda d: d.agg(F.sum(X.count(F.col("text"), r"(?dm)^.*\|.*\|.*$")).alias("n_lines")))
table("split_sentences", "documents", r"SELECT doc_id, CAST(i - 1 AS INTEGER) AS pos, s[i] AS sentence FROM (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS i FROM (SELECT doc_id, list_filter(list_transform(regexp_extract_all(text, '[^。！？；.!?;]+[。！？；.!?;]*|[。！？；.!?;]+'), lambda x: regexp_replace(x, '^[\t-\r\x1c-\x20\x{85}\p{Z}]+|[\t-\r\x1c-\x20\x{85}\p{Z}]+\z', '', 'g')), lambda x: x <> '') AS s FROM documents))")(lambda d: d.select("doc_id", F.posexplode(E.sentences(F.col("text"))).alias("pos", "sentence")))
table("term_density", "documents", rf"WITH terms(term) AS (VALUES {_values([(t,) for t in TERMS])}) SELECT doc_id, CAST((SELECT count(*) FROM terms WHERE contains(text, term)) AS DOUBLE) / greatest(1, len(regexp_extract_all(text, '[^\t-\r\x1c-\x20\x{{85}}\p{{Z}}]+'))) AS density FROM documents")(lambda d: d.select("doc_id", E.term_density(F.col("text"), TERMS).alias("density")))
table("term_categories", "documents", f"WITH c(category, term) AS (VALUES {_values([(c, t) for c, ts in CATEGORIES.items() for t in ts])}) SELECT category, term, count(*) AS n_documents FROM documents JOIN c ON contains(text, term) GROUP BY ALL")(lambda d: E.term_categories(d, CATEGORIES))
# files, archives and images that carry documents: names, sizes and kinds follow from the documents
_KINDS = lambda n, *names: "CASE " + " ".join(f"WHEN {n} % {len(names)} = {k} THEN '{x}'" for k, x in enumerate(names)) + " END"
_NAME = f"concat({_KINDS('doc_id', 'fig', 'Cover', 'qrcode', 'photo', 'icon_', 'author', 'chart')}, doc_id, {_KINDS('length(text)', '.jpg', '.PNG', '.png', '.webp', '.svg', '.gif')}) AS name"
_R, _D = rf"CAST(len(regexp_extract_all(text, '[\x{{4E00}}-\x{{9FFF}}]')) AS DOUBLE) / len(regexp_extract_all(text, '[^\t-\r\x1c-\x20\x{{85}}\p{{Z}}]'))", r"CAST((SELECT count(*) FROM terms WHERE contains(text, term)) AS DOUBLE) / greatest(1, len(regexp_extract_all(text, '[^\t-\r\x1c-\x20\x{85}\p{Z}]+')))"
derived("translation_route", "doc_id; text", f", terms(term) AS (VALUES {_values([(t,) for t in TERMS])}), rated AS (SELECT doc_id, {_R} AS ratio, {_D} AS density FROM input) SELECT doc_id, CASE WHEN ratio >= 0.3 OR density > 0.15 THEN 'skip' WHEN density > 0.05 AND ratio < 0.15 THEN 'translate_protected' ELSE 'translate' END AS route FROM rated")(lambda d: d.select("doc_id", E.chinese_ratio(F.col("text")).alias("ratio"), E.term_density(F.col("text"), TERMS).alias("density")).select("doc_id", E.route(F.col("ratio"), F.col("density")).alias("route")))
derived("input_kind", f"concat('in', doc_id, {_KINDS('length(text)', '.epub', '.PDF', '.md', '.markdown', '', '.txt')}) AS name", "SELECT name, CASE WHEN lower(name) LIKE '%.epub' THEN 'epub' WHEN lower(name) LIKE '%.pdf' THEN 'pdf' WHEN lower(name) LIKE '%.md' OR lower(name) LIKE '%.markdown' THEN 'markdown' WHEN NOT contains(name, '.') THEN 'folder' ELSE 'unknown' END AS kind FROM input")(lambda d: d.select("name", E.input_kind(F.col("name")).alias("kind")))
derived("cover_pick", f"concat(source, '-', lang, doc_id % 50) AS archive; doc_id AS ord; concat('OPS/', {_KINDS('length(text)', 'text', 'cover', 'Cover', 'content', 'page', 'back')}, doc_id, {_KINDS('doc_id', '.xhtml', '.JPG', '.opf', '.png', '.svg')}) AS name", "SELECT archive, ord, name, 'cover' AS kind FROM input WHERE regexp_matches(lower(name), 'cover') AND regexp_matches(lower(name), '[.](jpg|jpeg|png)$') QUALIFY row_number() OVER (PARTITION BY archive ORDER BY ord) = 1 UNION ALL SELECT archive, ord, name, 'opf' FROM input WHERE ends_with(name, '.opf') AND archive NOT IN (SELECT archive FROM input WHERE regexp_matches(lower(name), 'cover') AND regexp_matches(lower(name), '[.](jpg|jpeg|png)$'))")(E.cover_pick)
derived("image_file_count", f"source; {_NAME}", "SELECT source, count(*) AS n_images FROM input WHERE regexp_matches(name, '[.](jpg|png|gif|webp)$') GROUP BY source")(lambda d: d.where(E.is_image("name")).groupBy("source").agg(F.count("*").alias("n_images")))
derived("image_filter", f"{_NAME}; length(text) AS size; length(text) % 600 AS width; length(text) % 300 + 20 AS height", "SELECT name, NOT (regexp_matches(lower(name), 'qr_?code|cover|author|decoration|emoji|icon') OR size < 500 OR width < 50 OR height < 50) AS kept FROM input")(lambda d: d.select("name", E.image_passes().alias("kept")))
derived("image_route", f"{_NAME}; {_KINDS('doc_id', 'CODE_SCREENSHOT', 'TABLE_IMAGE', 'TEXT_SCREENSHOT', 'DIAGRAM', 'CHART', 'OTHER')} AS image_class; text AS body", "SELECT name, md5(CASE image_class WHEN 'CODE_SCREENSHOT' THEN '<!-- ' || name || ' -->' || chr(10) || '```java' || chr(10) || body || chr(10) || '```' || chr(10) || '> 【代码说明】' WHEN 'TABLE_IMAGE' THEN '<!-- ' || name || ' -->' || chr(10) || body || chr(10) || '> 【表格说明】' WHEN 'TEXT_SCREENSHOT' THEN body ELSE '![](' || name || ')' || chr(10) || '> 【图片描述】' || body END) AS markdown_md5 FROM input")(lambda d: d.select("name", F.md5(E.image_route()).alias("markdown_md5")))
derived("cover_decision", "doc_id; CASE WHEN lang = 'fr' THEN 'u.png' ELSE '' END AS user_cover; CASE WHEN doc_id % 3 > 0 THEN 'o.png' ELSE '' END AS original_cover; length(text) % 2 AS accepted; doc_id % 2 AS has_api_key", "SELECT doc_id, CASE WHEN user_cover <> '' THEN 'user' WHEN original_cover <> '' AND accepted = 1 THEN 'original' WHEN has_api_key = 1 THEN 'ai' ELSE 'programmatic' END AS cover FROM input")(lambda d: d.select("doc_id", E.cover_decision().alias("cover")))
# one point a line of the text
_TENS = "['', '十', '二十', '三十', '四十', '五十', '六十', '七十', '八十', '九十'][i // 10 + 1] || ['', '一', '二', '三', '四', '五', '六', '七', '八', '九'][i % 10 + 1]"
derived("image_description", "doc_id; source AS kind; lang AS conclusion; left(text, 20) AS elements; replace(replace(text, ';', ','), chr(10), ';') AS points", f"SELECT doc_id, md5('> **图片说明**：This is a ' || kind || '.' || chr(10) || '> 核心结论是：' || conclusion || chr(10) || '> 关键元素包括：' || elements || chr(10) || '> 要点总结：' || array_to_string(list_transform(list_filter(list_transform(string_split(points, ';'), lambda x: trim(x, ' ')), lambda x: x <> ''), lambda x, i: chr(10) || '> - 第' || CASE WHEN i <= 99 THEN {_TENS} ELSE CAST(i AS VARCHAR) END || '，' || x), '')) AS note_md5 FROM input")(lambda d: d.select("doc_id", F.md5(E.image_description()).alias("note_md5")))
derived("detect_code_language", "doc_id; text AS code", E.LANGUAGE_SQL.replace("SELECT code,", "SELECT doc_id, code,").replace("SELECT doc_id, code, CASE", "SELECT doc_id, CASE", 1))(lambda d: d.select("doc_id", E.detect_language(F.col("code")).alias("language")))
derived("narrate_lists", "doc_id AS id; concat('- ', replace(text, chr(10), concat(chr(10), '- '))) AS body", r"SELECT id, CAST(i AS INTEGER) AS pos, '第' || i || '点：' || x[i] AS sentence FROM (SELECT id, x, unnest(range(1, len(x) + 1)) AS i FROM (SELECT id, regexp_extract_all(body, '(?m)^[-*] (.*)$', 1) AS x FROM input))")(lambda d: d.select("id", F.posexplode(E.list_items(F.col("body"))).alias("i", "x")).select("id", (F.col("i") + 1).alias("pos"), F.concat(F.lit("第"), (F.col("i") + 1).cast("string"), F.lit("点："), "x").alias("sentence")))
# a table of the lines of a text, with its length beside each
derived("narrate_tables", "doc_id AS id; concat('| line | of |', chr(10), '|---|---|', chr(10), '| ', replace(replace(text, '|', '/'), chr(10), concat(' | ', lang, ' |', chr(10), '| ')), ' | ', lang, ' |') AS body", r""", l AS (SELECT id, regexp_extract_all(body, '(?m)^\|(.*)\|$', 1) AS x FROM input), r AS (SELECT id, list_transform(x, lambda y: list_transform(string_split(y, '|'), lambda z: trim(z))) AS x FROM l WHERE len(x) > 2)
SELECT id, CAST(i - 2 AS INTEGER) AS row, array_to_string(list_transform(list_zip(x[1], x[i]), lambda z: z[1] || '：' || z[2]), '，') || '。' AS sentence FROM (SELECT id, x, unnest(range(3, len(x) + 1)) AS i FROM r)""")(E.narrate_tables)


# code, keywords, notes and format of chapters: the input has bare code, marked items and headings beside what the chapters have
_BARE = "replace(replace(content, 'Use String', 'Call CPool.GetServiceConnection(long id) or Map<String, Object> of MAX_SIZE.' || chr(10) || 'void run_all(){' || chr(10) || 'int a = 1;' || chr(10) || '}' || chr(10) || '* one' || chr(10) || '#Title' || chr(10) || '| a | b |' || chr(10) || '|---|---|' || chr(10) || 'Use String'), '> note', chr(9) || '> note')"
BARE = BASE + f",\nbare AS (SELECT file_name, {_BARE} AS content FROM original_chapters)"
_HITS = lambda x: [(n, f"len(regexp_extract_all({x}, '{p}'))") for n, p in E.LANGUAGES]
_BEST = lambda x: f"greatest({', '.join(c for _, c in _HITS(x))})"
_LANGUAGE = lambda x: f"CASE WHEN {_BEST(x)} = 0 THEN 'text' " + " ".join(f"WHEN {c} = {_BEST(x)} THEN '{n}'" for n, c in _HITS(x)) + " END"
_RUN = f"'(?m){H.CODE_RUN}'"
FENCED = BARE + rf""",
parts AS (SELECT file_name, string_split_regex(content, {_RUN}) AS ps, regexp_extract_all(content, {_RUN}) AS cs FROM bare),
fenced AS (SELECT file_name, array_to_string(list_transform(range(1, len(ps) + 1), lambda i: ps[i] || coalesce(CASE WHEN starts_with(cs[i], '```') THEN cs[i] ELSE chr(10) || '```' || {_LANGUAGE("cs[i]")} || chr(10) || cs[i] || chr(10) || '```' END, '')), '') AS content,
  CAST(len(list_filter(cs, lambda c: NOT starts_with(c, '```'))) AS BIGINT) AS code_blocks_wrapped FROM parts),
marked AS (SELECT file_name, code_blocks_wrapped, content, regexp_replace(content, '{H.KEYWORD}', '\1' || chr(1) || '\2' || chr(2) || '\3', 'g') AS m FROM fenced),
enhanced AS (SELECT file_name, code_blocks_wrapped, translate(replace(m, chr(1) || chr(2), ''), chr(1) || chr(2), '``') AS content, CAST(length(replace(m, chr(1) || chr(2), '')) - length(replace(replace(m, chr(1) || chr(2), ''), chr(1), '')) AS BIGINT) AS keywords_highlighted FROM marked)"""
_STRIP = lambda x: f"regexp_replace({x}, '^{WS}+|{WS}+\\z', '', 'g')"
_SENTENCES = lambda x: f"list_filter(list_transform(regexp_extract_all({x}, '[^。！？；.!?;]+[。！？；.!?;]*|[。！？；.!?;]+'), lambda y: {_STRIP('y')}), lambda y: y <> '')"
_LONG = lambda x: f"flatten(list_transform(list_filter(list_transform(string_split({x}, chr(10)), lambda l: {_STRIP('l')}), lambda l: l <> ''), lambda l: CASE WHEN length(l) <= 80 THEN [l] ELSE {_SENTENCES('l')} END))"
_COUNTERS = f", counters AS (SELECT count(*) AS files, CAST(sum(code_blocks_wrapped) AS BIGINT) AS code_blocks_wrapped, CAST(sum(keywords_highlighted) AS BIGINT) AS keywords_highlighted, CAST(sum(len(regexp_extract_all(content, '!\\[.*?\\]\\(.*?\\)'))) AS BIGINT) AS images, CAST(sum(len({_LONG('content')})) AS BIGINT) AS lines_read FROM enhanced)"


def bare(o: DataFrame) -> DataFrame:
    return o.select("file_name", F.expr(_BARE).alias("content"))


both("fence_code", "SELECT file_name, code_blocks_wrapped, md5(content) AS text_md5 FROM fenced", FENCED)(lambda o, t: bare(o).select("file_name", H.blocks_wrapped(F.col("content")).alias("code_blocks_wrapped"), F.md5(H.fence_code(F.col("content"))).alias("text_md5")))
both("highlight_keywords", "SELECT file_name, code_blocks_wrapped, keywords_highlighted, md5(content) AS text_md5 FROM enhanced", FENCED)(lambda o, t: H.enhance_code(bare(o)).select("file_name", "code_blocks_wrapped", "keywords_highlighted", F.md5("content").alias("text_md5")))
both("run_counters", _COUNTERS + " SELECT * FROM counters", FENCED)(lambda o, t: H.run_counters(bare(o)))
both("processing_report_lines", _COUNTERS + " SELECT 0 AS ord, '- files: ' || files AS line FROM counters UNION ALL SELECT 1, '- code_blocks_wrapped: ' || code_blocks_wrapped FROM counters UNION ALL SELECT 2, '- keywords_highlighted: ' || keywords_highlighted FROM counters UNION ALL SELECT 3, '- images: ' || images FROM counters UNION ALL SELECT 4, '- lines_read: ' || lines_read FROM counters", FENCED)(lambda o, t: R.counter_report_lines(H.run_counters(bare(o))))
both("clean_format", r""", a AS (SELECT file_name, replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(content, '(?m)[ \t]+$', '', 'g'), '(?m)^\t', '  ', 'g'), '(?m)^( *)[*+] ', '\1- ', 'g'), '(?m)^(#{1,6})([^#\s])', '\1 \2', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), './images/', '../images/') AS x FROM bare)
SELECT file_name, md5(CASE WHEN len(regexp_extract_all(x, '(?m)^```')) % 2 = 1 THEN x || chr(10) || '```' ELSE x END) AS text_md5 FROM a""", BARE)(lambda o, t: bare(o).select("file_name", F.md5(H.clean_format(F.col("content"))).alias("text_md5")))
both("add_notes", r"""SELECT file_name, md5(regexp_replace(regexp_replace(content, '(```[^\n]*\n[\s\S]*?\n```)', '\1' || chr(10) || '> 【代码说明】', 'g'), '(?m)(^\|[^\n]*\|$(?:\n^\|[^\n]*\|$)+)', '\1' || chr(10) || '> 【表格说明】', 'g')) AS text_md5 FROM bare""", BARE)(lambda o, t: bare(o).select("file_name", F.md5(H.add_notes(F.col("content"))).alias("text_md5")))
both("chapter_intro", f"SELECT file_name, '本章介绍：' || regexp_extract(content, '(?m)^#+ +([^\\n]*)$', 1) || '。本章小结：' || array_to_string(({_SENTENCES(chr(39).join(['regexp_replace(content, ', '(?m)^#+ [^\\n]*$', ', ', '', ', ', 'g', ')']))})[1:2], '') AS intro FROM original_chapters")(lambda o, t: o.select("file_name", H.chapter_intro(F.col("content")).alias("intro")))
both("technical_terms", r""", doubled AS (SELECT file_name, content, regexp_replace(content, '([^\p{L}\p{N}_])', '\1\1', 'g') AS x FROM original_chapters)
SELECT file_name, term FROM original_chapters, terms WHERE contains(content, term)
UNION SELECT file_name, unnest(regexp_extract_all(x, '(?:^|[^\p{L}\p{N}_])([A-Z]{2,})(?:$|[^\p{L}\p{N}_])', 1)) FROM doubled
UNION SELECT file_name, unnest(regexp_extract_all(x, '(?:^|[^\p{L}\p{N}_])([A-Z][a-z]+(?:[A-Z][a-z]+)+)(?:$|[^\p{L}\p{N}_])', 1)) FROM doubled
UNION SELECT file_name, unnest(regexp_extract_all(x, '(?:^|[^\p{L}\p{N}_])([a-z][a-zA-Z0-9]*)\(', 1)) FROM doubled""")(lambda o, t: o.select("file_name", F.explode(H.technical_terms(F.col("content"))).alias("term")))
both("distinct_terms", r""", doubled AS (SELECT regexp_replace(content, '([^\p{L}\p{N}_])', '\1\1', 'g') AS x, content FROM original_chapters), every AS (SELECT term FROM original_chapters, terms WHERE contains(content, term)
UNION ALL SELECT unnest(regexp_extract_all(x, '(?:^|[^\p{L}\p{N}_])([A-Z]{2,})(?:$|[^\p{L}\p{N}_])', 1)) FROM doubled
UNION ALL SELECT unnest(regexp_extract_all(x, '(?:^|[^\p{L}\p{N}_])([A-Z][a-z]+(?:[A-Z][a-z]+)+)(?:$|[^\p{L}\p{N}_])', 1)) FROM doubled
UNION ALL SELECT unnest(regexp_extract_all(x, '(?:^|[^\p{L}\p{N}_])([a-z][a-zA-Z0-9]*)\(', 1)) FROM doubled) SELECT DISTINCT term FROM every""")(lambda o, t: o.select(F.explode(H.technical_terms(F.col("content"))).alias("term")).distinct())
both("camel_names", r"SELECT DISTINCT file_name, term FROM (SELECT file_name, unnest(regexp_extract_all(regexp_replace(content, '([^\p{L}\p{N}_])', '\1\1', 'g'), '(?:^|[^\p{L}\p{N}_])([A-Z][a-z]+(?:[A-Z][a-z]+)+)(?:$|[^\p{L}\p{N}_])', 1)) AS term FROM original_chapters)")(lambda o, t: o.select("file_name", F.explode(F.array_distinct(X.every(F.col("content"), X.CAMEL))).alias("term")))
_RATIO = rf"CAST(len(regexp_extract_all(content, '[\x{{4E00}}-\x{{9FFF}}]')) AS DOUBLE) / len(regexp_extract_all(content, '[^\t-\r\x1c-\x20\x{{85}}\p{{Z}}]'))"
_DENSITY = r"CAST((SELECT count(*) FROM terms WHERE contains(content, term)) AS DOUBLE) / greatest(1, len(regexp_extract_all(content, '[^\t-\r\x1c-\x20\x{85}\p{Z}]+')))"
both("route_chapters", f"SELECT *, CASE WHEN ratio >= 0.3 OR density > 0.15 THEN 'skip' WHEN density > 0.05 AND ratio < 0.15 THEN 'translate_protected' ELSE 'translate' END AS route FROM (SELECT file_name, {_RATIO} AS ratio, {_DENSITY} AS density FROM (SELECT file_name, content FROM translated_chapters UNION ALL SELECT file_name, content FROM original_chapters))")(lambda o, t: H.routed(t.select("file_name", "content").unionByName(o.select("file_name", "content"))))
both("chapter_code_languages", f"SELECT language, count(*) AS n_blocks FROM (SELECT {_LANGUAGE('code')} AS language FROM (SELECT unnest(regexp_extract_all(content, '```[\\s\\S]*?```')) AS code FROM original_chapters)) GROUP BY language")(lambda o, t: H.code_languages(o))
both("toc_depth", "SELECT CAST(max(n) AS BIGINT) AS depth, count(DISTINCT n) AS levels FROM (SELECT length(unnest(regexp_extract_all(content, '(?m)^(#{1,6}) ', 1))) AS n FROM bare)", BARE)(lambda o, t: H.toc_depth(bare(o)))
both("toc_entries", r"SELECT file_name, CAST(len(regexp_extract_all(replace(content, '![fig', '[ch:fig'), '\[ch:')) AS BIGINT) AS n_entries FROM original_chapters")(lambda o, t: H.toc_entries(o.withColumn("content", F.replace("content", F.lit("![fig"), F.lit("[ch:fig")))))
both("chapter_list_narration", r"SELECT file_name, CAST(i AS INTEGER) AS pos, '第' || i || '点：' || x[i] AS sentence FROM (SELECT file_name, x, unnest(range(1, len(x) + 1)) AS i FROM (SELECT file_name, regexp_extract_all(content, '(?m)^[-*] (.*)$', 1) AS x FROM bare))", BARE)(lambda o, t: bare(o).select("file_name", F.posexplode(E.list_items(F.col("content"))).alias("i", "x")).select("file_name", (F.col("i") + 1).alias("pos"), F.concat(F.lit("第"), (F.col("i") + 1).cast("string"), F.lit("点："), "x").alias("sentence")))
both("chapter_report_lines", """, ranked AS (SELECT stats.*, n_issues, rank, severity, description FROM stats JOIN (SELECT *, row_number() OVER (PARTITION BY original_file ORDER BY check_ord, original) AS rank, count(*) OVER (PARTITION BY original_file) AS n_issues FROM issues) i ON i.original_file = stats.original_file AND rank <= 5)
SELECT chapter_num, original_file, 0 AS c, '### Chapter ' || chapter_num || ': ' || chapter_title AS line FROM ranked WHERE rank = 1 UNION ALL SELECT chapter_num, original_file, 1, '- Original: ' || original_chars || ' chars, ' || original_words || ' words' FROM ranked WHERE rank = 1
UNION ALL SELECT chapter_num, original_file, 2, '- Translated: ' || translated_chars || ' chars, ' || translated_words || ' words' FROM ranked WHERE rank = 1 UNION ALL SELECT chapter_num, original_file, 3, '- Issues: ' || n_issues FROM ranked WHERE rank = 1
UNION ALL SELECT chapter_num, original_file, CAST(rank + 3 AS INTEGER), '  - [' || severity || '] ' || description FROM ranked""")(lambda o, t: R.chapter_report_lines(K.all_issues(P(o, t)), P(o, t)))
both("verification_heading_lines", """, s AS (SELECT count(*) FILTER (status = 'PASS') AS p, count(*) FILTER (status = 'FAIL') AS f, count(*) FILTER (status = 'WARNING') AS w FROM r)
SELECT 0 AS part, 0 AS a, '- ✅ 通过: ' || p AS line FROM s UNION ALL SELECT 0, 1, '- ❌ 失败: ' || f FROM s UNION ALL SELECT 0, 2, '- ⚠️ 警告: ' || w FROM s UNION ALL SELECT 1, min(check_ord), '### ' || category FROM r GROUP BY category""", RESULTS)(lambda o, t: R.verification_heading_lines(K.all_results(o, t)))
both("success_rates", "SELECT category, count(*) AS n_items, CAST(count(*) FILTER (status = 'PASS') AS DOUBLE) / count(*) AS rate FROM c GROUP BY category", CHECKED)(lambda o, t: R.success_rates(K.chapter_mapping(o, t).unionByName(K.concept_check(P(o, t))).unionByName(K.identifier_check(P(o, t))).unionByName(K.html_code_check(P(o, t))).unionByName(K.code_block_pairs(P(o, t))).unionByName(K.image_alt_check(P(o, t)))))
both("structure_report_lines", r""", n AS (SELECT (SELECT count(*) FROM o) AS oc, (SELECT count(*) FROM translated_chapters WHERE NOT starts_with(file_name, '00_') AND NOT contains(file_name, '_report')) AS tc, (SELECT sum(len(regexp_extract_all(content, '!\[.*?\]\(.*?\)'))) FROM o) AS oi, (SELECT sum(len(regexp_extract_all(content, '!\[.*?\]\(.*?\)'))) FROM translated_chapters WHERE NOT starts_with(file_name, '00_') AND NOT contains(file_name, '_report')) AS ti)
SELECT 0 AS ord, '| 章节数 | ' || oc || ' | ' || tc || ' | ' || CASE WHEN oc = tc THEN '✅' ELSE '❌' END || ' |' AS line FROM n UNION ALL SELECT 1, '| 图片数 | ' || oi || ' | ' || ti || ' | ' || CASE WHEN oi = ti THEN '✅' ELSE '❌' END || ' |' FROM n""")(lambda o, t: R.structure_report_lines(E.structure_summary(o, t)))
table("long_sentences", "documents", f"SELECT doc_id, CAST(i - 1 AS INTEGER) AS pos, s[i] AS line FROM (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS i FROM (SELECT doc_id, {_LONG('text')} AS s FROM documents))")(lambda d: d.select("doc_id", F.posexplode(H.long_sentences(F.col("text"))).alias("pos", "line")))


@table("sample_chapters", "documents", "SELECT doc_id, source FROM documents ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id LIMIT 5")
def sample_chapters(d: DataFrame) -> DataFrame:
    """A deterministic sample of five chapters, by hash."""
    return d.select("doc_id", "source").orderBy(S.rank_key(F.col("doc_id")), "doc_id").limit(5)
