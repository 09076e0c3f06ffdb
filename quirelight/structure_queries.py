"""Queries on the structure of editions and their SQL, registered beside those of queries.py."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.lexicon import TERMS
from .operators import acronyms as Y
from .operators import alignment as A
from .operators import answers as K
from .operators import assets as G
from .operators import chapters as C
from .operators import dictionary as D
from .operators import enhance as E
from .operators import listening as N
from .operators import paragraphs as H
from .operators import sampling as S
from .operators import tables as B
from .operators import toc as T
from .operators.providers import Echo
from .plans import verification as V
from .queries import _LANGUAGE, BARE, BASE, ORACLES, QUERIES, bare, both, checks_sql

P = C.pairs

# --- alignment: the same program as a recursion over diagonals ---
_BLOCKS = lambda x: f"list_transform(regexp_extract_all(coalesce({x}, ''), '(?m)^{A.BLOCK}'), lambda x: {{'kind': {A.KIND_SQL.format('x')}, 'size': length(x), 'name': {A.NAME_SQL.format('x')}}})"
_SIZE = lambda x: f"greatest(1, coalesce(list_sum(list_transform({x}, lambda y: y.size)), 0))"


def _steps() -> str:
    o, t = (lambda k: f"o[i - {k - 1}]"), (lambda k: f"t[j - {k - 1}]")
    three = lambda a, b, c, far: f"CASE WHEN {a}.kind = 'paragraph' AND {b}.kind = 'paragraph' AND {c}.kind = 'paragraph' THEN {A.JOIN} + CAST(floor({far} / 2.0e0) AS INT) END"
    cost = [
        A.match_cost(o(1), t(1)),
        str(A.SKIP),
        str(A.SKIP),
        three(o(2), o(1), t(1), A.deviation(f"({o(2)}.size + {o(1)}.size)", f"{t(1)}.size")),
        three(o(1), t(2), t(1), A.deviation(f"{o(1)}.size", f"({t(2)}.size + {t(1)}.size)")),
    ]
    parts = [f"CASE WHEN i >= {x} AND j >= {y} THEN 8 * ((d{x + y}[j + 1 - {y}] >> 3) + {c}) + {k} END" for k, ((x, y), c) in enumerate(zip(A.STEPS, cost))]
    return f"CASE WHEN i BETWEEN 0 AND len(o) THEN least({', '.join(parts)}) END"


_STEP = lambda side: f"CASE step {' '.join(f'WHEN {k} THEN {s[side]}' for k, s in enumerate(A.STEPS))} END"
ALIGNED = (
    BASE.replace("WITH original_chapters", "WITH RECURSIVE original_chapters", 1)
    + f""",
cut AS (SELECT key, {_BLOCKS("original")} AS o, {_BLOCKS("translated")} AS t FROM pairs),
sized AS MATERIALIZED (SELECT *, CAST({_SIZE("o")} AS INT) AS os, CAST({_SIZE("t")} AS INT) AS ts FROM cut WHERE len(o) + len(t) > 0),
diagonal AS (SELECT key, o, t, os, ts, 0 AS s, list_transform(range(0, len(t) + 1), lambda j: CASE WHEN j = 0 THEN 0 END) AS d1, CAST(NULL AS INT[]) AS d2, CAST(NULL AS INT[]) AS d3 FROM sized
  UNION ALL SELECT key, o, t, os, ts, s + 1, list_transform(range(0, len(t) + 1), lambda j: list_transform([s + 1 - j], lambda i: {_steps()})[1]), d1, d2 FROM diagonal WHERE s < len(o) + len(t)),
cells AS MATERIALIZED (SELECT key, s, d1 FROM diagonal),
back AS (SELECT key, len(o) AS i, len(t) AS j, 0 AS k, 0 AS x, 0 AS y FROM sized
  UNION ALL SELECT key, i - {_STEP(0)}, j - {_STEP(1)}, k + 1, {_STEP(0)}, {_STEP(1)} FROM (SELECT b.key, i, j, k, d.d1[j + 1] % 8 AS step FROM back b JOIN cells d ON d.key = b.key AND d.s = i + j WHERE i + j > 0)),
taken AS (SELECT b.key, CAST(row_number() OVER (PARTITION BY b.key ORDER BY k DESC) AS INT) AS step, i, j, x, y, os, ts, o[i + 1] AS a, t[j + 1] AS b, o[i + 1 : i + x] AS oo, t[j + 1 : j + y] AS tt FROM back b JOIN sized z ON z.key = b.key WHERE k > 0),
judged AS (SELECT *, CASE WHEN x > 0 AND y > 0 THEN {A.deviation("list_sum(list_transform(oo, lambda z: z.size))", "list_sum(list_transform(tt, lambda z: z.size))")} END AS deviation FROM taken),
named AS (SELECT *, {A.difference("x", "y", "a", "b", "deviation")} AS difference FROM judged),
aligned AS MATERIALIZED (SELECT key, step, i + 1 AS o_from, x AS o_blocks, j + 1 AS t_from, y AS t_blocks, CASE WHEN x > 0 THEN a.kind END AS kind, CASE WHEN y > 0 THEN b.kind END AS t_kind, deviation, difference, {A.expected("difference", "CASE WHEN y > 0 THEN b.kind END")} AS expected FROM named)"""
)
both("edition_alignment", "SELECT key, step, CAST(o_from AS INT) AS o_from, CAST(o_blocks AS INT) AS o_blocks, CAST(t_from AS INT) AS t_from, CAST(t_blocks AS INT) AS t_blocks, kind, t_kind, deviation, difference, expected FROM aligned", ALIGNED)(lambda o, t: A.aligned(P(o, t)))
both("edition_differences", "SELECT coalesce(kind, t_kind) AS kind, difference, expected, count(*) AS n_steps, count(DISTINCT key) AS n_chapters FROM aligned GROUP BY ALL", ALIGNED)(lambda o, t: A.summary(P(o, t)))
both("differences_to_confirm", "SELECT key, step, '- 第' || o_from || '块 / 第' || t_from || '块：' || coalesce(kind, t_kind) || ' ' || difference AS line FROM aligned WHERE NOT expected", ALIGNED)(lambda o, t: A.to_confirm(P(o, t)))


# --- dictionaries of any size ---
def tables(name: str, sql: str):
    """Register a query over driver tables, given by a reader of their names."""

    def put(f):
        QUERIES[name] = lambda spark, sf_dir: f(lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet"))
        ORACLES[name] = sql
        return f

    return put


def lexicon(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(t,) for t in TERMS], "term string")


def benchmark_words(read) -> DataFrame:
    """The different words of the benchmark as a dictionary."""
    return read("benchmark").select(F.explode(F.split("text", r"[ \n]+")).alias("term"))


tables("dictionary_terms", r"WITH w AS (SELECT DISTINCT unnest(regexp_split_to_array(text, '[ \n]+')) AS term FROM benchmark) SELECT doc_id, term FROM documents JOIN w ON term <> '' AND contains(text, term)")(
    lambda read: D.terms_in(read("documents").select(F.col("doc_id").alias("id"), "text"), benchmark_words(read)).withColumnRenamed("id", "doc_id")
)
both("dictionary_lost_terms", "SELECT key, term FROM pairs, terms WHERE contains(original, term) AND NOT contains(translated, term)")(lambda o, t: D.lost_terms(P(o, t), lexicon(o.sparkSession)))


# --- trees of headings ---
_DOCS = lambda read: read("documents").select(F.col("doc_id").alias("id"), "text")
_MARKED = r"""lined AS (SELECT id, i AS place, ls[i] AS line FROM (SELECT id, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT id, string_split(text, chr(10)) AS ls FROM rows))),
fenced AS (SELECT *, coalesce(count(*) FILTER (starts_with(line, '```')) OVER (PARTITION BY id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS fences FROM lined),
found AS (SELECT id, place, length(regexp_extract(line, '^(#{1,6})[ \t]+[^ \t\r#]', 1)) AS level, regexp_replace(regexp_replace(line, '^#{1,6}[ \t]+', ''), '[ \t#\r]+$', '') AS title FROM fenced WHERE fences % 2 = 0 AND regexp_matches(line, '^#{1,6}[ \t]+[^ \t\r#]'))"""
_PLAIN = rf"""lined AS (SELECT doc_id AS id, i AS place, regexp_replace(ls[i], '^[ \t\r]+|[ \t\r]+$', '', 'g') AS title FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents))),
found AS (SELECT * FROM (SELECT id, place, title, CASE WHEN row_number() OVER (PARTITION BY id ORDER BY place) = 1 THEN 1 WHEN length(title) <= {T.SHORT} THEN 3 WHEN length(title) <= {T.MIDDLE} THEN 2 END AS level FROM lined WHERE title <> '') WHERE level IS NOT NULL)"""
# ancestors by walking up, one parent at a time
_TREE = """parents AS (SELECT h.*, (SELECT max(p.place) FROM found p WHERE p.id = h.id AND p.place < h.place AND p.level < h.level) AS parent FROM found h),
up AS (SELECT id, place, level, title, parent, 1 AS depth, title AS path, parent AS above FROM parents
  UNION ALL SELECT u.id, u.place, u.level, u.title, u.parent, depth + 1, p.title || ' / ' || path, p.parent FROM up u JOIN parents p ON p.id = u.id AND p.place = u.above),
tree AS (SELECT id, place, level, title, parent, depth, path, row_number() OVER (PARTITION BY id, parent ORDER BY place) AS sibling FROM up WHERE above IS NULL)"""
_AS_TREE = "SELECT id, CAST(place AS INT) AS place, CAST(level AS INT) AS level, title, CAST(parent AS INT) AS parent, CAST(depth AS INT) AS depth, path, CAST(sibling AS INT) AS sibling FROM tree"
_RECURSIVE = BASE.replace("WITH original_chapters", "WITH RECURSIVE original_chapters", 1)
_FILES = "rows AS (SELECT 'original/' || file_name AS id, content AS text FROM original_chapters UNION ALL SELECT 'translated/' || file_name, content FROM translated_chapters)"


def edition_rows(o: DataFrame, t: DataFrame) -> DataFrame:
    """id, text of the files of both editions."""
    one = lambda df, name: df.select(F.concat(F.lit(f"{name}/"), "file_name").alias("id"), F.col("content").alias("text"))
    return one(o, "original").unionByName(one(t, "translated"))


tables("toc_tree", f"WITH RECURSIVE {_PLAIN}, {_TREE} {_AS_TREE}")(lambda read: T.tree(T.plain_headings(_DOCS(read))))
tables("toc_lines", f"WITH RECURSIVE {_PLAIN}, {_TREE} SELECT id, CAST(place AS INT) AS place, repeat('  ', CAST(depth - 1 AS INT)) || '- ' || title AS line FROM tree")(lambda read: T.contents_lines(T.plain_headings(_DOCS(read))))
both("edition_toc_tree", f", {_FILES}, {_MARKED}, {_TREE} {_AS_TREE}", _RECURSIVE)(lambda o, t: T.tree(T.headings(edition_rows(o, t))))
both(
    "toc_comparison",
    f""", rows AS (SELECT 'o' || key AS id, original AS text FROM pairs UNION ALL SELECT 't' || key, translated FROM pairs), {_MARKED}, {_TREE},
each AS (SELECT id, count(*) AS n, max(depth) AS depth, string_agg(CAST(depth AS VARCHAR), ',' ORDER BY place) AS outline FROM tree GROUP BY id)
SELECT key, coalesce(a.n, 0) AS o_n_headings, coalesce(b.n, 0) AS t_n_headings, CAST(coalesce(a.depth, 0) AS INT) AS o_depth, CAST(coalesce(b.depth, 0) AS INT) AS t_depth, coalesce(a.outline, '') = coalesce(b.outline, '') AS same_outline
FROM pairs LEFT JOIN each a ON a.id = 'o' || key LEFT JOIN each b ON b.id = 't' || key""",
    _RECURSIVE,
)(lambda o, t: T.compared(P(o, t)))

# --- tables told ---
tables(
    "table_sentences",
    rf"""WITH lined AS (SELECT doc_id AS id, i AS place, ls[i] AS line FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents))),
bars AS (SELECT *, place - row_number() OVER (PARTITION BY id ORDER BY place) AS island, regexp_matches(line, '{B.RULE}') AS rule FROM lined WHERE contains(replace(line, chr(92) || '|', ''), '|')),
cut AS (SELECT *, row_number() OVER w - 1 AS k, list_transform(string_split(regexp_replace(replace(line, chr(92) || '|', chr(57345)), '^[ 	]*\|?|\|?[ 	
]*$', '', 'g'), '|'), lambda x: replace(regexp_replace(x, '^[ 	]+|[ 	]+$', '', 'g'), chr(57345), '|')) AS cells FROM bars WINDOW w AS (PARTITION BY id, island ORDER BY place)),
headed AS (SELECT id, island, bool_or(k = 1 AND rule) AS head, any_value(cells) FILTER (k = 0) AS names FROM cut GROUP BY id, island),
data AS (SELECT c.id, c.island, place, cells, CASE WHEN head THEN names END AS names FROM cut c JOIN headed h ON h.id = c.id AND h.island = c.island WHERE NOT rule AND NOT (head AND k = 0))
SELECT id, CAST(place AS INT) AS place, CAST(row_number() OVER (PARTITION BY id, island ORDER BY place) AS INT) AS row, coalesce(array_to_string(list_filter(list_transform(range(1, len(cells) + 1), lambda i: CASE WHEN cells[i] <> '' THEN coalesce(names[i], '第' || i || '列') || '：' || cells[i] END), lambda x: x IS NOT NULL), '，'), '') || '。' AS sentence FROM data""",
)(lambda read: B.told(_DOCS(read)))

# --- images that lead nowhere ---
_REFERENCES = lambda side: rf"""SELECT file_name, unnest(regexp_extract_all(content, '!\[(.*?)\]\((.*?)\)', 2) || regexp_extract_all(content, '<img[^>]*src="([^"]+)"[^>]*alt="([^"]*)"[^>]*/?>', 1)) AS reference FROM {side}"""
_ASSETS = "assets AS (SELECT 'book/images/' || doc_id || '.png' AS path FROM original_chapters UNION SELECT 'book/chapters/a/' || doc_id || '.png' FROM original_chapters WHERE doc_id % 2 = 0)"


def _dangling_sql(content: str) -> str:
    # the fixture's references have one leading ./ or ../ at most
    return f""", {_ASSETS}, files AS (SELECT file_name, {content} AS content FROM translated_chapters), refs AS ({_REFERENCES("files")}),
paths AS (SELECT *, CASE WHEN starts_with(reference, '../') THEN 'book/' || substr(reference, 4) WHEN starts_with(reference, './') THEN 'book/chapters/' || substr(reference, 3) ELSE 'book/chapters/' || reference END AS path FROM refs)
SELECT 'missing' AS problem, file_name, reference, path FROM paths WHERE path NOT IN (SELECT path FROM assets) UNION ALL SELECT 'unused', NULL, NULL, path FROM assets WHERE path NOT IN (SELECT path FROM paths)"""


def _assets(o: DataFrame) -> DataFrame:
    """Where the images are: those of Markdown beside the chapters' folder, of the others half in it."""
    path = lambda top: F.concat(F.lit(top), F.col("doc_id").cast("string"), F.lit(".png")).alias("path")
    return o.select(path("book/images/")).unionByName(o.where("doc_id % 2 = 0").select(path("book/chapters/a/")))


both("dangling_images", _dangling_sql("content"))(lambda o, t: G.dangling(G.references(t, F.lit("book/chapters")), _assets(o)))
both("dangling_images_fixed", _dangling_sql("replace(content, './images/', '../images/')"))(lambda o, t: G.dangling(G.references(t.withColumn("content", E.image_path_fix(F.col("content"))), F.lit("book/chapters")), _assets(o)))

# --- paragraphs: route and batch ---
_NOT = r"[^\t-\r\x1c-\x20\x{85}\p{Z}]"
_R = lambda x: rf"CASE WHEN len(regexp_extract_all({x}, '{_NOT}')) > 0 THEN CAST(len(regexp_extract_all({x}, '[\x{{4E00}}-\x{{9FFF}}]')) AS DOUBLE) / len(regexp_extract_all({x}, '{_NOT}')) ELSE 0 END"
_ROUTED = rf""", texts AS (SELECT 'original/' || file_name AS id, content AS text FROM original_chapters UNION ALL SELECT 'translated/' || file_name, content FROM translated_chapters),
gated AS (SELECT *, CASE WHEN r > 0.7 THEN 'skip' WHEN r < 0.3 THEN 'translate_all' ELSE 'mixed' END AS gate FROM (SELECT *, {_R("text")} AS r FROM texts WHERE text IS NOT NULL)),
lined AS (SELECT id, gate, i AS place, ls[i] AS line FROM (SELECT id, gate, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT id, gate, string_split(text, chr(10)) AS ls FROM gated))),
rated AS (SELECT *, {_R("line")} AS ratio, CAST((SELECT count(*) FROM terms WHERE contains(line, term)) AS DOUBLE) / greatest(1, len(regexp_extract_all(line, '{_NOT}+'))) AS density, len(regexp_extract_all(line, '[\x{{4E00}}-\x{{9FFF}}]')) AS wide FROM lined WHERE regexp_matches(line, '{_NOT}')),
own AS (SELECT *, CASE WHEN ratio >= 0.3 OR density > 0.15 THEN 'skip' WHEN density > 0.05 AND ratio < 0.15 THEN 'translate_protected' ELSE 'translate' END AS o FROM rated),
paragraphs AS (SELECT id, place, line AS text, gate, CASE gate WHEN 'skip' THEN 'skip' WHEN 'mixed' THEN o ELSE CASE o WHEN 'translate' THEN o ELSE 'translate_protected' END END AS route, wide + CAST(ceil((length(line) - wide) / 3.0) AS BIGINT) AS tokens FROM own)"""
_BUDGET = 200
both(
    "route_paragraphs",
    _ROUTED + rf""" SELECT id, CAST(place AS INT) AS place, md5(text) AS text_md5, gate, route, CAST(tokens AS BIGINT) AS tokens, CASE WHEN route <> 'skip' THEN CAST(coalesce(sum(CASE WHEN route <> 'skip' THEN tokens ELSE 0 END) OVER (PARTITION BY id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) // {_BUDGET} AS BIGINT) END AS batch FROM paragraphs""",
)(lambda o, t: H.batched(H.route_paragraphs(edition_rows(o, t), TERMS), _BUDGET).select("id", "place", F.md5("text").alias("text_md5"), "gate", "route", "tokens", "batch"))

# --- samples ---
tables("stratified_sample", "SELECT doc_id, stratum, CAST(draw AS INT) AS draw FROM (SELECT doc_id, coalesce(lang, '') AS stratum, row_number() OVER (PARTITION BY coalesce(lang, '') ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) AS draw FROM documents) WHERE draw <= 5")(
    lambda read: S.stratified(read("documents").select("doc_id", "lang"), "doc_id", F.coalesce("lang", F.lit("")), F.lit(5)).select("doc_id", "stratum", "draw")
)
tables(
    "sample_shares",
    """WITH c AS (SELECT source AS stratum, count(*) AS n_rows FROM documents GROUP BY source), f AS (SELECT *, sum(n_rows) OVER () AS n FROM c),
d AS (SELECT *, n_rows * 60 // n AS whole, row_number() OVER (ORDER BY n_rows * 60 % n DESC, stratum NULLS FIRST) AS place FROM f)
SELECT stratum, n_rows, CAST(least(n_rows, greatest(1, whole + CASE WHEN place <= 60 - (SELECT sum(whole) FROM d) THEN 1 ELSE 0 END)) AS BIGINT) AS quota FROM d""",
)(lambda read: S.shares(read("documents"), F.col("source"), 60))


def _checked(o: DataFrame, t: DataFrame) -> DataFrame:
    """Ten pairs of each kind of image text, drawn, with what the check by hand would say: that the translation has the image."""
    rows = P(o, t).select("key", F.regexp_extract("translated", 'alt="([^"]*)"', 1).alias("alt"), F.contains("translated", F.lit("![")).alias("passed"))
    return S.stratified(rows, "key", F.col("alt"), F.lit(10))


both(
    "sample_success",
    """, s AS (SELECT * FROM (SELECT key, regexp_extract(translated, 'alt="([^"]*)"', 1) AS stratum, contains(translated, '![') AS passed FROM pairs) QUALIFY row_number() OVER (PARTITION BY stratum ORDER BY md5(key), key) <= 10),
g AS (SELECT stratum, count(*) AS n_checked, count(*) FILTER (passed) AS n_passed, CAST(count(*) FILTER (passed) AS DOUBLE) / count(*) AS rate, CAST(count(*) AS DOUBLE) AS n FROM s GROUP BY stratum)
SELECT stratum, n_checked, n_passed, rate, (rate + 1.92080 / n - sqrt(rate * (1 - rate) / n + 0.96040 / (n * n)) * 1.96e0) / (1 + 3.84160 / n) AS low, (rate + 1.92080 / n + sqrt(rate * (1 - rate) / n + 0.96040 / (n * n)) * 1.96e0) / (1 + 3.84160 / n) AS high FROM g""",
)(lambda o, t: S.success(_checked(o, t), F.col("passed")))


# --- notes with content ---
_BLOCK = f"'(?m)^(?:{N.NOTED})'"
_FIRST = r"list_transform(string_split(regexp_extract(c, '^\|([^\n]*)\|\n', 1), '|'), lambda z: trim(z, ' '))"
both(
    "described_notes",
    rf""", parts AS (SELECT file_name, string_split_regex(content, {_BLOCK}) AS ps, regexp_extract_all(content, {_BLOCK}) AS cs FROM bare)
SELECT file_name, len(cs) AS n_notes, md5(array_to_string(list_transform(range(1, len(ps) + 1), lambda i: ps[i] || coalesce(list_transform([cs[i]], lambda c: CASE WHEN starts_with(c, '```')
  THEN c || chr(10) || '> 【代码说明】' || CASE WHEN regexp_extract(c, '^```([A-Za-z0-9+#-]*)', 1) <> '' THEN regexp_extract(c, '^```([A-Za-z0-9+#-]*)', 1) ELSE {_LANGUAGE("c")} END || '，' || greatest(0, len(string_split(c, chr(10))) - 2) || ' 行'
  ELSE c || '> 【表格说明】' || len({_FIRST}) || ' 列，' || greatest(0, len(string_split(c, chr(10))) - 2 - len(regexp_extract_all(c, '(?m)^\|[-:| \t]+\|$'))) || ' 行：' || array_to_string({_FIRST}, '、') || chr(10) END)[1], '')), '')) AS text_md5 FROM parts""",
    BARE,
)(lambda o, t: bare(o).select("file_name", F.size(F.regexp_extract_all("content", F.lit(f"(?dm)^(?:{N.NOTED})"), F.lit(0))).cast("long").alias("n_notes"), F.md5(N.describe_notes(F.col("content"))).alias("text_md5")))


# --- answers that are kept ---
def _store(spark: SparkSession) -> str:
    """A new store in the folder that the cluster shares; without one, as in tests, a temporary folder."""
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="answers-")
    return f"{shared.rstrip('/')}/answers-{uuid.uuid4().hex}"


def _translated_lines(read) -> DataFrame:
    rows = T.lines(_DOCS(read)).where("trim(line) <> ''")
    return K.ask_kept(rows, "line", Echo(), "echo-1", _store(rows.sparkSession)).select("id", "place", F.md5("answer").alias("answer_md5"), "answered")


tables("kept_translations", "SELECT doc_id AS id, CAST(i AS INT) AS place, md5('[zh] ' || ls[i]) AS answer_md5, true AS answered FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)) WHERE trim(ls[i], ' ') <> ''")(_translated_lines)
tables("found_categories", r"""WITH hits AS (SELECT unnest(regexp_extract_all(text, '\b([A-Z][A-Za-z0-9+#.-]*[A-Za-z0-9+#])[ \t]+((?i:license|class|interface|model|library|framework|language|protocol|algorithm|database|server))\b', 1)) AS term, lower(unnest(regexp_extract_all(text, '\b([A-Z][A-Za-z0-9+#.-]*[A-Za-z0-9+#])[ \t]+((?i:license|class|interface|model|library|framework|language|protocol|algorithm|database|server))\b', 2))) AS noun FROM documents),
votes AS (SELECT term, CASE noun WHEN 'library' THEN 'framework' WHEN 'algorithm' THEN 'model' WHEN 'database' THEN 'system' WHEN 'server' THEN 'system' WHEN 'interface' THEN 'class' ELSE noun END AS category, count(*) AS votes FROM hits GROUP BY 1, 2)
SELECT term, category, votes, CAST(sum(votes) OVER (PARTITION BY term) AS BIGINT) AS total FROM votes QUALIFY row_number() OVER (PARTITION BY term ORDER BY votes DESC, category) = 1""")(lambda read: Y.categorised(_DOCS(read)))


# --- the report by its template ---
both(
    "verification_template",
    checks_sql("pairs", "c") + f",\ndr AS (SELECT * FROM pairs QUALIFY row_number() OVER (ORDER BY md5(key), key) <= {V.CHAPTERS})" + checks_sql("dr", "v") + rf""", rows AS (SELECT 'o/' || file_name AS id, content AS text FROM o UNION ALL SELECT 't/' || file_name, content FROM translated_chapters WHERE NOT starts_with(file_name, '00_') AND NOT contains(file_name, '_report')), {_MARKED}, {_TREE},
st AS (SELECT (SELECT count(*) FROM o) AS oc, (SELECT count(*) FROM rows WHERE starts_with(id, 't/')) AS tc, (SELECT coalesce(sum(len(regexp_extract_all(text, '!\[.*?\]\(.*?\)'))), 0) FROM rows WHERE starts_with(id, 'o/')) AS oi, (SELECT coalesce(sum(len(regexp_extract_all(text, '!\[.*?\]\(.*?\)'))), 0) FROM rows WHERE starts_with(id, 't/')) AS ti,
  (SELECT coalesce(max(depth), 0) FROM tree WHERE starts_with(id, 'o/')) AS od, (SELECT coalesce(max(depth), 0) FROM tree WHERE starts_with(id, 't/')) AS td),
im AS (SELECT count(*) AS n, count(*) FILTER (difference = 'same') AS w0, count(*) FILTER (difference = 'recognised') AS w1, count(*) FILTER (difference = 'image') AS w2, count(*) FILTER (difference = 'kind') AS w3, count(*) FILTER (difference = 'missing') AS w4 FROM aligned WHERE kind = 'image'),
cd AS (SELECT count(*) AS n, count(*) FILTER (status = 'PASS') AS good FROM (SELECT * FROM c4 QUALIFY row_number() OVER (ORDER BY md5(file_name || '#' || pos), file_name || '#' || pos) <= {V.BLOCKS})),
pr AS (SELECT coalesce(kind, t_kind) AS kind, difference, count(*) AS n_steps, count(DISTINCT key) AS n_chapters, row_number() OVER (ORDER BY count(*) DESC, coalesce(kind, t_kind), difference) AS ord FROM aligned WHERE NOT expected GROUP BY 1, 2)
SELECT 0 AS part, 0 AS ord, '| 章节数 | ' || oc || ' | ' || tc || ' | ' || CASE WHEN oc = tc THEN '✅' ELSE '❌' END || ' |' AS line FROM st UNION ALL SELECT 0, 1, '| 图片数 | ' || oi || ' | ' || ti || ' | ' || CASE WHEN oi = ti THEN '✅' ELSE '❌' END || ' |' FROM st UNION ALL SELECT 0, 2, '| 目录层级 | ' || od || ' | ' || td || ' | ' || CASE WHEN od = td THEN '✅' ELSE '❌' END || ' |' FROM st
UNION ALL SELECT 1, 0, '| 图片 | ' || w0 || ' | 保留 | ' || CASE WHEN n > 0 THEN CAST(round(100.0e0 * w0 / n) AS BIGINT) || '%' ELSE '-' END || ' |' FROM im
UNION ALL SELECT 1, 1, '| 图片 | ' || w1 || ' | OCR | ' || CASE WHEN n > 0 THEN CAST(round(100.0e0 * w1 / n) AS BIGINT) || '%' ELSE '-' END || ' |' FROM im
UNION ALL SELECT 1, 2, '| 图片 | ' || w2 || ' | 替换 | ' || CASE WHEN n > 0 THEN CAST(round(100.0e0 * w2 / n) AS BIGINT) || '%' ELSE '-' END || ' |' FROM im
UNION ALL SELECT 1, 3, '| 图片 | ' || w3 || ' | 其他 | ' || CASE WHEN n > 0 THEN CAST(round(100.0e0 * w3 / n) AS BIGINT) || '%' ELSE '-' END || ' |' FROM im
UNION ALL SELECT 1, 4, '| 图片 | ' || w4 || ' | 缺失 | ' || CASE WHEN n > 0 THEN CAST(round(100.0e0 * w4 / n) AS BIGINT) || '%' ELSE '-' END || ' |' FROM im
UNION ALL SELECT 2, 0, '- 抽样数量: ' || n FROM cd UNION ALL SELECT 2, 1, '- 准确数量: ' || good FROM cd UNION ALL SELECT 2, 2, '- 准确率: ' || CASE WHEN n > 0 THEN CAST(round(100.0e0 * good / n) AS BIGINT) || '%' ELSE '-' END FROM cd
UNION ALL SELECT 3, 0, '- 抽样章节: ' || count(*) FROM dr UNION ALL SELECT 3, 1, '- 技术术语保留: ' || CASE WHEN count(*) = 0 THEN '✅' ELSE '❌' END FROM v2 WHERE status = 'FAIL'
UNION ALL SELECT 4, CAST(ord AS INT), ord || '. ' || kind || ' ' || difference || '：' || n_steps || ' 处，' || n_chapters || ' 章' FROM pr""",
    ALIGNED,
)(V.template_lines)
