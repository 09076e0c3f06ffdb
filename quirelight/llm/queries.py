"""The operators' queries over the driver's tables, with production parameters, and their SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import toxicity
from .conversation_trie import ordered, prefix_trie, rebuilt
from .embedding_dedup import embedding_near_dedup
from .hard_negatives import hard_negatives
from .html_text import extract_text
from .language_id import fit, fold_of, predict
from .licenses import BASE, scan_licenses
from .mixing import mix
from .ngram_join import ngram_jaccard_join
from .packing import WordTokenizer, pack_documents
from .pii import KINDS, base_of, base_spans, joined, sanitise
from .substring_dedup import substring_dedup
from .topk_search import exact_top_k


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_near_dedup(_table(spark, sf_dir, "embeddings"), threshold=0.98)


OP1_SQL = """
WITH RECURSIVE e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
ok AS (SELECT * FROM e WHERE label IS NOT NULL AND v IS NOT NULL AND len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE list_cosine_similarity(a.v, b.v) >= 0.98),
reach AS (SELECT vec_id AS a, vec_id AS b FROM e UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
c AS (SELECT a, min(b) AS b FROM reach GROUP BY a),
n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, c.b AS component_id, vec_id = c.b AS kept
FROM e JOIN c ON c.a = vec_id LEFT JOIN n ON n.a = vec_id
"""


def op8_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10, scale=1024)


OP8_SQL = """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda x: x[1] * x[2])) AS BIGINT) AS score
  FROM e q JOIN e c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 100 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY rank <= 10
"""


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_join(_table(spark, sf_dir, "documents"), width=5, percent=75).drop("text_class")


OP2_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(ws[p : p + 4], ' ') AS s FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS p FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 75 * (x.n + y.n - i)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM w UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, (SELECT min(b) FROM reach WHERE reach.a = w.doc_id) AS component_id
FROM w LEFT JOIN n ON n.doc_id = w.doc_id
"""


def _word_bpe() -> WordTokenizer:
    import public_tokenizers

    return WordTokenizer.shared(public_tokenizers.path("word_bpe_49k.json"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_table(spark, sf_dir, "documents"), _word_bpe, size=2048)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").withColumn("held_out", fold_of(F.col("doc_id")) == 2)
    model = fit(docs.where(~F.col("held_out")))
    return predict(docs, model, ["doc_id", "held_out"])


def _base_columns(rows: DataFrame, *more: Column) -> DataFrame:
    counts = [F.expr(f"cast(size(filter(base, s -> s.kind = '{k}')) as bigint)").alias(f"n_{k}") for k, *_ in KINDS]
    return rows.select("doc_id", *counts, F.expr(f"sha2({joined('base')}, 256)").alias("base_sha256"), *more)


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sanitise(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return _base_columns(out.withColumn("base", F.expr("filter(spans, s -> s.kind <> 'term')")), F.expr(joined("spans")).alias("spans"))


def pii_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base columns of op4_pii, which SQL can express: its scan alone, as terms need counts over all documents and base spans do not."""
    return _base_columns(base_spans(_table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", F.expr(base_of()).alias("base")))


def _kind_sql(kind: str, pattern: str, keep: str) -> str:
    return f"""SELECT doc_id, '{kind}' AS kind, start, start + length(m) AS stop FROM (
  SELECT doc_id, ms[i] AS m, CAST(list_sum(list_transform(ps[1 : i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1 : i - 1], lambda x: length(x))), 0) AS BIGINT) AS start
  FROM (SELECT doc_id, ms, string_split_regex(t, '{pattern}') AS ps, unnest(range(1, len(ms) + 1)) AS i FROM (SELECT doc_id, t, regexp_extract_all(t, '{pattern}') AS ms FROM d))) WHERE {keep}"""


_DIGITS = "regexp_replace(m, '[^0-9]', '', 'g')"
_LUHN = f"list_sum(list_transform(range(1, length({_DIGITS}) + 1), lambda k: CASE WHEN k % 2 = 1 THEN CAST(reverse({_DIGITS})[k] AS INTEGER) ELSE 2 * CAST(reverse({_DIGITS})[k] AS INTEGER) - CASE WHEN CAST(reverse({_DIGITS})[k] AS INTEGER) > 4 THEN 9 ELSE 0 END END)) % 10 = 0"
PII_BASE_SQL = (
    "WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), s AS ("
    + " UNION ALL ".join(
        (
            _kind_sql("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true"),
            _kind_sql("ip", r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", "len(list_filter(string_split(m, '.'), lambda x: length(ltrim(x, '0')) > 3 OR CAST(right('0' || ltrim(x, '0'), 4) AS INTEGER) > 255)) = 0"),
            _kind_sql("card", r"[0-9](?:[ -]?[0-9])+", f"length({_DIGITS}) BETWEEN 13 AND 19 AND {_LUHN}"),
            _kind_sql("phone", r"\+[0-9][ ().0-9-]+[0-9]", f"length({_DIGITS}) BETWEEN 9 AND 15"),
        )
    )
    + """)
SELECT d.doc_id, count(*) FILTER (kind = 'email') AS n_email, count(*) FILTER (kind = 'ip') AS n_ip, count(*) FILTER (kind = 'card') AS n_card, count(*) FILTER (kind = 'phone') AS n_phone,
  sha256(coalesce(string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY list_position(['email', 'ip', 'card', 'phone'], kind), start), '')) AS base_sha256
FROM d LEFT JOIN s ON s.doc_id = d.doc_id GROUP BY d.doc_id"""
)


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan_licenses(_table(spark, sf_dir, "documents"))
    word = F.transform("places", lambda p: p["word"])
    return out.select("doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min(word).alias("first_word"), F.array_max(word).alias("last_word"), F.array_join("base_labels", ",").alias("base_labels"), F.array_join("labels", ",").alias("labels"), "score")


def license_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base columns of op6_license_scan, which SQL can express; -1 where there is no place."""
    return op6_license_scan(spark, sf_dir).drop("labels", "score").na.fill(-1, ["first_word", "last_word"])


def _phrase_sql(phrase: str) -> str:
    return "(" + " AND ".join(f"ws[i + {k}] = '{w}'" if k else f"ws[i] = '{w}'" for k, w in enumerate(phrase.split())) + ")"


LICENSE_BASE_SQL = (
    r"""WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
p AS (SELECT doc_id, len(ws) AS n_words, """
    + ", ".join(f"list_filter(range(1, len(ws) + 1), lambda i: {_phrase_sql(phrase)}) AS p{k}" for k, (phrase, _) in enumerate(BASE))
    + " FROM w), a AS (SELECT *, "
    + " || ".join(f"p{k}" for k in range(len(BASE)))
    + " AS every FROM p)\nSELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(len(every) AS BIGINT) AS n_base, CAST(coalesce(list_min(every), 0) - 1 AS BIGINT) AS first_word, CAST(coalesce(list_max(every), 0) - 1 AS BIGINT) AS last_word, array_to_string(list_sort(list_filter(["
    + ", ".join(f"CASE WHEN len(p{k}) > 0 THEN '{label}' END" for k, (_, label) in enumerate(BASE))
    + "], lambda x: x IS NOT NULL)), ',') AS base_labels FROM a"
)


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(_table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix(_table(spark, sf_dir, "documents"), budget=0.5, power=0.7)
    return out.select("doc_id", "source", "lang", "topic", "n_tokens", "weight", "probability", "kept")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup(_table(spark, sf_dir, "documents"), digest=True)
    return out.withColumnRenamed("kept", "kept_sha256")


OP5_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
starts AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS p FROM w WHERE len(ws) >= 13),
wins AS (SELECT doc_id, p, array_to_string(ws[p : p + 12], ' ') AS k FROM starts),
least AS (SELECT k, min(doc_id) AS d FROM wins GROUP BY k),
gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + 13)) AS i FROM wins JOIN least USING (k) WHERE d < doc_id),
lost AS (SELECT doc_id, list(i) AS l, count(*) AS n FROM gone GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed,
  sha256(CASE WHEN n IS NULL THEN array_to_string(ws, ' ')
    ELSE array_to_string(list_transform(list_filter(list_zip(ws, range(1, len(ws) + 1)), lambda x: NOT list_contains(l, x[2])), lambda x: x[1]), ' ') END) AS kept_sha256
FROM w LEFT JOIN lost ON w.doc_id = lost.doc_id
"""

def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label, k=5, take=5, least=80, most=100, scale=256)


OP11_SQL = """
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS a, c.vec_id AS c, a.label = c.label AS same, CAST(coalesce(list_sum(list_transform(list_zip(a.v, c.v), lambda x: x[1] * x[2])), 0) AS BIGINT) AS score
  FROM e a JOIN e c ON a.vec_id <> c.vec_id AND len(a.v) = len(c.v) WHERE a.vec_id % 100 = 0),
p AS (SELECT a, c AS p, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, c) <= 5)
SELECT p.a AS anchor_id, p.p AS positive_id, CAST(row_number() OVER (PARTITION BY p.a, p.p ORDER BY s.score DESC, s.c) AS INTEGER) AS rank, s.c AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON s.a = p.a AND NOT s.same AND 80 * p.score <= 100 * s.score AND 100 * s.score <= 100 * p.score QUALIFY rank <= 5
"""


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = ordered(_table(spark, sf_dir, "conversations"))
    return prefix_trie(*rebuilt(turns, F.crc32(F.col("conv_id").cast("string").cast("binary")) % 6, family=100, most=5))


_CRC32 = "xor(4294967295, list_reduce(list_concat([CAST(4294967295 AS UBIGINT)], list_transform(range(1, length({0}) + 1), lambda i: CAST(ascii(substr({0}, i, 1)) AS UBIGINT))), lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, k: xor(x >> 1, (x & 1) * 3988292384))))"
OP12_SQL = f"""
WITH t AS (SELECT conv_id, coalesce(role, '') AS r, coalesce(text, '') AS x, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS pos FROM conversations WHERE conv_id IS NOT NULL),
l AS (SELECT conv_id, list({{'r': r, 'x': x}} ORDER BY pos) AS turns FROM t GROUP BY conv_id),
h AS (SELECT conv_id, turns, conv_id - conv_id % 100 AS base, {_CRC32.format("CAST(conv_id AS VARCHAR)")} % 6 AS h FROM l),
c AS (SELECT h.conv_id, list_concat(CASE WHEN b.turns IS NULL THEN [] ELSE b.turns[1 : h.h] END, h.turns[h.h + 1 :]) AS path FROM h LEFT JOIN l b ON b.conv_id = h.base),
o AS (SELECT conv_id, path[1 : d] AS p, d, len(path) = d AS ends FROM (SELECT conv_id, path, unnest(range(0, len(path) + 1)) AS d FROM c)),
n AS (SELECT p, any_value(d) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256 FROM o GROUP BY p),
k AS (SELECT p[1 : depth - 1] AS p, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1),
f AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN k USING (p)),
s AS (SELECT p[1 : a] AS p, count(*) FILTER (n_children = 0) AS n_leaves, sum(CASE WHEN depth > 0 THEN (n_convs - 1) * length(p[depth].x) ELSE 0 END) AS saved_tokens FROM (SELECT *, unnest(range(0, depth + 1)) AS a FROM f) GROUP BY 1)
SELECT f.conv_id, CAST(f.depth AS BIGINT) AS depth, u.conv_id AS parent_conv_id, f.n_convs, f.n_children, s.n_leaves, CAST(s.saved_tokens AS BIGINT) AS saved_tokens, f.ends_sha256
FROM f JOIN s USING (p) LEFT JOIN n u ON f.depth > 0 AND u.p = f.p[1 : f.depth - 1]
"""


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").withColumn("held_out", fold_of(F.col("doc_id")) == 2)
    labels = _table(spark, sf_dir, "labels").where(fold_of(F.col("doc_id")) != 2)
    machine = toxicity.fit(docs.where(~F.col("held_out")), labels)
    return toxicity.score(docs, machine, ["doc_id", "held_out"]).withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_embedding_near_dedup": op1_embedding_near_dedup,
    "op2_ngram_jaccard_join": op2_ngram_jaccard_join,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_pii": op4_pii,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_license_scan": op6_license_scan,
    "op7_html_extraction": op7_html_extraction,
    "op8_exact_top_k": op8_exact_top_k,
    "op9_source_mixing": op9_source_mixing,
    "op10_language_id": op10_language_id,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_conversation_trie": op12_conversation_trie,
    "op13_toxicity": op13_toxicity,
    "pii_base": pii_base,
    "license_base": license_base,
}
ORACLES: dict[str, str] = {
    "op1_embedding_near_dedup": OP1_SQL,
    "op2_ngram_jaccard_join": OP2_SQL,
    "op5_substring_dedup": OP5_SQL,
    "op8_exact_top_k": OP8_SQL,
    "op11_hard_negatives": OP11_SQL,
    "op12_conversation_trie": OP12_SQL,
    "pii_base": PII_BASE_SQL,
    "license_base": LICENSE_BASE_SQL,
}
