"""Personal data: base patterns, and information-theoretic sanitisation of terms that reveal them. Built-in functions only.

Base spans are the leftmost non-overlapping matches of each kind. Their values are the protected entities. A term (a word of
TERM letters or more, folded) is held against the corpus: with N documents, of which df(t) hold the term, df(e) the entity and
c(t, e) both, the entity's information is IC(e) = -log2(df(e) / N), and who reads the term knows the entity with probability P(e | t), so the term gives
away PMI(t, e) = IC(e) + log2 P(e | t) bits of it. Two estimates of P(e | t) decide: c / df, and the lower end of Wilson's interval (Z standard errors) around
it, by which few co-occurrences prove little: a word seen once beside an entity, as most rare words are, has at most 0.21. What speaks for the pair besides
counts for documents that hold both: PART of them if the term is a run of letters of the entity's own value (a name in an e-mail address), BESIDE if it is
capitalised and within NEAR letters of the entity. In texts that hold the entity, terms that give away GENERALISE of its bits and whose lower end is CERTAIN
or more (which leaves one bit) are generalised; those whose lower end gives away REMOVE are removed. Every entity is estimated; counts are over all documents, copies
included.

A term is generalised to the class of words with its first STEM letters, written [abc*], if one of them is in too many documents to
disclose any entity; else to the class of all terms, [TERM].

As c is at most df(e), P(e | t) >= CERTAIN needs df(t) <= 2 df(e) + PART, and df(e) with the evidence must be FEWEST or more: only such pairs are
made, and none is lost by it. Entities that are held by the same texts have equal counts and are paired once. The frequent entity is no hot key: pairs are
aggregated before the shuffle.

Defined results: null text is empty: no spans. Rows without doc_id are scanned too. Repeated rows each get their spans. Added spans never
overlap base spans. Other columns are passed on by sanitise(), but for those named text, spans or sanitised (in any case of letters), which are its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import stage
from .skew import spread_join
from .spans import SPAN, blocks, cut, literal, replaced, spans

#: Equal to the contract's patterns: possessive, and tried only where a match can begin, so that long runs take linear time.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
DIGITS = "length(regexp_replace(value, '[^0-9]', ''))"
IP_PARTS = literal(r"^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])(?:\.0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])){3}$")
#: kind, pattern, condition on a match, cheap condition on a text
KINDS = [
    ("email", EMAIL, "true", "contains(text, '@')"),
    ("ip", IP, f"value rlike {IP_PARTS}", "true"),
    ("card", CARD, f"{DIGITS} between 13 and 19 and luhn_check(regexp_replace(value, '[^0-9]', ''))", "true"),
    ("phone", PHONE, f"{DIGITS} between 9 and 15", "contains(text, '+')"),
]
#: Only runs of 13 digits or more can be cards.
CARD_AHEAD = r"[0-9](?:[\x20-]?[0-9]){12}"
TERM, GENERALISE, REMOVE, STEM = 4, 0.9, 0.97, 3
#: Of the estimate: standard errors, least probability, and what evidence counts for, in documents; letters that are beside an entity.
Z, CERTAIN, PART, BESIDE, NEAR = 1.96, 0.5, 8, 2, 40
#: Documents (with evidence) that hold both below which no lower bound reaches CERTAIN: n / (n + Z^2) < CERTAIN.
FEWEST = 4
#: Stands for the letters of base spans where words are looked for: a word that reaches into one is no term.
COVERED = "\ue000"
WORD = rf"\p{{L}}{{{TERM},}}+"


def _found(kind: str, pattern: str, keep: str, gate: str) -> str:
    ahead = CARD_AHEAD if kind == "card" else pattern
    return f"case when {gate} and text rlike {literal(ahead)} then {spans('text', literal(pattern), keep)} else cast(array() as array<{SPAN}>) end"


def base_spans(docs: DataFrame) -> DataFrame:
    """docs with a column for each kind: array of (start, stop, value); text is not null."""
    docs = docs.withColumn("text", F.coalesce("text", F.lit("")))
    return docs.withColumns({f"__pii_{kind}": F.expr(_found(kind, p, keep, gate)) for kind, p, keep, gate in KINDS})


def _entities() -> str:
    return "concat(" + ", ".join(f"transform(__pii_{k}, s -> concat('{k}:', lower(s.value)))" for k, *_ in KINDS) + ")"


def base_of() -> str:
    """SQL for all base spans of a row of base_spans(), by kind."""
    return "concat(" + ", ".join(f"transform(__pii_{k}, s -> named_struct('kind', '{k}', 'start', s.start, 'stop', s.stop, 'label', '[{k.upper()}]'))" for k, *_ in KINDS) + ")"


def likely(c: str, df: str) -> str:
    """SQL for the lower end of Wilson's interval of c of df (both doubles)."""
    p, zz = f"({c} / {df})", Z * Z
    return f"(({p} + {zz / 2} / {df} - {Z} * sqrt({p} * (1 - {p}) / {df} + {zz / 4} / ({df} * {df}))) / (1 + {zz} / {df}))"


def disclosing_terms(found: DataFrame) -> DataFrame:
    """Of base_spans(): rows (cls, added) of texts whose MD5 is cls; added holds the places (start, stop, label) of the terms that disclose an entity of the text."""
    spark = found.sparkSession
    held = found.select(F.md5("text").alias("cls"), "text", F.expr(f"array_distinct({_entities()})").alias("es"), F.expr(base_of()).alias("base")).where(F.size("es") > 0)
    # distinct texts that hold something, each once with its number of documents; the text travels only for those
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(WORD), F.lit(0)))
    once = held.groupBy("cls").agg(F.first("es").alias("es"), F.first("base").alias("base"), F.first("text").alias("text"), F.count("*").alias("docs")).select("cls", "es", "base", "text", words.alias("ws"), "docs")
    once = stage.written(spark, once, "protected")
    each = once.select("cls", "docs", F.explode("es").alias("entity"))
    # entities held by the same texts count alike: they go by one name, made of sums over those texts
    texts = [F.sum(F.xxhash64("cls", F.lit(k)).cast("decimal(38,0)")) for k in (1, 2)]
    entity = each.groupBy("entity").agg(F.sum("docs").alias("n_e"), F.concat_ws(":", F.count("*"), *texts).alias("same"))
    entity = stage.written(spark, entity, "entities")
    named = spread_join(each, entity, "entity", "n_e").select("cls", "docs", F.col("same").alias("entity"), "n_e").distinct()
    holds = stage.written(spark, named, "holds")
    # what speaks for a term beside the counts, by entity
    part = entity.select(F.col("same").alias("entity"), F.explode(F.regexp_extract_all("entity", F.lit(rf"(?<=:|\P{{L}}){WORD}"), F.lit(0))).alias("term"), F.lit(PART).alias("speaks"))
    # cut from blocks: substring() would walk the text from its start for each span
    value, before, after = (f"array_join({cut('held', a, b)}, '')" for a, b in (("s.start", "s.stop"), (f"greatest(s.start - {NEAR}, 0)", "s.start"), ("s.stop", f"(s.stop + {NEAR})")))
    around = f"transform(base, s -> named_struct('entity', concat(s.kind, ':', lower({value})), 'near', concat({before}, ' ', {after})))"
    beside = once.where(F.size("base") > 0).select("base", F.expr(blocks("text")).alias("held")).select(F.explode(F.expr(around)).alias("a")).select("a.entity", F.explode(F.regexp_extract_all("a.near", F.lit(rf"\p{{Lu}}\p{{L}}{{{TERM - 1},}}+"), F.lit(0))).alias("term")).select("entity", F.lower("term").alias("term")).distinct()
    beside = beside.join(entity.select("entity", "same"), "entity").select(F.col("same").alias("entity"), "term", F.lit(BESIDE).alias("speaks"))
    speaks = stage.written(spark, part.unionByName(beside).groupBy("entity", "term").agg(F.max("speaks").alias("speaks")), "evidence")
    size = found.agg(F.count("*").alias("n")).crossJoin(holds.agg(F.max("n_e").alias("top")))
    # frequency of all terms over all documents, added up before the shuffle; a term too frequent for every entity is wide
    corpus = found.select(F.explode(words).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    counted = corpus.crossJoin(F.broadcast(size)).withColumn("wide", F.expr(f"df > 2 * top + {PART}")).drop("top")
    counted = stage.written(spark, counted, "counted")
    asked = spread_join(once.select("cls", F.explode("ws").alias("term")), counted.where("not wide").drop("wide"), "term", "df")
    asked = stage.written(spark, asked, "asked")
    # entities of many documents are paired with all terms of their texts, others only with those that something speaks for
    often = asked.join(holds.where(F.col("n_e") >= FEWEST), "cls").where(f"n_e < n and df <= 2 * n_e + {PART}").join(speaks, ["entity", "term"], "left")
    rare = asked.join(holds.where(F.col("n_e") < FEWEST).join(speaks, "entity"), ["cls", "term"]).where(f"n_e < n and df <= 2 * n_e + {PART}")
    rows = often.withColumn("speaks", F.coalesce("speaks", F.lit(0))).unionByName(rare)
    rows = stage.written(spark, rows, "pairs")
    counts = rows.groupBy("entity", "term", "df", "n_e", "n", "speaks").agg(F.sum("docs").alias("c"))
    counts = counts.withColumn("low", F.expr(likely("cast(c + speaks as double)", "cast(df + speaks as double)"))).where(F.col("low") >= CERTAIN)
    counts = counts.where(F.expr(f"1 + log2((c + speaks) / (df + speaks)) / -log2(n_e / n) >= {GENERALISE}"))
    pairs = counts.select("entity", "term", F.expr("1 + log2(low) / -log2(n_e / n)").alias("share"))
    lost = rows.select("cls", "entity", "term").join(pairs, ["entity", "term"]).groupBy("cls", "term").agg(F.max("share").alias("share"))
    stem = F.substring("term", 1, STEM).alias("stem")
    classes = counted.where("wide").select(stem).distinct().withColumn("wide", F.lit(True))
    # many lost terms may share a stem
    lost = stage.written(spark, lost.withColumn("stem", stem), "lost-terms")
    known = lost.groupBy("stem").agg(F.count("*").alias("rows")).join(classes, "stem", "left")
    lost = spread_join(lost, stage.written(spark, known, "stems"), "stem", "rows")
    label = F.when(F.col("share") >= REMOVE, "").when(F.col("wide"), F.concat(F.lit("["), "stem", F.lit("*]"))).otherwise("[TERM]")
    # the terms' places: words of the text in which base spans are covered up
    covered = f"regexp_replace(regexp_replace(old, '{COVERED}|[^\\\\p{{L}}]', ' '), '[^ ]', '{COVERED}')"
    hidden = F.expr(replaced("__held", "length(text)", "base", covered, clip=True))
    # the work on a text, not its bytes, asks for this many tasks
    dealt = once.select("cls", "text", "base").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "cls")
    places = dealt.withColumn("text", F.translate("text", COVERED, " ")).withColumn("__held", F.expr(blocks("text"))).select("cls", hidden.alias("hidden"))
    own = places.select("cls", F.explode(F.expr(spans("hidden", literal(WORD.replace(r"\p{L}", rf"[\p{{L}}{COVERED}]")), f"not contains(value, '{COVERED}')"))).alias("s")).select("cls", "s.start", "s.stop", F.lower("s.value").alias("term"))
    return own.join(lost.select("cls", "term", label.alias("label")), ["cls", "term"]).groupBy("cls").agg(F.array_sort(F.collect_list(F.struct("start", "stop", "label"))).alias("added"))


def sanitise(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text and any columns) with spans array<struct<kind, start, stop, label>> in the order kinds, then start, and sanitised text.

    kind is a base kind or ``term``. The column text becomes the input's (null: empty); ``sanitised`` has each span replaced by its label.
    """
    spark = docs.sparkSession
    docs = docs.select(*(F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("spans", "sanitised")))
    found = base_spans(docs)
    # what each protected text has to lose, by text
    hit = stage.written(spark, disclosing_terms(base_spans(docs.select("text"))).select(F.col("cls").alias("__pii_cls"), F.col("added").alias("__pii_added")), "lost")
    # texts that hold nothing lose no term and stay out of the join
    holding = F.expr(f"size({_entities()}) > 0")
    rest = found.where(~holding).withColumn("__pii_added", F.lit(None).cast(hit.schema["__pii_added"].dataType))
    rows = found.where(holding).withColumn("__pii_cls", F.md5("text")).join(hit, "__pii_cls", "left").drop("__pii_cls").unionByName(rest)
    added = "transform(coalesce(__pii_added, cast(array() as array<struct<start: bigint, stop: bigint, label: string>>)), s -> named_struct('kind', 'term', 'start', s.start, 'stop', s.stop, 'label', s.label))"
    rows = rows.withColumn("spans", F.expr(f"concat({base_of()}, {added})"))
    # spans of different kinds may overlap: what is covered already is skipped
    rows = rows.withColumn("__pii_held", F.expr(f"case when size(spans) > 0 then {blocks('text')} end"))
    rows = rows.withColumn("sanitised", F.expr(f"case when size(spans) = 0 then text else {replaced('__pii_held', 'length(text)', 'spans', 'i.label')} end"))
    names = [c for c in docs.columns if c.lower() != "text"]
    return rows.select(*(F.col(f"`{c}`") for c in names), "text", "spans", "sanitised")


def joined(array: str) -> str:
    """SQL for kind:start:end, comma-joined."""
    return f"array_join(transform({array}, s -> concat(s.kind, ':', s.start, ':', s.stop)), ',')"
