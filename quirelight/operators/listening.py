"""Code, keywords, notes and format of chapters for listening. What the documentation leaves open is decided in each docstring."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.lexicon import TERMS
from . import enhance as E

L = F.lit
#: Fenced blocks, or runs of two or more lines that end as statements and blocks of code do. Both engines read it alike.
CODE_RUN = r"```[\s\S]*?```|^[^\n]*[;{}][ \t]*$(?:\n^[^\n]*[;{}][ \t]*$)+"
#: What stays as it is (fenced and inline code, images, links), a keyword, any other word: a call with its arguments, a generic type, a constant, a class name.
KEYWORD = (
    r"(```[\s\S]*?```|`[^`\n]*`|!?\[[^\]\n]*\]\([^)\n]*\)|<[^>\n]*>)"
    r"|([A-Za-z_][A-Za-z0-9_]*(?:\.[A-Za-z_][A-Za-z0-9_]*)+\([^()\n]*\)|[A-Z][A-Za-z0-9]*<[A-Z][A-Za-z0-9_, ?]*>|[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)+|[A-Z][a-z0-9]+(?:[A-Z][a-z0-9]+)+)"
    r"|([A-Za-z0-9_]+)"
)
LONG = 80
#: Lines end at \n only, as they do in the SQL. Groups are repeated without a way back: otherwise Java's matcher nests a call for each line.
RUN = "(?dm)" + CODE_RUN[:-1] + "++"


def fence_code(text: Column) -> Column:
    """Bare code fenced under its detected language, on lines of its own; fenced code stays."""
    parts = F.arrays_zip(F.split(text, RUN, -1).alias("between"), X.every(text, RUN).alias("code"))
    new = lambda c: F.when(c.isNull() | F.startswith(c, L("```")), F.coalesce(c, L(""))).otherwise(F.concat(L("\n```"), E.detect_language(c), L("\n"), c, L("\n```")))
    return F.array_join(F.transform(parts, lambda p: F.concat(p["between"], new(p["code"]))), "")


def blocks_wrapped(text: Column) -> Column:
    return F.size(F.filter(X.every(text, RUN), lambda c: ~F.startswith(c, L("```")))).cast("long")


def _marked(text: Column) -> Column:
    """Keywords between the characters 1 and 2."""
    return F.regexp_replace(F.translate(text, "\x01\x02", ""), KEYWORD, "$1\x01$2\x02$3")


def highlight_keywords(text: Column) -> Column:
    """Keywords outside code, images, links and tags in backticks."""
    return F.translate(F.replace(_marked(text), L("\x01\x02"), L("")), "\x01\x02", "``")


def keywords_highlighted(text: Column) -> Column:
    return X.count(_marked(text), "\x01[^\x02]")


def enhance_code(files: DataFrame) -> DataFrame:
    """file_name, content with bare code fenced and keywords highlighted, and both numbers."""
    fenced = fence_code(F.col("content"))
    rows = files.select("file_name", blocks_wrapped(F.col("content")).alias("code_blocks_wrapped"), fenced.alias("content"))
    return rows.select("file_name", highlight_keywords(F.col("content")).alias("content"), "code_blocks_wrapped", keywords_highlighted(F.col("content")).alias("keywords_highlighted"))


def run_counters(files: DataFrame) -> DataFrame:
    """What a run over all files does, summed."""
    rows = enhance_code(files).select("code_blocks_wrapped", "keywords_highlighted", X.count(F.col("content"), X.MD_IMAGE).alias("images"), lines_read(F.col("content")).alias("lines_read"))
    return rows.agg(F.count("*").alias("files"), *(F.sum(c).cast("long").alias(c) for c in ("code_blocks_wrapped", "keywords_highlighted", "images", "lines_read")))


def long_sentences(text: Column) -> Column:
    """Lines of up to LONG characters as they are, longer ones by sentences; blank lines go."""
    lines = F.filter(F.transform(F.split(text, "\n"), X.strip), lambda x: x != "")
    return F.flatten(F.transform(lines, lambda x: F.when(F.length(x) <= LONG, F.array(x)).otherwise(E.sentences(x))))


def lines_read(text: Column) -> Column:
    """The number of long_sentences(): a stripped line has one for each run of end marks and one more if it ends without; they need not be made."""
    marks = L(E.END_MARKS)
    ended = lambda x: F.contains(marks, F.substring(x, -1, 1))
    of_line = lambda x: F.when(F.length(x) <= LONG, 1).otherwise(X.count(x, f"[{E.END_MARKS}]+") + F.when(ended(x), 0).otherwise(1))
    lines = F.filter(F.transform(F.split(text, "\n"), X.strip), lambda x: x != "")
    return F.aggregate(lines, L(0).cast("long"), lambda n, x: n + of_line(x))


def clean_format(text: Column) -> Column:
    """No white space before line ends, tabs at line starts as two spaces, - for items, a blank after the marks of headings, no more than one blank line, image paths of merged books, a last fence that is closed."""
    for pattern, new in ((r"(?dm)[ \t]+$", ""), (r"(?dm)^\t", "  "), (r"(?dm)^( *)[*+] ", "$1- "), (r"(?dm)^(#{1,6})([^#\s])", "$1 $2"), (r"\n{3,}", "\n\n")):
        text = F.regexp_replace(text, pattern, new)
    text = E.image_path_fix(text)
    return F.when(X.count(text, "(?dm)^```") % 2 == 1, F.concat(text, L("\n```"))).otherwise(text)


def add_notes(text: Column) -> Column:
    """A note under each fenced block and each table of lines between bars."""
    text = F.regexp_replace(text, r"(```[^\n]*\n[\s\S]*?\n```)", "$1\n> 【代码说明】")
    return F.regexp_replace(text, r"(?dm)(^\|[^\n]*\|$(?:\n^\|[^\n]*\|$)++)", "$1\n> 【表格说明】")


#: A fenced block, or a table of lines between bars.
NOTED = r"```[\s\S]*?```|(?:\|[^\n]*\|\n){2,}"


def describe_notes(text: Column) -> Column:
    """A note under each fenced block and each table that says what is there: language and lines of code; columns, rows and names of a table.

    The language is the fence's own word, else the detected one. A table is two lines or more between bars, each with its line end; rules do not count as rows.
    """
    block = f"(?dm)^(?:{NOTED}+)"  # the repeated group has no way back
    parts = F.arrays_zip(F.split(text, block, -1).alias("between"), X.every(text, block).alias("block"))
    lines = lambda b: F.size(F.split(b, "\n"))
    word = lambda b: F.regexp_extract(b, r"^```([A-Za-z0-9+#-]*)", 1)
    code = lambda b: F.concat(b, L("\n> 【代码说明】"), F.when(word(b) != "", word(b)).otherwise(E.detect_language(b)), L("，"), F.greatest(L(0), lines(b) - 2).cast("string"), L(" 行"))
    first = lambda b: F.transform(F.split(F.regexp_extract(b, r"^\|([^\n]*)\|\n", 1), r"\|"), lambda x: F.trim(x))
    rules = lambda b: X.count(b, r"(?dm)^\|[-:| \t]+\|$")
    grid = lambda b: F.concat(b, L("> 【表格说明】"), F.size(first(b)).cast("string"), L(" 列，"), F.greatest(L(0), lines(b) - 2 - rules(b)).cast("string"), L(" 行："), F.array_join(first(b), "、"), L("\n"))
    new = lambda b: F.when(b.isNull(), "").when(F.startswith(b, L("```")), code(b)).otherwise(grid(b))
    return F.array_join(F.transform(parts, lambda p: F.concat(p["between"], new(p["block"]))), "")


def chapter_intro(text: Column) -> Column:
    """An introduction from the first heading and a summary of the first two sentences of the prose."""
    title = F.regexp_extract(text, r"(?dm)^#+ +([^\n]*)$", 1)
    body = F.regexp_replace(text, r"(?dm)^#+ [^\n]*$", "")
    return F.concat(L("本章介绍："), title, L("。本章小结："), F.array_join(F.slice(E.sentences(body), 1, 2), ""))


def technical_terms(text: Column) -> Column:
    """Class names, capitals, names before a bracket and dictionary terms, each once."""
    return F.array_union(F.array_union(X.every(text, X.CAMEL), X.every(text, X.CAPS)), F.array_union(X.every(text, X.METHOD), X.known(text, TERMS)))


def routed(files: DataFrame) -> DataFrame:
    """Each file's Chinese ratio, term density and what becomes of it."""
    rows = files.select("file_name", E.chinese_ratio(F.col("content")).alias("ratio"), E.term_density(F.col("content"), TERMS).alias("density"))
    return rows.withColumn("route", E.route(F.col("ratio"), F.col("density")))


def code_languages(files: DataFrame) -> DataFrame:
    """Number of fenced blocks by detected language."""
    codes = files.select(F.explode(X.every(F.col("content"), X.FENCE)).alias("code"))
    return codes.groupBy(E.detect_language(F.col("code")).alias("language")).agg(F.count("*").alias("n_blocks"))


def toc_depth(files: DataFrame) -> DataFrame:
    """Levels of headings in use."""
    level = F.explode(F.transform(X.every(F.col("content"), r"(?dm)^(#{1,6}) ", 1), F.length))
    return files.select(level.alias("level")).agg(F.max("level").cast("long").alias("depth"), F.count_distinct("level").alias("levels"))


def toc_entries(files: DataFrame) -> DataFrame:
    """The number of entries in each table of contents that marks them [ch:."""
    return files.select("file_name", X.count(F.col("content"), r"\[ch:").alias("n_entries"))
