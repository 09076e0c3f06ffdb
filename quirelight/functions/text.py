"""Text functions as columns, with character classes that agree with Python's on every engine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Python's \s and \w as classes (Java's own are ASCII).
WS = r"[\t-\r\x1c-\x20\x{85}\p{Z}]"
NOT_WS = r"[^\t-\r\x1c-\x20\x{85}\p{Z}]"
W = r"[\p{L}\p{N}_]"
B0, B1 = rf"(?<!{W})", rf"(?!{W})"
# The patterns decide what the audits find.
FENCE = r"```[\s\S]*?```"
QUOTE = r"(?dm)^>[\s\S]*?(?=^>|\n\n|\z)"
HTML_CODE = r"(?s)<blockquote[^>]*>(.*?)</blockquote>"
HTML_IMAGE = r'<img[^>]*src="([^"]+)"[^>]*alt="([^"]*)"[^>]*/?>'
MD_IMAGE = r"(?d)!\[(.*?)\]\((.*?)\)"
CAMEL = rf"{B0}[A-Z][a-z]+(?:[A-Z][a-z]+)+{B1}"
CAPS = rf"{B0}[A-Z]{{2,}}{B1}"
METHOD = rf"{B0}[a-z][a-zA-Z0-9]*(?=\()"


def every(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("long")


def strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"^{WS}+|{WS}+\z", "")


def squeeze(text: Column) -> Column:
    return strip(F.regexp_replace(text, rf"{WS}+", " "))


def words(text: Column) -> Column:
    return count(text, rf"{NOT_WS}+")


def newlines(text: Column) -> Column:
    """Universal newlines."""
    return F.regexp_replace(text, r"\r\n?", "\n")


def md_prose(text: Column) -> Column:
    """Markdown without code, images, link targets, marks of headings and quotations, and rules, in that order."""
    for pattern, new in ((FENCE, ""), (r"`[^`]+`", ""), (r"(?d)!\[.*?\]\(.*?\)", ""), (r"\[([^\]]+)\]\([^)]+\)", "$1"), (rf"(?dm)^#+{WS}+", ""), (rf"(?dm)^>{WS}+", ""), (r"(?dm)^---+$", "")):
        text = F.regexp_replace(text, pattern, new)
    return strip(text)


def html_prose(text: Column) -> Column:
    """HTML without styles, quotation blocks (code) and image containers; tags become spaces."""
    for pattern in (r"(?s)<style[^>]*>.*?</style>", r"(?s)<blockquote[^>]*>.*?</blockquote>", r'(?s)<div class="image-container">.*?</div>'):
        text = F.regexp_replace(text, pattern, "")
    return squeeze(F.regexp_replace(text, r"<[^>]+>", " "))


def code_count(text: Column) -> Column:
    """Fenced blocks plus quotation lines: each block of quotation begins at a line with > and ends before the next one."""
    return count(text, FENCE) + count(text, r"(?dm)^>")


def code_blocks(text: Column) -> Column:
    return F.concat(every(text, FENCE), every(text, QUOTE))


def images(text: Column, pattern: str, alt: int, src: int) -> Column:
    return F.arrays_zip(every(text, pattern, alt).alias("alt"), every(text, pattern, src).alias("src"))


def known(text: Column, terms: list[str]) -> Column:
    """Terms that are substrings of text, as an array; no rows are multiplied.

    A term of ASCII letters with a capital lies inside a word with a capital: it is looked for in those words only, each once.
    """
    capital = [t for t in terms if t.isascii() and t.isalpha() and not t.islower()]
    other = [t for t in terms if t not in capital]
    found = lambda where, some: F.array_compact(F.array(*(F.when(F.contains(where, F.lit(t)), F.lit(t)) for t in some)))
    plain = found(text, other) if other else F.array().cast("array<string>")
    if not capital:
        return plain
    words = F.array_join(F.array_distinct(every(text, "(?<![A-Za-z])[a-z]*+[A-Z][A-Za-z]*+")), " ")
    # a lambda's argument is computed once
    return F.concat(plain, F.get(F.transform(F.array(words), lambda w: found(w, capital)), F.lit(0)))


def has_identifier(text: Column, name: str) -> Column:
    """At word boundaries; the regex runs only where the bare name is."""
    return F.contains(text, F.lit(name)) & text.rlike(rf"{B0}{name}{B1}")


def preview(text: Column) -> Column:
    return F.when(F.length(text) > 50, F.concat(F.substring(text, 1, 50), F.lit("..."))).otherwise(text)
