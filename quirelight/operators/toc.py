"""Tables of contents: the tree of headings of each chapter, and how the trees of two editions compare.

A heading's parent is the last heading before it of a lower level. As levels are few, one window along the lines keeps the last place of each level, and the
parent is the latest of those below the heading's own; the same values give the whole path, as a level counts only if it was seen after all lower ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LEVELS = 6
#: Of plain texts: letters of a line up to which it is a heading of level 3 or 2; the first line of a text is of level 1.
SHORT, MIDDLE = 40, 80


def lines(rows: DataFrame, *keep: str) -> DataFrame:
    """id, place (from 1), line of (id, text), and the columns keep; null texts have none."""
    return rows.select("id", *keep, F.posexplode(F.split("text", "\n")).alias("k", "line")).select("id", *keep, (F.col("k") + 1).alias("place"), "line")


def headings(rows: DataFrame) -> DataFrame:
    """id, place, level, title of the Markdown headings of (id, text); what stands in fenced code is none. Marks at the end of a title go."""
    along = Window.partitionBy("id").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    fences = F.coalesce(F.count_if(F.startswith("line", F.lit("```"))).over(along), F.lit(0))
    level = F.length(F.regexp_extract("line", r"^(#{1,6})[ \t]+[^ \t\r#]", 1))
    title = F.regexp_replace(F.regexp_replace("line", r"^#{1,6}[ \t]+", ""), r"[ \t#\r]+$", "")
    # only lines that begin as headings or fences matter, and only these are moved
    marked = lines(rows).where(F.startswith("line", F.lit("#")) | F.startswith("line", F.lit("```")))
    return marked.withColumn("fences", fences).withColumn("level", level).where("level > 0 and fences % 2 = 0").select("id", "place", "level", title.alias("title"))


def plain_headings(rows: DataFrame) -> DataFrame:
    """id, place, level, title of texts without marks: the first line that is not blank, and short lines after it (our decision)."""
    shown = lines(rows).withColumn("title", F.regexp_replace("line", r"^[ \t\r]+|[ \t\r]+$", "")).where("title <> ''")
    first = F.row_number().over(Window.partitionBy("id").orderBy("place")) == 1
    level = F.when(first, 1).when(F.length("title") <= SHORT, 3).when(F.length("title") <= MIDDLE, 2)
    return shown.withColumn("level", level).where("level is not null").select("id", "place", "level", "title")


def tree(found: DataFrame) -> DataFrame:
    """id, place, level, title, parent (its place, null at the top), depth (from 1), path (titles from the top, joined by " / "), sibling (from 1)."""
    along = Window.partitionBy("id").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    last = [F.max(F.when(F.col("level") == k, F.struct("place", "title"))).over(along).alias(f"last{k}") for k in range(1, LEVELS)]
    rows = found.select("id", "place", "level", "title", *last)
    seen = [F.col(f"last{k}") for k in range(1, LEVELS)]
    # a level counts if it is lower than the heading's and was seen after all levels below it
    after = [seen[0].isNotNull(), *(seen[k].isNotNull() & (seen[k]["place"] > F.coalesce(F.greatest(*(x["place"] for x in seen[:k])) if k > 1 else seen[0]["place"], F.lit(0))) for k in range(1, LEVELS - 1))]
    above = F.array_compact(F.array(*(F.when((F.col("level") > k) & ok, x) for k, (x, ok) in enumerate(zip(seen, after), 1))))
    rows = rows.withColumn("above", above)
    rows = rows.select("id", "place", "level", "title", F.get(F.col("above.place"), F.size("above") - 1).alias("parent"), (F.size("above") + 1).alias("depth"), F.array_join(F.concat(F.col("above.title"), F.array("title")), " / ").alias("path"))
    return rows.withColumn("sibling", F.row_number().over(Window.partitionBy("id", "parent").orderBy("place")))


def depths(found: DataFrame) -> DataFrame:
    """id, n_headings, depth, outline (depths in order, joined) of the trees; the outline is what two editions should share."""
    rows = tree(found).groupBy("id").agg(F.count("*").alias("n_headings"), F.max("depth").alias("depth"), F.array_sort(F.collect_list(F.struct("place", "depth"))).alias("o"))
    return rows.select("id", "n_headings", "depth", F.array_join(F.transform("o", lambda x: x["depth"].cast("string")), ",").alias("outline"))


def compared(paired: DataFrame) -> DataFrame:
    """key, headings and depth of both editions, and whether their outlines agree; an edition without headings has 0 of depth 0."""
    side = lambda c, name: depths(headings(paired.select(F.col("key").alias("id"), F.col(c).alias("text")))).select(F.col("id").alias("key"), *(F.col(x).alias(f"{name}_{x}") for x in ("n_headings", "depth", "outline")))
    rows = paired.select("key").join(side("original", "o"), "key", "left").join(side("translated", "t"), "key", "left")
    rows = rows.na.fill(0).na.fill("")
    return rows.select("key", "o_n_headings", "t_n_headings", "o_depth", "t_depth", (F.col("o_outline") == F.col("t_outline")).alias("same_outline"))


def contents_lines(found: DataFrame) -> DataFrame:
    """The table of contents as Markdown, a line for each heading, indented by its depth."""
    rows = tree(found)
    return rows.select("id", "place", F.concat(F.repeat(F.lit("  "), F.col("depth") - 1), F.lit("- "), "title").alias("line"))
