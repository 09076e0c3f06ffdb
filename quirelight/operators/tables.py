"""Tables between bars told as sentences: lines to islands, header and rule found, bars that are escaped kept in their cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .toc import lines

#: Stands for an escaped bar while a line is cut.
BAR = "\ue001"
RULE = r"^[ \t]*\|?[ \t]*:?-+:?[ \t]*(\|[ \t]*:?-+:?[ \t]*)*\|?[ \t\r]*$"


def cells(line: Column) -> Column:
    """The cells of a line, trimmed, without the empty ones that bars at both ends make."""
    held = F.regexp_replace(F.replace(line, F.lit("\\|"), F.lit(BAR)), r"^[ \t]*\|?|\|?[ \t\r]*$", "")
    return F.transform(F.split(held, r"\|"), lambda x: F.replace(F.regexp_replace(x, r"^[ \t]+|[ \t]+$", ""), F.lit(BAR), F.lit("|")))


def tables(rows: DataFrame) -> DataFrame:
    """id, island, line (from 0), cells, rule (whether it is one), head (whether the table has a header) of the tables of (id, text).

    A table is a run of lines with a bar that is not escaped. It has a header if its second line is a rule.
    """
    bars = lines(rows).where(F.contains(F.replace("line", F.lit("\\|"), F.lit("")), F.lit("|")))
    # gaps and islands: consecutive places keep their distance to the row number
    own = bars.withColumn("island", F.col("place") - F.row_number().over(Window.partitionBy("id").orderBy("place")))
    run = Window.partitionBy("id", "island").orderBy("place")
    rule = F.col("line").rlike(RULE)
    own = own.withColumn("k", F.row_number().over(run) - 1).withColumn("rule", rule)
    every = Window.partitionBy("id", "island")
    return own.withColumn("head", F.max((F.col("k") == 1) & F.col("rule")).over(every)).select("id", "island", "place", "k", "rule", "head", cells(F.col("line")).alias("cells"))


def told(rows: DataFrame) -> DataFrame:
    """id, place, row (from 1), sentence of each row of data: "header：cell，…。"; columns without a header are called by their number, empty cells are not told."""
    found = tables(rows).withColumn("names", F.max(F.when(F.col("head") & (F.col("k") == 0), F.col("cells"))).over(Window.partitionBy("id", "island")))
    data = found.where("not rule and not (head and k = 0)")
    numbered = data.withColumn("row", F.row_number().over(Window.partitionBy("id", "island").orderBy("place")))
    name = lambda i: F.coalesce(F.get("names", i), F.concat(F.lit("第"), (i + 1).cast("string"), F.lit("列")))
    parts = F.filter(F.transform("cells", lambda c, i: F.when(c != "", F.concat(name(i), F.lit("："), c))), lambda x: x.isNotNull())
    return numbered.select("id", "place", "row", F.concat(F.array_join(parts, "，"), F.lit("。")).alias("sentence"))
