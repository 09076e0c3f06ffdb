"""Alignment of two editions of a chapter: which blocks correspond, and which differences are to be expected.

A chapter is cut into blocks: fenced or quoted code, and every other line that is not blank, an image, heading, quotation, table row, item or paragraph by
how it begins. Blocks of both editions are aligned in order by dynamic programming over steps of 1-1, 1-0, 0-1, 2-1 and 1-2 blocks. What a step costs follows from lengths, measured
against the lengths of the whole chapters as a translation is shorter or longer throughout, and from kinds and image names. Costs are whole
numbers, and of equal ones the first step in that order is taken, so the alignment is defined in full.

The program runs inside one expression per pair of chapters: cells of a diagonal depend on earlier diagonals only, so each diagonal is a transform() over the
translation's blocks and the diagonals are folded by aggregate(). A pair needs (n + m)(m + 1) cells, n and m being its numbers of blocks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Both engines read it alike: lines end at \n, no look-around, nothing that repeats a group.
BLOCK = r"(?:```[\s\S]*?```[^\n]*|<blockquote[\s\S]*?</blockquote>[^\n]*|[^\n]*[^\n\t\r ][^\n]*)"
#: Steps: blocks of the original and of the translation. A cell holds 8 * cost + step.
STEPS = [(1, 1), (1, 0), (0, 1), (2, 1), (1, 2)]
#: Costs: a block left out or added; two blocks for one; a code block in place of an image; other kinds that differ; another image.
SKIP, JOIN, RECOGNISED, KIND, OTHER_IMAGE = 60, 15, 40, 110, 50
#: Deviation of lengths, in percent, from which a paragraph counts as cut or blown up.
LONG = 50

# SQL that Spark and DuckDB both accept, over columns o and t: arrays of structs (kind, size, name).
KIND_SQL = "CASE WHEN left({0}, 3) = '```' OR left({0}, 11) = '<blockquote' THEN 'code' WHEN left({0}, 2) = '![' OR left({0}, 4) = '<img' THEN 'image' WHEN left({0}, 1) = '#' THEN 'heading' WHEN left({0}, 1) = '>' THEN 'quote' WHEN left({0}, 1) = '|' THEN 'table' WHEN left({0}, 2) = '- ' OR left({0}, 2) = '* ' THEN 'item' ELSE 'paragraph' END"
#: Of an image the last part of its path.
NAME_SQL = """CASE WHEN left({0}, 4) = '<img' THEN regexp_extract({0}, 'src="(?:[^"]*/)?([^"/]*)"', 1) WHEN left({0}, 2) = '![' THEN regexp_extract({0}, '([^/("]+)[)"]', 1) ELSE '' END"""


def deviation(a: str, b: str) -> str:
    """SQL for how far sizes a and b are apart, in percent, given the sizes of the chapters (os, ts)."""
    return f"CAST(floor(100.0e0 * abs(CAST({a} AS DOUBLE) * ts - CAST({b} AS DOUBLE) * os) / (CAST({a} AS DOUBLE) * ts + CAST({b} AS DOUBLE) * os)) AS INT)"


def match_cost(a: str, b: str) -> str:
    """SQL for the cost of a 1-1 step of the blocks a and b."""
    far = deviation(f"{a}.size", f"{b}.size")
    return (
        f"CASE WHEN {a}.kind = 'image' AND {b}.kind = 'image' THEN CASE WHEN {a}.name = {b}.name THEN 0 ELSE {OTHER_IMAGE} END WHEN {a}.kind = 'image' AND {b}.kind = 'code' THEN {RECOGNISED} "
        f"WHEN {a}.kind = {b}.kind THEN CAST(floor({far} / 2.0e0) AS INT) ELSE {KIND} + CAST(floor({far} / 4.0e0) AS INT) END"
    )


def _cell(at: str) -> str:
    """Spark SQL for the cell (i, j) of a diagonal, given the diagonals a.d1, a.d2, a.d3 before it."""
    o = lambda k: f"get(o, cast(i - {k} as int))"
    t = lambda k: f"get(t, cast(j - {k} as int))"
    before = {1: "a.d1", 2: "a.d2", 3: "a.d3"}
    parts = []
    for step, (x, y) in enumerate(STEPS):
        old = f"shiftright(get({before[x + y]}, cast(j - {y} as int)), 3)"
        if x + y == 1:
            cost = str(SKIP)
        elif x == y:
            cost = match_cost(o(1), t(1))
        elif x == 2:
            far = deviation(f"({o(2)}.size + {o(1)}.size)", f"{t(1)}.size")
            cost = f"CASE WHEN {o(2)}.kind = 'paragraph' AND {o(1)}.kind = 'paragraph' AND {t(1)}.kind = 'paragraph' THEN {JOIN} + CAST(floor({far} / 2.0e0) AS INT) END"
        else:
            far = deviation(f"{o(1)}.size", f"({t(2)}.size + {t(1)}.size)")
            cost = f"CASE WHEN {o(1)}.kind = 'paragraph' AND {t(2)}.kind = 'paragraph' AND {t(1)}.kind = 'paragraph' THEN {JOIN} + CAST(floor({far} / 2.0e0) AS INT) END"
        parts.append(f"case when i >= {x} and j >= {y} then 8 * ({old} + {cost}) + {step} end")
    return f"element_at(transform(array({at}), i -> case when i between 0 and size(o) then least({', '.join(parts)}) end), 1)"


def blocks(text: str) -> str:
    """Spark SQL for the blocks of a text as array<struct<kind, size, name>>."""
    found = f"regexp_extract_all({text}, r'(?dm)^{BLOCK}', 0)"
    return f"transform({found}, x -> named_struct('kind', {KIND_SQL.format('x')}, 'size', length(x), 'name', {NAME_SQL.format('x')}))"


def aligned(paired: DataFrame) -> DataFrame:
    """key, step, o_from, o_blocks, t_from, t_blocks, kind, t_kind, deviation, difference, expected: a row for each aligned step of each pair.

    Places count blocks from 1; where a step has none of a side, its place is that of the next one. difference is same, split, merged, length,
    kind, recognised (an image's text as code), image (another one), missing or added; expected says whether a translation is to have it.
    Nulls in either text count as empty chapters; a pair without any block gives no row.
    """
    empty = F.lit("")
    rows = paired.select("key", F.coalesce("original", empty).alias("original"), F.coalesce("translated", empty).alias("translated"))
    rows = rows.select("key", F.expr(blocks("original")).alias("o"), F.expr(blocks("translated")).alias("t")).where("size(o) + size(t) > 0")
    size = lambda x: f"greatest(1, aggregate({x}, 0, (a, b) -> a + b.size))"
    rows = rows.select("key", "o", "t", F.expr(size("o")).alias("os"), F.expr(size("t")).alias("ts"))
    # diagonal s holds the cells with i + j = s, by j
    none = "cast(null as array<int>)"
    first = "transform(sequence(0, size(t)), j -> if(j = 0, 0, cast(null as int)))"
    diagonal = f"transform(sequence(0, size(t)), j -> {_cell('s - j')})"
    # a diagonal joins the others one step late, by reference: a lambda's result would be copied, and with it all diagonals before it
    fold = f"aggregate(sequence(1, size(o) + size(t)), named_struct('d1', {first}, 'd2', {none}, 'd3', {none}, 'all', cast(array() as array<array<int>>)), (a, s) -> named_struct('d1', {diagonal}, 'd2', a.d1, 'd3', a.d2, 'all', concat(a.all, array(a.d1))), a -> concat(a.all, array(a.d1)))"
    rows = rows.withColumn("table", F.expr(fold))
    # back from the last cell: the steps taken, last one first
    spans = "array(" + ", ".join(f"named_struct('x', {x}, 'y', {y})" for x, y in STEPS) + ")"
    step = f"get({spans}, get(get(table, a.i + a.j), a.j) & 7)"
    at = f"named_struct('i', a.i - {step}.x, 'j', a.j - {step}.y, 'path', concat(a.path, array(named_struct('i', a.i - {step}.x, 'j', a.j - {step}.y, 'x', {step}.x, 'y', {step}.y))))"
    back = f"aggregate(sequence(1, size(o) + size(t)), named_struct('i', size(o), 'j', size(t), 'path', cast(array() as array<struct<i: int, j: int, x: int, y: int>>)), (a, s) -> if(a.i + a.j = 0, a, {at}), a -> reverse(a.path))"
    rows = rows.select("key", "o", "t", "os", "ts", F.posexplode(F.expr(back)).alias("k", "p"))
    part = lambda side, at, n: f"slice({side}, p.{at} + 1, p.{n})"
    total = lambda side, at, n: f"aggregate({part(side, at, n)}, 0, (a, b) -> a + b.size)"
    rows = rows.select(
        "key", "os", "ts", F.col("k").alias("place"), "p", F.expr("get(o, p.i)").alias("a"), F.expr("get(t, p.j)").alias("b"),
        F.expr(f"case when p.x > 0 and p.y > 0 then {deviation(total('o', 'i', 'x'), total('t', 'j', 'y'))} end").alias("deviation"),
    )
    rows = rows.withColumn("difference", F.expr(difference("p.x", "p.y", "a", "b", "deviation")))
    kind = lambda n, block: F.expr(f"case when p.{n} > 0 then {block}.kind end")
    return rows.select(
        "key", (F.col("place") + 1).alias("step"), (F.col("p.i") + 1).alias("o_from"), F.col("p.x").alias("o_blocks"), (F.col("p.j") + 1).alias("t_from"), F.col("p.y").alias("t_blocks"),
        kind("x", "a").alias("kind"), kind("y", "b").alias("t_kind"), "deviation", "difference", F.expr(expected("difference", kind="case when p.y > 0 then b.kind end")).alias("expected"),
    )


def difference(x: str, y: str, a: str, b: str, far: str) -> str:
    """SQL for the class of a step."""
    return (
        f"CASE WHEN {y} = 0 THEN 'missing' WHEN {x} = 0 THEN 'added' WHEN {x} = 2 THEN 'merged' WHEN {y} = 2 THEN 'split' WHEN {a}.kind = 'image' AND {b}.kind = 'code' THEN 'recognised' "
        f"WHEN {a}.kind <> {b}.kind THEN 'kind' WHEN {a}.kind = 'image' AND {a}.name <> {b}.name THEN 'image' WHEN {a}.kind = 'paragraph' AND {far} >= {LONG} THEN 'length' ELSE 'same' END"
    )


def expected(name: str, kind: str) -> str:
    """SQL for whether a translation is to have the difference: joined and cut paragraphs, recognised code, and notes (quotations) beside what there was."""
    return f"({name} IN ('same', 'split', 'merged', 'recognised') OR ({name} = 'added' AND {kind} = 'quote'))"


def summary(paired: DataFrame) -> DataFrame:
    """Number of steps and of chapters by kind of block, difference and expectation."""
    rows = aligned(paired).withColumn("kind", F.coalesce("kind", "t_kind"))
    return rows.groupBy("kind", "difference", "expected").agg(F.count("*").alias("n_steps"), F.count_distinct("key").alias("n_chapters"))


def to_confirm(paired: DataFrame) -> DataFrame:
    """What somebody has to look at, a line for each difference that is not expected."""
    rows = aligned(paired).where("not expected")
    where = F.format_string("第%d块 / 第%d块", "o_from", "t_from")
    return rows.select("key", "step", F.concat(F.lit("- "), where, F.lit("："), F.coalesce("kind", "t_kind"), F.lit(" "), "difference").alias("line"))
