"""The page renderer against a recursive one on generated pages, and on markup made to be slow or deep."""

from __future__ import annotations

import random
import time

import pytest

from quirelight.llm.html_text import visible_text

GAP = object()


def grown(rng, depth, inside=""):
    """A random tree: a text, or (tag, children)."""
    kinds = ["text"] * 3 + (["p", "div", "ul", "ol", "blockquote", "h2", "table", "hidden"] if depth else [])
    kind = rng.choice(kinds) if inside not in ("ul", "ol") else "li"
    if kind == "text":
        return " ".join(f"w{rng.randrange(90)}" for _ in range(rng.randrange(1, 4)))
    if kind == "table":
        wide = rng.randrange(1, 4)
        return kind, [("tr", [("td", [grown(rng, min(depth - 1, 1), "td") for _ in range(rng.randrange(0, 3))]) for _ in range(wide)]) for _ in range(rng.randrange(1, 3))]
    n = rng.randrange(0, 4)
    return kind, [grown(rng, depth - 1 if kind != "li" else depth, kind) if depth or inside not in ("ul", "ol") else "x" for _ in range(n)] if kind != "p" else [grown(rng, 0) for _ in range(n)]


def markup(node):
    if isinstance(node, str):
        return node
    tag, kids = node
    if tag == "hidden":
        return "<div hidden>" + "".join(map(markup, kids)) + "</div>"
    return f"<{tag}>" + " ".join(map(markup, kids)) + f"</{tag}>"


def blocks(kids, inside=""):
    """Lines and gaps of what an element holds; neighbouring texts are one line."""
    out, run, number = [], [], 1
    for kid in [*kids, ("", [])]:
        tag, inner = ("text", kid) if isinstance(kid, str) else kid
        if tag == "text":
            run.append(kid)
        if tag in ("text", "hidden"):  # what is not displayed breaks no line
            continue
        if run:
            out.append(" ".join(run))
            run = []
        if not tag:
            continue
        got = blocks(inner, tag)
        if tag == "li":
            got = trimmed(got)
            if got:
                mark = f"{number}. " if inside == "ol" else "- "
                number += 1
                got = [mark + got[0], *(x if x is GAP or not x else " " * len(mark) + x for x in got[1:])]
        elif tag == "blockquote":
            got = [GAP, *(x if x is GAP or not x else "  " + x for x in got), GAP]
        elif tag == "table":
            rows = [[settled(blocks(cell, "td")) for _, cell in row] for _, row in inner]
            width = [max(len(x) for row in rows for x in [*row[k], ""]) for k in range(len(rows[0]))]
            got = []
            for row in rows:
                for i in range(max(map(len, row))):
                    got.append(" | ".join((c[i] if i < len(c) else "").ljust(w) for c, w in zip(row, width)).rstrip() if len(row) > 1 else row[0][i])
            got = [GAP, *got, GAP]
        elif tag in ("p", "h2") or (tag in ("ul", "ol") and inside != "li"):
            got = [GAP, *got, GAP]
        out += got
    return out


def trimmed(got):
    while got and got[0] is GAP:
        got = got[1:]
    while got and got[-1] is GAP:
        got = got[:-1]
    return got


def settled(got):
    out = []
    for x in trimmed(got):
        if x is not GAP:
            out.append(x)
        elif out[-1] != "":
            out.append("")
    return out


def test_generated_pages():
    rng = random.Random(11)
    for _ in range(600):
        kids = [grown(rng, 3) for _ in range(rng.randrange(1, 5))]
        page = " ".join(map(markup, kids))
        want = "\n".join(settled(blocks(kids))).strip("\n")
        assert visible_text(page) == want, page


HARD = [
    ("<head>", "<body>x"), ("<table><caption>", ""), ("<ul><li>a", ""), ("<a ", ""), ("<a ", ">"), ("<a '\"", ">"), ("<!", ""), ("<table><tr><td>a<td>b", ""), ("<table><td colspan=1000>x", ""),
    ("<table><tr><td rowspan=1000 colspan=1000>x<tr>", ""), ("<b><table><i>", "</b>" * 1000), ("<p><b>", ""), ("<dl><dd>x", ""), ("<svg><text>a", ""), ("<title>", ""), ("<pre>\n", ""),
]


@pytest.mark.parametrize("unit, tail", HARD)
def test_time_and_text_grow_with_the_page(unit, tail):
    def took(size):
        page = unit * (size // len(unit)) + tail
        start = time.process_time()
        text = visible_text(page)
        return time.process_time() - start, len(text)

    took(1 << 16)
    (small, _), (large, length) = min(took(1 << 18), took(1 << 18)), took(1 << 20)
    # four times the page: four times the time in proportion, sixteen times in squares
    assert large < 10 * max(small, 0.05) and length < 16 << 20


def test_wide_cells_do_not_widen_others_and_lose_nothing():
    page = "<table><tr><td>" + "word " * 4000 + "<td>x" + "<tr><td>a<td>b" * 2000 + "</table>"
    text = visible_text(page)
    assert text.count("word") == 4000 and text.count("a | b") == 2000 and len(text) < 40_000
    tall = "<table><tr><td>" + "x<br>" * 20_000 + "<td>y" * 2000
    assert visible_text(tall).split().count("x") == 20_000 and visible_text(tall).split().count("y") == 2000


def test_formulas_and_drawings():
    assert visible_text("<p>so <math><mi>a</mi><mo>=</mo><annotation>TeX</annotation></math> <svg><title>t</title><path/>no<text>label</text><foreignObject><p>yes</p></foreignObject></svg>") == "so a=\nlabel\n\nyes"


def test_two_thousand_unclosed_heads_and_deep_lists():
    assert visible_text("<head>" * 2000 + "<body>shown") == "shown"
    assert visible_text("<table>" + "<caption>" * 2000 + "c</table>after") == "c\n\nafter"
    deep = visible_text("<ul><li>a" * 10_000)
    assert deep.count("a") == 10_000 and len(deep) < 600_000
