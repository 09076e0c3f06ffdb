"""Places of regex matches as columns, in code points, and cutting texts at places, with built-in functions only and in linear time."""

from __future__ import annotations

SPAN = "struct<start: bigint, stop: bigint, value: string>"
#: Items that a pass gathers before it sets them aside, and code points in a block of a text.
CHUNK, BLOCK = 64, 1024


def running(array: str, kind: str, after: str, keep: str, item: str, zero: str = "0L", state: str = "bigint") -> str:
    """SQL for a pass over an array that carries a.at, a place from 0 or another state: of each x, item (of type kind) is gathered if keep, and after is the next state.

    Arrays cannot be appended to without a copy, so a chunk's items are gathered first and chunks are joined once at the end.
    """
    inner = (
        f"aggregate(slice(w, k * {CHUNK} + 1, {CHUNK}), named_struct('at', s.at, 'out', cast(array() as array<{kind}>)), "
        f"(a, x) -> named_struct('at', cast({after} as {state}), 'out', if({keep}, concat(a.out, array({item})), a.out)))"
    )
    outer = (
        f"aggregate(sequence(0, cast((size(w) - 1) div {CHUNK} as int)), named_struct('at', {zero}, 'out', cast(array() as array<array<{kind}>>)), "
        f"(s, k) -> transform(array({inner}), i -> named_struct('at', i.at, 'out', concat(s.out, array(i.out))))[0], s -> flatten(s.out))"
    )
    return f"transform(array({array}), w -> if(size(w) > 0, {outer}, cast(array() as array<{kind}>)))[0]"


def spans(text: str, pattern: str, keep: str = "true") -> str:
    """SQL for the leftmost non-overlapping matches of pattern in text (SQL expressions both) as array<SPAN>; keep is a condition on value.

    split() gives what lies between the matches and regexp_extract_all() the matches; lengths add up to places. Only kept matches are
    collected, so the work follows the text's length.
    """
    value = "x.`1`"
    start = "(a.at + length(x.`0`))"
    kept = keep.replace("value", value)
    item = f"named_struct('start', cast({start} as bigint), 'stop', cast({start} + length({value}) as bigint), 'value', {value})"
    return running(f"arrays_zip(split({text}, {pattern}, -1), regexp_extract_all({text}, {pattern}, 0))", SPAN, f"{start} + coalesce(length({value}), 0)", f"{value} is not null and ({kept})", item)


def blocks(text: str) -> str:
    """SQL for a text as an array of blocks, of which cut() takes parts without a walk from the text's start."""
    return f'regexp_extract_all({text}, r"(?s).{{1,{BLOCK}}}", 0)'


def cut(held: str, a: str, b: str) -> str:
    """SQL for the code points a to b (exclusive) of blocks() as an array of strings."""
    first, last = f"cast({a} div {BLOCK} as int)", f"cast({b} div {BLOCK} as int)"
    return (
        f"if({first} = {last}, array(substring(get({held}, {first}), cast({a} % {BLOCK} + 1 as int), cast({b} - {a} as int))), "
        f"concat(array(substring(get({held}, {first}), cast({a} % {BLOCK} + 1 as int))), slice({held}, {first} + 2, {last} - {first} - 1), array(substring(get({held}, {last}), 1, cast({b} % {BLOCK} as int)))))"
    )


PART = "struct<begin: bigint, start: bigint, stop: bigint, label: string>"


def replaced(held: str, size: str, marks: str, new: str, clip: bool = False) -> str:
    """SQL for a text (held as blocks, of size code points) in which marks (array of structs start, stop, label) are replaced by new, SQL on the string ``old`` and i.label.

    Marks count in the order of start; what an earlier one covers already stays covered. A mark that begins there goes with the earlier one, or
    (clip) what it has beyond it is replaced for itself.
    """
    begins = "greatest(a.at, x.start)" if clip else "x.start"
    item = f"named_struct('begin', a.at, 'start', {begins}, 'stop', x.stop, 'label', x.label)"
    parts = running(f"array_sort(transform({marks}, m -> named_struct('start', m.start, 'stop', m.stop, 'label', m.label)))", PART, "greatest(a.at, x.stop)", "x.stop > a.at" if clip else "x.start >= a.at", item)
    made = new.replace("old", f"array_join({cut(held, 'i.start', 'i.stop')}, '')")
    end = f"array_max(transform({marks}, m -> m.stop))"
    return f"array_join(concat(flatten(transform({parts}, i -> concat({cut(held, 'i.begin', 'i.start')}, array({made})))), {cut(held, end, size)}), '')"


def literal(pattern: str) -> str:
    """A Java regex as an SQL raw string."""
    assert '"' not in pattern
    return f'r"{pattern}"'
