"""Removal of word passages that an earlier document already has (substring dedup by difference-cover anchors).

A window of ``width`` words is hashed only where a shorter *anchor* starts at a covered place: places p with
p mod 7 in {1, 2, 4}. These residues are a perfect difference cover of 7, so for two equal windows there is a shift
below 7 at which both have an anchor; an anchor of ``width - 6`` words then lies inside both windows. Pass A
finds the anchors that more than one document has (an exchange of about 3/7 of the words' hashes). Pass B extends
them: each window around a shared anchor is asked for by a 128-bit hash, of which 80 bits beside the bucket are
sent, and the smallest document that has it is found. Pass C marks the words and writes what is left.

Equal texts are collapsed first: a copy of at least ``width`` words loses all of them, since the first one has all its windows.

Defined results: null text is empty; rows without a doc_id take no part; rows that repeat a doc_id are judged by
that id (a window is never removed for the sake of a row with the same id); other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as B
from . import stage
from .words import Words, windows

PERIOD = 7
COVER = np.zeros(PERIOD, bool)
COVER[[1, 2, 4]] = True


def _groups(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order and starts of runs of equal keys."""
    order = np.argsort(keys, kind="stable")
    s = keys[order]
    return order, np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]])) if len(s) else np.empty(0, np.int64)


class _Block:
    """What every pass recomputes from a block."""

    def __init__(self, data: bytes, width: int):
        self.ids, self.texts = B.unpack(data)
        self.words = w = Words(self.texts)
        self.h = w.hashes(0)
        size = width - PERIOD + 1
        a = windows(self.h, size)
        self.at = np.flatnonzero(w.whole(size) & COVER[w.places()[: len(a)] % PERIOD])
        self.keys = a[self.at]
        self.order, self.starts = _groups(self.keys)
        self.distinct = self.keys[self.order[self.starts]]

    def several(self) -> np.ndarray:
        """For each distinct anchor: whether rows of the block with different texts have it."""
        if not len(self.starts):
            return np.empty(0, bool)
        d = self.words.doc[self.at[self.order]]
        return np.minimum.reduceat(d, self.starts) != np.maximum.reduceat(d, self.starts)

    def asked(self, width: int, shared: np.ndarray) -> None:
        """The windows around shared anchors: their places, order by 128-bit hash, distinct ones and the smallest id of each."""
        hit = np.zeros(len(self.h) + PERIOD, bool)
        runs = np.diff(np.concatenate([self.starts, [len(self.keys)]]))
        hit[self.at[self.order[np.repeat(shared, runs)]]] = True
        near = hit[: len(self.h)].copy()
        for k in range(1, PERIOD):
            near |= hit[k : k + len(self.h)]
        whole = self.words.whole(width)
        self.wat = np.flatnonzero(near[: len(whole)] & whole)
        if not len(self.wat):
            self.wstarts = self.worder = np.empty(0, np.int64)
            self.w0 = self.w1 = np.empty(0, np.uint64)
            self.least = np.empty(0, np.int64)
            return
        w0, w1 = windows(self.h, width)[self.wat], windows(self.words.hashes(1), width, 1)[self.wat]
        self.worder = np.lexsort((w1, w0))
        a, b = w0[self.worder], w1[self.worder]
        self.wstarts = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
        self.w0, self.w1 = a[self.wstarts], b[self.wstarts]
        self.least = np.minimum.reduceat(self.ids[self.words.doc[self.wat[self.worder]]], self.wstarts)


def _bits(answers: object, n: np.ndarray, parts: int) -> np.ndarray:
    """One bit per distinct key from the answers of the buckets that were asked."""
    out = np.zeros(len(n), bool)
    cut = B.split(n, parts)
    for x in answers if answers is not None else ():
        a, b = cut[x["bucket"]], cut[x["bucket"] + 1]
        out[a:b] = np.unpackbits(np.frombuffer(x["data"], np.uint8), count=b - a).astype(bool)
    return out


def _rows(block: int, made: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.record_batch({"block": pa.array([block] * len(made), pa.int64()), "bucket": pa.array([k for k, _ in made], pa.int32()), "data": pa.array([d for _, d in made], pa.binary())})


def _shared(lists: list[bytes]) -> list[bytes]:
    """Anchors that two blocks, or two texts of one block, have."""
    keys, flags = [], []
    for x in lists:
        n = int(np.frombuffer(x, "<u8", 1)[0])
        keys.append(B.from40(x[8 : 8 + 5 * n]))
        flags.append(np.unpackbits(np.frombuffer(x, np.uint8, offset=8 + 5 * n), count=n).astype(bool))
    every, own = np.concatenate(keys), np.concatenate(flags)
    order, starts = _groups(every)
    runs = np.diff(np.concatenate([starts, [len(every)]]))
    many = (runs > 1) | np.logical_or.reduceat(own[order], starts)
    out = np.empty(len(every), bool)
    out[order] = np.repeat(many, runs)
    return [np.packbits(x).tobytes() for x in np.split(out, np.cumsum([len(k) for k in keys])[:-1])]


def _smaller(lists: list[bytes]) -> list[bytes]:
    """For each window of each list: whether another list has it from a smaller document."""
    k0, k1, ids = [], [], []
    for x in lists:
        n = int(np.frombuffer(x, "<u8", 1)[0])
        k0.append(B.from40(x[8 : 8 + 5 * n]))
        k1.append(B.from40(x[8 + 5 * n : 8 + 10 * n]))
        docs, width = np.frombuffer(x, "<u8", 2, 8 + 10 * n).tolist()
        at = 24 + 10 * n
        table = np.frombuffer(x, "<i8", docs, at)
        ids.append(table[np.frombuffer(x, f"<u{width}", n, at + 8 * docs)])
    sizes = [len(k) for k in k0]
    a, b, i = np.concatenate(k0), np.concatenate(k1), np.concatenate(ids)
    order = np.lexsort((b, a))
    sa, sb = a[order], b[order]
    starts = np.flatnonzero(np.concatenate([[True], (sa[1:] != sa[:-1]) | (sb[1:] != sb[:-1])]))
    least = np.minimum.reduceat(i[order], starts)
    out = np.empty(len(a), bool)
    out[order] = np.repeat(least, np.diff(np.concatenate([starts, [len(a)]]))) < i[order]
    return [np.packbits(x).tobytes() for x in np.split(out, np.cumsum(sizes)[:-1])]


def substring_dedup(docs: DataFrame, width: int = 13, digest: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, and kept: the words that are left, joined by one space (digest: lowercase hex SHA-256 of that)."""
    if width < PERIOD:
        raise ValueError(f"a window has {PERIOD} words or more")
    spark, parts = docs.sparkSession, stage.buckets(docs.sparkSession)
    docs = docs.where("doc_id is not null")
    members, least = B.text_classes(docs, F.col("text"))
    held = B.stage_blocks(spark, least, "passages")

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                x = _Block(data, width)
                flags, cut = x.several(), B.split(x.distinct, parts)
                yield _rows(block, [(k, np.array([b - a], "<u8").tobytes() + B.to40(x.distinct[a:b], k, parts) + np.packbits(flags[a:b]).tobytes()) for k, (a, b) in enumerate(zip(cut, cut[1:])) if b > a])

    answered = B.exchange(held.mapInArrow(anchors, "block long, bucket int, data binary"), _shared)
    first = stage.written(spark, answered, "anchors")

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                x = _Block(row["data"], width)
                x.asked(width, _bits(row["answers"], x.distinct, parts))
                made, cut = [], B.split(x.w0, parts)
                for k, (a, b) in enumerate(zip(cut, cut[1:])):
                    if b > a:
                        ids, at = np.unique(x.least[a:b], return_inverse=True)
                        size = 1 if len(ids) <= 256 else 2 if len(ids) <= 65536 else 4
                        made.append((k, np.array([b - a], "<u8").tobytes() + B.to40(x.w0[a:b], k, parts) + (x.w1[a:b] >> np.uint64(24)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes() + np.array([len(ids), size], "<u8").tobytes() + ids.astype("<i8").tobytes() + at.astype(f"<u{size}").tobytes()))
                yield _rows(row["block"], made)

    asked = B.with_answers(held, first).mapInArrow(candidates, "block long, bucket int, data binary")
    second = B.exchange(asked, _smaller)

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                x = _Block(row["data"], width)
                x.asked(width, _bits(row["answers"], x.distinct, parts))
                w, n = x.words, len(x.h)
                edge = np.zeros(n + width + 1, np.int64)
                if len(x.wat):
                    elsewhere = _bits(row["answers1"], x.w0, parts)
                    runs = np.diff(np.concatenate([x.wstarts, [len(x.wat)]]))
                    at = x.wat[x.worder]
                    gone = at[np.repeat(elsewhere, runs) | (x.ids[w.doc[at]] > np.repeat(x.least, runs))]
                    edge[gone] += 1
                    np.add.at(edge, gone + width, -1)
                left = np.cumsum(edge)[:n] == 0
                s, size = w.start[left], w.end[left] - w.start[left] + 1
                to = np.cumsum(size)
                out = w.raw[np.arange(to[-1] if len(to) else 0) + np.repeat(s - (to - size), size)]
                out[to - 1] = 0x20
                out = out.tobytes()
                per = np.bincount(w.doc[left], minlength=len(x.ids))
                stop = np.concatenate([[0], to])[np.cumsum(per)]
                begin = np.concatenate([[0], stop[:-1]])
                texts = [out[a : b - 1] if b > a else b"" for a, b in zip(begin.tolist(), stop.tolist())]
                kept = [hashlib.sha256(t).hexdigest() for t in texts] if digest else [t.decode() for t in texts]
                yield pa.record_batch({"cls": pa.array([hashlib.md5(t).hexdigest() for t in x.texts], pa.string()), "rep": pa.array(x.ids, pa.int64()), "n_words": pa.array(w.count, pa.int64()), "n_removed": pa.array(w.count - per, pa.int64()), "kept": pa.array(kept, pa.string())})

    done = B.with_answers(held, first, second).mapInArrow(marked, "cls string, rep long, n_words long, n_removed long, kept string")
    empty = F.sha2(F.lit(""), 256) if digest else F.lit("")
    lost = (F.col("doc_id") > F.col("rep")) & (F.col("n_words") >= width)
    return B.of_members(spark, members, done).select("doc_id", "n_words", F.when(lost, F.col("n_words")).otherwise(F.col("n_removed")).alias("n_removed"), F.when(lost, empty).otherwise(F.col("kept")).alias("kept"))
