"""Packing of token sequences into as few fixed-length sequences as possible.

Tokens are counted once for each distinct text. Longer documents are cut into full pieces and a rest; full pieces fill a sequence
alone. The other pieces (only their lengths, not their tokens) are dealt into shares of many pieces. A share is packed
best-fit decreasing and then improved by swap-based local search: among underfull bins, one document moves, or is exchanged one for one,
or two for one, until no such step makes the sum of squared fills larger, which empties the emptier bins. A share's loss is
about one bin of its thousands; shares depend on doc_id only, so a lost task is repeated with the same result.

Defined results: null or empty text gives one end-of-document token. Rows without a doc_id take no part. Rows that repeat a
doc_id are packed each for itself. Other columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as B
from . import stage

#: Pieces in a share, about.
SHARE = 200_000
#: Texts tokenised at once.
TEXTS = 256
_LITTLE = struct.Struct("<I").pack


class WordTokenizer:
    """Ids of word_bpe files as bytes (little-endian unsigned 32 bit), with each distinct word encoded once.

    Equal to the library's encode(text, add_special_tokens=False): no token of these files crosses white space, so each chunk between white
    space is normalised, split into words, and each word merged once by the library's model. Texts of Latin-1 letters are lower-cased before
    they are cut, so a word's spellings share an entry. Texts that contain one of the file's special tokens go to the library whole.
    """

    #: Bytes of chunks and words kept in memory, about, and what an entry takes beside its text and ids.
    HELD, ENTRY = 128 << 20, 200
    #: Marks that often end a chunk; a run of them is one word.
    MARKS = ".,;:!?$#&*%"

    def __init__(self, path: str):
        import json

        import regex
        from tokenizers import Tokenizer, pre_tokenizers

        self.inner = Tokenizer.from_file(path)
        self.merge = self.inner.model.tokenize
        file = json.load(open(path, encoding="utf-8"))
        self.special = [x["content"] for x in file.get("added_tokens", [])]
        self.words = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
        self.odd = regex.compile("[\x1c-\x1f]")  # white space to Python only
        # the model knows each byte by a printable stand-in, printable ASCII by itself
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        other = [b for b in range(256) if b not in plain]
        self.stand_in = {b: 256 + k for k, b in enumerate(other)}
        self.known: dict[str, bytes] = {}
        self.held = 0

    @classmethod
    def shared(cls, path: str) -> WordTokenizer:
        """One for each Python worker: what one task has learned serves the next."""
        return stage.sole((cls, path), lambda: cls(path))

    def whole(self, text: str) -> bytes:
        return np.array(self.inner.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _word(self, word: str) -> bytes:
        """The ids of one normalised word."""
        ids = self.known.get(word)
        if ids is None:
            found = self.merge(word.encode().decode("latin-1").translate(self.stand_in))
            ids = self._keep(word, b"".join([_LITTLE(x.id) for x in found]))
        return ids

    def _keep(self, text: str, ids: bytes) -> bytes:
        self.held += len(text) + len(ids) + self.ENTRY
        self.known[text] = ids
        return ids

    def _chunk(self, chunk: str, simple: bool) -> bytes:
        """The ids of a chunk (text between white space) not met before; simple: of lower-case Latin-1."""
        if simple:
            core = chunk.rstrip(self.MARKS)
            if core.isalpha():
                return self._word(core) if core == chunk else self._kept(chunk, [core, chunk[len(core) :]])
            return self._kept(chunk, self.words.findall(chunk))
        import unicodedata

        low = unicodedata.normalize("NFC", chunk).replace("Σ", "σ").lower()  # the library lower-cases letter by letter
        return self._kept(chunk, self.words.findall(low))

    def _kept(self, chunk: str, words: list[str]) -> bytes:
        return self._keep(chunk, b"".join([self._word(w) for w in words]))

    def _text(self, text: str) -> bytes:
        try:
            text.encode("latin-1")
            low, simple = text.lower(), True
        except UnicodeEncodeError:
            low, simple = text, False
        if any(x in text or x in low for x in self.special) or self.odd.search(text):
            return self.whole(text)
        chunks = low.split()
        parts = list(map(self.known.get, chunks))
        if None in parts:
            parts = [self.known.get(c) or self._chunk(c, simple) if p is None else p for p, c in zip(parts, chunks)]
        return b"".join(parts)

    def encode(self, texts: list[str]) -> list[bytes]:
        out = []
        for text in texts:
            if self.held > self.HELD:
                self.known.clear()
                self.held = 0
            out.append(self._text(text))
        return out


def pieces_of(ids: bytes, size: int) -> list[tuple[int, int, int]]:
    """(start, length, crc32) of each piece of a document's ids; the end id 0 is appended."""
    ids += b"\0\0\0\0"
    n = len(ids) // 4
    return [(k, min(size, n - k), zlib.crc32(ids[4 * k : 4 * (k + size)])) for k in range(0, n, size)]


def best_fit(lengths: list[int], size: int) -> list[list[int]]:
    """Best-fit decreasing: items by bin."""
    bins: list[list[int]] = []
    room: list[list[int]] = [[] for _ in range(size + 1)]
    open_rooms: list[int] = []
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        n = lengths[i]
        k = bisect_left(open_rooms, n)
        if k == len(open_rooms):
            bins.append([])
            b, free = len(bins) - 1, size
        else:
            free = open_rooms[k]
            b = room[free].pop()
            if not room[free]:
                open_rooms.pop(k)
        bins[b].append(i)
        free -= n
        if free > 0:
            if not room[free]:
                insort(open_rooms, free)
            room[free].append(b)
    return bins


def local_search(bins: list[list[int]], lengths: list[int], size: int) -> list[list[int]]:
    """Moves and exchanges between underfull bins until none increases the sum of squared fills; empty bins go.

    A step gives up to two documents of a bin and takes up to one of another; net length may go either way. Each bin takes the best step
    among all partners. A full bin is in no step, as nothing can be fuller.
    """
    bins = [list(b) for b in bins]
    fill = [sum(lengths[i] for i in b) for b in bins]
    at: dict[tuple[int, int], dict[int, None]] = {}  # bins by fill and length of one of their documents; length 0: take nothing
    rest: list[int] = [0] * (size + 1)  # lengths (as bits) by what a bin has without that document
    fills: list[int] = [0] * (size + 1)  # fills (as bits) by length
    low_t, low_f = np.full(size + 1, 1 << 30), np.full(size + 1, 1 << 30)  # the lowest bits

    def low(bits: int) -> int:
        return (bits & -bits).bit_length() - 1 if bits else 1 << 30

    def index(k: int, put: bool) -> None:
        f = fill[k]
        if not 0 < f < size:
            return
        for t in {0, *(lengths[i] for i in bins[k])}:
            held = at.setdefault((f, t), {})
            if put:
                held[k] = None
            else:
                del held[k]
            if len(held) == put:
                rest[f - t] ^= 1 << t
                fills[t] ^= 1 << f
                low_t[f - t] = low(rest[f - t])
                if t:
                    low_f[t] = low(fills[t])

    def step(k: int) -> bool:
        f = fill[k]
        own = np.array([lengths[i] for i in bins[k]])
        values, times = np.unique(own, return_counts=True)
        pairs = values[:, None] + values[None, :]
        s = np.unique(np.concatenate([[0], values, pairs[np.triu(np.ones(pairs.shape, bool), 1)], 2 * values[times > 1]]))[:, None]
        v = np.arange(f + 1, size + 1)[None, :]  # the fuller bin's new fill
        up = (s - low_t[v - s]) * (v - f)  # the partner becomes the fuller one
        down = (v - low_f[v - f + s]) * (v - f)  # this bin does
        best_up, best_down = int(up.argmax()), int(down.argmax())
        gain = max(up.flat[best_up], down.flat[best_down])
        if gain <= 0:
            return False
        x, y = divmod(best_up if up.flat[best_up] == gain else best_down, v.shape[1])
        given, new = int(s[x, 0]), int(v[0, y])
        if up.flat[best_up] == gain:
            take = int(low_t[new - given])
            partner = next(iter(at[new - given + take, take]))
        else:
            take = new - f + given
            partner = next(iter(at[int(low_f[take]), take]))
        where: dict[int, int] = {}
        give: list[int] = []
        for i in bins[k] if given else []:
            if lengths[i] == given:
                give = [i]
                break
            if given - lengths[i] in where and not give:
                give = [where[given - lengths[i]], i]
            where.setdefault(lengths[i], i)
        back = next(([i] for i in bins[partner] if take and lengths[i] == take), [])
        index(partner, False)
        bins[k] = [i for i in bins[k] if i not in give] + back
        bins[partner] = [i for i in bins[partner] if i not in back] + give
        fill[k] += take - given
        fill[partner] += given - take
        index(partner, True)
        return True

    for k in range(len(bins)):
        index(k, True)
    changed = True
    while changed:
        changed = False
        for k in sorted((k for k in range(len(bins)) if 0 < fill[k] < size), key=lambda k: (fill[k], k)):
            if 0 < fill[k] < size:
                index(k, False)
                while 0 < fill[k] < size and step(k):
                    changed = True
                index(k, True)
    return [b for b in bins if b]


def pack_documents(docs: DataFrame, tokenizer: Callable[[], WordTokenizer], size: int = 2048) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece; tokenizer() makes one whose encode() turns texts into ids as bytes."""
    spark = docs.sparkSession
    stage.ship(spark)
    docs = docs.where("doc_id is not null")
    members, least = B.text_classes(docs, F.col("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        inner = tokenizer()
        for b in (x.slice(k, TEXTS) for x in batches for k in range(0, x.num_rows, TEXTS)):
            texts = b.column(1).to_pylist()
            cls = [hashlib.md5(x.encode()).hexdigest() for x in texts]
            made = [[{"start": s, "length": n, "crc": c} for s, n, c in pieces_of(ids, size)] for ids in inner.encode(texts)]
            kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("crc", pa.int64())]))
            yield pa.record_batch({"cls": pa.array(cls, pa.string()), "pieces": pa.array(made, kind)})

    counted = least.mapInArrow(count, "cls string, pieces array<struct<start: long, length: long, crc: long>>")
    each = B.of_members(spark, members, counted).select("doc_id", F.posexplode("pieces").alias("piece", "p")).select("doc_id", "piece", "p.start", "p.length", F.col("p.crc").alias("ids_crc32"))
    each = stage.written(spark, each, "pieces")
    full = each.where(F.col("length") == size).select("*", F.xxhash64("doc_id", "start", F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    part = each.where(F.col("length") < size)
    shares = max(1, -(-part.count() // SHARE))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "piece", "ids_crc32"]).reset_index(drop=True)
        lengths = pdf["length"].tolist()
        bins = local_search(best_fit(lengths, size), lengths, size)
        seq, off = np.zeros(len(pdf), np.int64), np.zeros(len(pdf), np.int64)
        for k, items in enumerate(bins):
            at = 0
            for i in items:
                seq[i], off[i] = k, at
                at += lengths[i]
        share = int(pdf["share"].iloc[0])
        return pdf.drop(columns="share").assign(sequence_id=(share << 32) + seq, offset=off)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    packed = part.withColumn("share", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(shares))).groupBy("share").applyInPandas(pack, schema)
    # full pieces get numbers of their own, below zero
    full = full.withColumn("sequence_id", -1 - F.monotonically_increasing_id())
    return packed.unionByName(full)
