"""Language identification by prediction by partial matching (PPM) with frozen statistics.

Bytes are folded (A-Z; white space and controls are one symbol), and each language has a tree of contexts of 0 to ORDER bytes, kept as sorted
tables of what occurred, so its size follows the training sample and not the alphabet. The code length of a byte after a context
follows PPM method C: seen there, count / (total + kinds); else an escape of kinds / (total + kinds) and the next shorter context, at the end
a uniform choice of SYMBOLS. Statistics do not change while scoring, so each (context, byte) has one exact code length per language and a text's
code length is their sum; they are looked up once for each distinct one of a batch. The language with the shortest code wins.

The training sample is bounded (documented parameter; everything else runs on every byte of every text): the different texts of a language in the
order of a hash of the text, as many as fit into SAMPLE_BYTES, whatever the partitions. Texts longer than a sixteenth of it are passed over, so
the sample is nearly full; a language that has only such texts gives the beginning of its first one. Trees are counted on executors; what
the driver gathers are counts per language and (ORDER + 1)-gram of the sample, at most SAMPLE_BYTES for each language.

Defined results: null text, or text without a letter, gives ``und`` and score 0. A long text is scored in pieces that overlap by the
context. With no training row every text gives ``und``. Rows without a doc_id are kept as they are. Of the columns that are kept, those named as
one of the result's (in any case of letters) are replaced by it; other columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import stage
from .words import FOLD

ORDER = 4
SAMPLE_BYTES = 1 << 20
#: Bytes and texts scored at once.
PIECE, TEXTS = 1 << 19, 512
#: Columns of the result.
OUT = ("lang_pred", "score", "bits_per_byte")
#: Byte to symbol.
SYMBOL = FOLD.copy()
SYMBOL[:33] = 32
SYMBOLS = len(np.unique(SYMBOL))


def grams(data: np.ndarray) -> np.ndarray:
    """The (ORDER + 1)-gram that ends at each byte, its last byte lowest; before the start stands white space."""
    s = np.concatenate([np.full(ORDER, 32, np.uint8), SYMBOL[data]]).astype(np.uint64)
    n = len(data)
    out = np.zeros(n, np.uint64)
    for k in range(ORDER + 1):
        out = (out << np.uint64(8)) | s[k : k + n]
    return out


def _find(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each key in a sorted table, and whether it is there."""
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return at, table[at] == keys


class Tree:
    """The contexts of one language: by order, what followed with its code length, and the contexts with the code length of their escape."""

    def __init__(self, gram: np.ndarray, count: np.ndarray):
        self.orders = []
        for k in range(ORDER + 1):
            key, at = np.unique(gram & np.uint64((1 << 8 * (k + 1)) - 1), return_inverse=True)
            c = np.bincount(at, count, len(key))
            context, first, kinds = np.unique(key >> np.uint64(8), return_index=True, return_counts=True)
            total = np.add.reduceat(c, first)
            self.orders.append((key, -np.log2(c / np.repeat(total + kinds, kinds)), context, -np.log2(kinds / (total + kinds))))

    def bits(self, chain: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Code length of the last byte of each gram of the chain's last link after the bytes before it."""
        cost = np.array([np.log2(SYMBOLS)])
        for (gram, shorter), (key, seen, context, escape) in zip(chain, self.orders):
            cost = cost[shorter]
            at, hit = _find(key, gram)
            miss = np.flatnonzero(~hit)
            place, known = _find(context, gram[miss] >> np.uint64(8))
            cost[miss[known]] += escape[place[known]]
            cost[hit] = seen[at[hit]]
        return cost


def suffixes(gram: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """By order, from 0: the distinct ends of sorted distinct grams, and the place of each one's own end among those of the order below."""
    chain = []
    for k in range(ORDER, 0, -1):
        ends, place = np.unique(gram & np.uint64((1 << 8 * k) - 1), return_inverse=True)
        chain.append((gram, place))
        gram = ends
    return [(gram, np.zeros(len(gram), np.int64)), *reversed(chain)]


class Model:
    """Frozen statistics: languages and each one's counted grams. Trees are built once in each Python worker."""

    def __init__(self, key: str, langs: list[str], counted: list[tuple[np.ndarray, np.ndarray]]):
        self.key, self.langs, self.counted = key, langs, counted

    def trees(self) -> list[Tree]:
        return stage.sole((Model, self.key), lambda: [Tree(g, c) for g, c in self.counted])

    def bits(self, texts: list[bytes]) -> np.ndarray:
        """Code length of each text in bits, by language."""
        out = np.zeros((len(texts), len(self.langs)))
        gap = b" " * ORDER  # contexts do not cross texts
        at = 0
        while at < len(texts):
            part, size = [], 0
            while at + len(part) < len(texts) and (not part or size + len(texts[at + len(part)]) <= PIECE):
                size += len(texts[at + len(part)]) + ORDER
                part.append(texts[at + len(part)])
            if len(part) == 1:
                data = np.frombuffer(part[0], np.uint8)
                for k in range(0, len(data), PIECE):
                    lead = min(k, ORDER)
                    g = grams(data[k - lead : k + PIECE])[lead:]
                    out[at] += self._sums(g, np.array([0]), np.array([len(g)]))[0]
            else:
                stop = np.cumsum([len(t) + ORDER for t in part])
                g = grams(np.frombuffer(gap.join(part) + gap, np.uint8))
                out[at : at + len(part)] = self._sums(g, np.concatenate([[0], stop[:-1]]), stop - ORDER)
            at += len(part)
        return out

    def _sums(self, gram: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        distinct, where = np.unique(gram, return_inverse=True)
        out = np.empty((len(begin), len(self.langs)))
        chain = suffixes(distinct)
        for k, tree in enumerate(self.trees()):
            sums = np.concatenate([[0.0], np.cumsum(tree.bits(chain)[where])])
            out[:, k] = sums[end] - sums[begin]
        return out


def _by_lang(values: dict[str, int]) -> Column:
    """A number for each language, null for others."""
    return F.create_map(*(F.lit(x) for kv in values.items() for x in kv))[F.col("lang")].cast("long") if values else F.lit(None).cast("long")


def _sample(rows: DataFrame, bound: int) -> DataFrame:
    """lang, text of the training sample, each different text once."""
    spark = rows.sparkSession
    keyed = rows.select("lang", F.xxhash64("text").alias("h"), F.octet_length("text").cast("long").alias("n"), "text")
    lens = stage.written(spark, keyed.groupBy("lang", "h").agg(F.max("n").alias("n")), "lengths")
    fits = F.col("n") <= bound // 16
    # the last hash that is taken: sums by ranges of hashes, then by finer ranges of the one in which the bound is reached
    limits: dict[str, int] = {r["lang"]: 1 << 63 for r in lens.where(fits).select("lang").distinct().collect()}
    part, taken = lens.where(fits), dict.fromkeys(limits, 0)
    for shift in (52, 40, 28, 16, 4, 0) if limits else ():
        cells = part.groupBy("lang", F.shiftright("h", shift).alias("cell")).agg(F.sum("n").alias("n"), F.count("*").alias("texts"), F.min("h").alias("first"))
        run = cells.withColumn("upto", _by_lang(taken) + F.sum("n").over(Window.partitionBy("lang").orderBy("cell")))
        over = run.groupBy("lang").agg(F.max(F.when(F.col("upto") <= bound, F.col("upto"))).alias("upto"), F.min(F.when(F.col("upto") > bound, F.struct("cell", "texts", "first"))).alias("next"))
        found = {r["lang"]: r for r in over.where("next is not null").collect()}
        limits |= {k: r["next"]["first"] for k, r in found.items()}
        taken = {k: r["upto"] or taken[k] for k, r in found.items() if r["next"]["texts"] > 1}
        if not taken:
            break
        part = part.where(F.shiftright("h", shift) == _by_lang({k: found[k]["next"]["cell"] for k in taken}))
    rest = lens.groupBy("lang").agg(F.min("h").alias("h"), F.min("n").alias("n")).where(~fits).collect()
    below, only = {k: v for k, v in limits.items() if v < 1 << 63}, {r["lang"]: r["h"] for r in rest}
    chosen = F.col("lang").isin([*limits]) & fits & F.coalesce(F.col("h") < _by_lang(below), F.lit(True))
    taken = keyed.where(chosen | F.coalesce(F.col("h") == _by_lang(only), F.lit(False)))
    return taken.groupBy("lang", "h").agg(F.first("text").alias("text")).select("lang", "text")


def fit(docs: DataFrame, sample_bytes: int = SAMPLE_BYTES) -> Model:
    """A model of the languages in lang from (text, lang), on at most sample_bytes of each."""
    spark = docs.sparkSession
    stage.ship(spark)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stage.drop()
        held: dict[str, list[bytes]] = {}
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                held.setdefault(lang, []).append(text.encode()[:sample_bytes])
        for lang, parts in held.items():
            u, c = np.unique(np.concatenate([grams(np.frombuffer(x, np.uint8)) for x in parts]), return_counts=True)
            yield pa.record_batch({"lang": pa.array([lang] * len(u), pa.string()), "g": pa.array(u.astype(np.int64), pa.int64()), "c": pa.array(c, pa.int64())})

    sample = _sample(docs.where("lang is not null and text is not null").select("lang", "text"), sample_bytes)
    total = sample.mapInArrow(count, "lang string, g long, c long").groupBy("lang", "g").agg(F.sum("c").alias("c"))
    found = total.orderBy("lang", "g").toPandas()
    found = found[found["c"] > 0]
    langs = sorted(found["lang"].unique())
    each = [found[found["lang"] == lang] for lang in langs]
    return Model(uuid.uuid4().hex, langs, [(x["g"].to_numpy().astype(np.uint64), x["c"].to_numpy()) for x in each])


def predict(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """The columns keep of docs with lang_pred, score (0 to 1: how sure the winner is against the runner-up) and bits_per_byte (of the winner)."""
    spark = docs.sparkSession
    stage.ship(spark)
    keep = [c for c in keep if c.lower() not in OUT]
    shared = spark.sparkContext.broadcast(model)  # bounded by the sample
    has = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    # a kept text goes to Python once, beside a flag
    own = keep.index("text") if "text" in keep else None
    rows = docs.select(*keep, has.alias("_has") if own is not None else F.when(has, F.col("text")).alias("_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in (x.slice(k, TEXTS) for x in batches for k in range(0, x.num_rows, TEXTS)):
            last = b.column(b.num_columns - 1)
            text = last if own is None else b.column(own)
            lettered = (last.is_valid() if own is None else last).to_pylist()
            at = [i for i in range(b.num_rows) if lettered[i]] if m.langs else []
            lang, score, rate = ["und"] * b.num_rows, [0.0] * b.num_rows, [None] * b.num_rows
            if at:
                raw = [text[i].as_buffer().to_pybytes() for i in at]
                bits = m.bits(raw)
                order = np.argsort(bits, axis=1, kind="stable")
                best = bits[np.arange(len(at)), order[:, 0]]
                gap = np.minimum(bits[np.arange(len(at)), order[:, 1]] - best, 1000) if len(m.langs) > 1 else np.full(len(at), 1000.0)
                sure = 1 / (1 + np.exp2(-gap))
                for i, k, s, x, t in zip(at, order[:, 0].tolist(), sure.tolist(), best.tolist(), raw):
                    lang[i], score[i], rate[i] = m.langs[k], s, x / len(t)
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(b.num_columns - 1)), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rate, pa.float64())], names=[*b.schema.names[:-1], "lang_pred", "score", "bits_per_byte"])

    return rows.mapInArrow(run, f"{schema}, lang_pred string, score double, bits_per_byte double")


def fold_of(doc_id: Column) -> Column:
    """crc32(doc_id as text) mod 4; 2 is held out."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4
