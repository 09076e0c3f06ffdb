"""Blocks of texts and exchanges of hash lists between them.

A *block* is one row that holds many texts (compressed). To learn something about each hash of a block from the
whole corpus (in how many documents does it occur? which is the smallest document that has it?) a block sends
its sorted distinct hashes, cut by hash into buckets, as one binary value for each bucket; a bucket merges the
lists of all blocks and answers each block with one value per hash, in the order asked. The block is read again
and recomputes its list, so that answers need no keys. A hash crosses the network at most once per block,
however often it occurs there: a key that a third of all documents hold costs one entry per block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import stage
from .skew import spread_join

#: Bytes of text in a block, about; a longer text is a block of its own. A block sends a row to each bucket: where there are many buckets, blocks are larger, up to MOST_BYTES.
BLOCK_BYTES, BUCKET_BYTES, MOST_BYTES = 2 << 20, 4 << 10, 32 << 20
#: Texts in a block at most.
BLOCK_TEXTS = 1 << 20


def pack(ids: list[int], texts: list[bytes]) -> bytes:
    head = np.array([len(ids), *ids, *map(len, texts)], np.int64).tobytes()
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(texts))


def unpack(data: bytes) -> tuple[np.ndarray, list[bytes]]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    ids, lens = np.frombuffer(raw, np.int64, 2 * n, 8).reshape(2, n)
    at = 8 * (1 + 2 * n)
    stops = at + np.cumsum(lens)
    return ids, [raw[b - k : b] for b, k in zip(stops.tolist(), lens.tolist())]


def text_classes(docs: DataFrame, text: Column) -> tuple[DataFrame, DataFrame]:
    """Collapse equal texts: (doc_id, cls) of every document, and (rep, text) with the smallest doc_id of each class; cls is the text's MD5.

    The aggregate runs before the shuffle too, so a text of which there are very many copies leaves each task once.
    """
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(text, F.lit("")).alias("text")).withColumn("cls", F.md5("text"))
    least = keyed.groupBy("cls").agg(F.min(F.struct("doc_id", "text")).alias("m"))
    return keyed.select("doc_id", "cls"), least.select(F.col("m.doc_id").alias("rep"), F.col("m.text").alias("text"))


def of_members(spark: SparkSession, members: DataFrame, classes: DataFrame) -> DataFrame:
    """members (doc_id, cls) with what classes (cls and any columns, a row each) say; a text that very many documents hold moves none of them."""
    members = stage.written(spark, members, "members")
    copies = members.groupBy("cls").agg(F.count("*").alias("copies"))
    return spread_join(members, stage.written(spark, classes.join(copies, "cls"), "classes"), "cls", "copies").drop("copies")


def stage_blocks(spark: SparkSession, texts: DataFrame, name: str) -> DataFrame:
    """texts (id long, text string) packed into rows (block long, data binary) in the shared folder."""
    most = min(MOST_BYTES, max(BLOCK_BYTES, BUCKET_BYTES * stage.buckets(spark)))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base, made = TaskContext.get().partitionId() << 32, 0
        ids: list[int] = []
        held: list[bytes] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal ids, held, size, made
            row = pa.record_batch({"block": pa.array([base + made], pa.int64()), "data": pa.array([pack(ids, held)], pa.binary())})
            ids, held, size, made = [], [], 0, made + 1
            return row

        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1)):
                t = t.as_buffer().to_pybytes() if t.is_valid else b""
                if held and (size + len(t) > most or len(held) == BLOCK_TEXTS):
                    yield flush()
                ids.append(i)
                held.append(t)
                size += len(t)
        if held:
            yield flush()

    return stage.written(spark, texts.mapInArrow(packed, "block long, data binary"), name)


def split(keys: np.ndarray, n: int) -> np.ndarray:
    """Bounds of the buckets in a sorted array of 64-bit keys: bucket k holds keys[bounds[k]:bounds[k+1]]."""
    step = (1 << 64) // n
    return np.searchsorted(keys, np.array([0, *(min(2**64 - 1, step * k) for k in range(1, n))], np.uint64)).tolist() + [len(keys)]


def to40(keys: np.ndarray, bucket: int, n: int) -> bytes:
    """The leading 40 bits below the bucket's part of each key; a rare clash merges two keys for every block alike."""
    off = keys - np.uint64((1 << 64) // n * bucket)
    shift = max(0, ((1 << 64) // n).bit_length() - 40)
    return (off >> np.uint64(shift)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes()


def from40(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(data, np.uint8).reshape(-1, 5)
    return out.view("<u8").ravel()


def exchange(asked: DataFrame, answer: Callable[[list[bytes]], list[bytes]]) -> DataFrame:
    """asked (block, bucket, data) to answered (block, answers array<struct<bucket, data>>); answer() sees a whole bucket."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("block")
        return pd.DataFrame({"block": pdf["block"].to_numpy(), "bucket": pdf["bucket"].to_numpy(), "data": answer(pdf["data"].tolist())})

    out = asked.groupBy("bucket").applyInPandas(one, "block long, bucket int, data binary")
    return out.groupBy("block").agg(F.collect_list(F.struct("bucket", "data")).alias("answers"))


def with_answers(blocks: DataFrame, *answered: DataFrame) -> DataFrame:
    """blocks with the columns answers, answers1, ...; every block asked, so inner joins lose none that has keys, and left joins none at all."""
    for k, a in enumerate(answered):
        blocks = blocks.join(a.withColumnRenamed("answers", f"answers{k or ''}"), "block", "left")
    return blocks


def in_order(answers: object) -> list[bytes]:
    """The answers' values by bucket."""
    return [x["data"] for x in sorted(answers, key=lambda x: x["bucket"])] if answers is not None else []
