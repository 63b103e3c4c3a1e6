"""Vector bin packing of token pieces under limits on tokens, segments and loss-bearing tokens.

A text's ids are cut at multiples of the sequence length; whole pieces fill a sequence of their own, and the
remainders are packed. Remainders are dealt by hash to buckets of about BUCKET rows, so no task holds more;
in a bucket a sequence takes, time and again, the fitting kind of piece with the largest dot product of its
demands and the room left (Panigrahy, Talwar, Uyeda, Wieder 2011). Pieces of equal demands are one kind.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewlake.llm.common import small_batches, stage, utf8
from reviewlake.llm.wordbpe import word_bpe

TOKENS, SEGMENTS = 4096, 64
BUCKET = 5000


def pack_vectors(demands: np.ndarray, limits: tuple[int, ...]) -> np.ndarray:
    """The bin of each row of demands. A row beyond a limit gets a bin of its own."""
    bins = np.full(len(demands), -1, np.int64)
    limit = np.array(limits, float)
    kinds, kind_of = np.unique(demands, axis=0, return_inverse=True)
    order = np.argsort(kind_of.ravel(), kind="stable")
    left = np.bincount(kind_of.ravel(), minlength=len(kinds))
    at = np.concatenate(([0], np.cumsum(left)[:-1]))
    share = kinds / limit
    weight = 1 / np.maximum((share * left[:, None]).sum(0) / max(1, left.sum()), 1e-9)  # a scarce dimension weighs as its mean demand asks
    weight = weight.min() / weight
    made = 0
    live = np.arange(len(kinds))
    while len(live):
        room = np.ones(len(limits))
        start = True
        while True:
            fits = live[(share[live] <= room + 1e-12).all(1)] if not start else live
            if not len(fits):
                break
            k = fits[np.argmax(share[fits] @ (weight * room))]
            start = False
            bins[order[at[k]]] = made
            at[k] += 1
            left[k] -= 1
            room = room - share[k]
            if not left[k]:
                live = live[live != k]
            if (room < 0).any() or not len(live):
                break
        made += 1
    return bins


def pack(pieces: DataFrame, tokens_col: str, loss_col: str, limits: tuple[int, int, int] = (TOKENS, SEGMENTS, TOKENS), keys: tuple[str, ...] = ()) -> DataFrame:
    """Add sequence_id and offset. keys: columns that identify a row, by which rows are dealt and ordered.

    Segments count 1 a row. Ties keep the order of keys; null demands count as 0; rows equal in all keys fall into one bucket; other
    columns may have any name but those two; an empty table gives none.
    """
    bucket = next(x for x in ("_bucket" + "_" * k for k in range(len(pieces.columns) + 1)) if x not in pieces.columns)
    n = pieces.count()
    buckets = max(1, math.ceil(n / BUCKET))
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in pieces.schema)}, sequence_id long, offset long"

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(list(keys), kind="stable", ignore_index=True) if keys else rows
        size = rows[tokens_col].fillna(0).to_numpy(np.int64)
        demands = np.stack([size, np.ones(len(rows), np.int64), rows[loss_col].fillna(0).to_numpy(np.int64)], 1)
        bins = pack_vectors(demands, limits)
        order = np.argsort(bins, kind="stable")
        before = np.cumsum(size[order]) - size[order]
        first = np.r_[True, bins[order][1:] != bins[order][:-1]]
        out = rows.iloc[order].drop(columns=bucket)
        out["sequence_id"] = (int(key[0]) << 32) + bins[order]
        out["offset"] = before - np.maximum.accumulate(np.where(first, before, 0))
        return out

    dealt = pieces.withColumn(bucket, F.pmod(F.xxhash64(*(keys or pieces.columns)), F.lit(buckets)))
    return dealt.groupBy(bucket).applyInPandas(run, schema)


def pieces_of(docs: DataFrame, tokenizer: str, end: int, length: int = TOKENS) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens of every piece; null text has the end id alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = word_bpe(tokenizer)
        for b in batches:
            out: list[tuple] = []
            for i, ids in zip(b.column(0).to_pylist(), bpe.ids(b.column(1).to_pylist()), strict=True):
                ids = np.append(ids, np.uint32(end)).astype("<u4")
                out += [(i, s, min(length, len(ids) - s), zlib.crc32(ids[s : s + length].tobytes()), len(ids)) for s in range(0, len(ids), length)]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)] if out else [pa.array([], pa.int64())] * 5, ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8("text").alias("t"))
    return rows.mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


def pack_documents(docs: DataFrame, tokenizer: str, end: int = 2, limits: tuple[int, int, int] = (TOKENS, SEGMENTS, TOKENS)) -> DataFrame:
    """Tokenize whole texts, add the end id, cut and pack. A piece's first id bears no loss: nothing predicts it.

    Null and empty texts are their end id alone; null ids and repeated rows are packed like others; other columns of docs, whatever
    their names, don't matter; an empty table gives no rows.
    """
    with small_batches(docs.sparkSession):
        pieces = stage(pieces_of(docs, tokenizer, end, limits[0]).withColumn("row", F.monotonically_increasing_id()), "pieces")
    packed = pack(pieces.withColumn("loss", F.col("length") - 1), "length", "loss", limits, ("doc_id", "start", "ids_crc32", "row"))
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
