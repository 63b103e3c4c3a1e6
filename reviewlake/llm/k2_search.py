"""Ranked lexical search by K2-treaps over the grid of terms and documents.

Documents are cut into blocks; a block's grid has a row for each term and a column for each document, with the impact of the term in the
document, without the term's weight, in the cell. Its K2-treap is a quadtree whose node holds the largest impact of its square and where that
is, less what nodes above hold: so each impact is in one node, and children are found by counting bits. Levels are stored as bits of
children, falls of the maximum, and places, and blocks are the rows of a table, which is the index.

An item descends on all rows of its terms at once: for a range of documents it stands in one node for each term, and the sum of weighted maxima,
with what nodes above have already given to documents of the range, bounds the scores in it. Ranges are halved best first, until no bound reaches
the k-th best score known. (Brisaboa, de Bernardo, Konow, Navarro: K2-Treaps, 2014.)
"""

from __future__ import annotations

import heapq
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewlake.llm.common import FEW, stage, utf8

#: Documents, and bytes of text, of a block; items' terms that go with one pass over the index; bytes of a text that are cut at once.
DOCS, BYTES, TERMS, AT_ONCE = 16_384, 64_000_000, 50_000, 1_000_000
#: Ranges that are halved at once, at least.
RANGES = 64

_TERM, _OTHER = re.compile(rb"[0-9A-Za-z\x80-\xff]+"), re.compile(rb"[^0-9A-Za-z\x80-\xff]")
_IN_TERM = np.zeros(256, bool)
_IN_TERM[[*b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", *range(0x80, 0x100)]] = True
_SET = np.array([bin(k).count("1") for k in range(16)])

INDEX = "height int, doc_ids array<bigint>, terms binary, df array<int>, sizes array<int>, children binary, falls binary, places binary"
FOUND = "item long, doc_id long, score long"


def terms_of(raw: bytes) -> Iterator[list[bytes]]:
    """The lower-cased terms of UTF-8 bytes, a part of a long text at a time."""
    at = 0
    while at < len(raw):
        end = len(raw)
        if end - at > AT_ONCE and (cut := _OTHER.search(raw, at + AT_ONCE)):
            end = cut.start()
        yield _TERM.findall(raw[at:end].lower())
        at = end


def corpus_size(docs: DataFrame, text_col: str = "text") -> tuple[int, int]:
    """N, the documents with a term, and L, all terms with repeats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = total = 0
        for b in batches:
            for raw in b.column(0):
                inside = _IN_TERM[np.frombuffer(raw.as_buffer(), np.uint8)]
                count = int(np.count_nonzero(inside[1:] & ~inside[:-1])) + int(len(inside) > 0 and inside[0])
                n, total = n + (count > 0), total + count
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([total])], ["n", "total"])

    sums = docs.select(utf8(text_col).alias("raw")).mapInArrow(run, "n long, total long").agg(F.sum("n"), F.sum("total")).first()
    return sums[0] or 0, sums[1] or 0


def _spread(x: np.ndarray) -> np.ndarray:
    """Bits of x at the even places."""
    x = x.astype(np.uint64)
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        x = (x | x << np.uint64(shift)) & np.uint64(mask)
    return x


def _gather(x: np.ndarray) -> np.ndarray:
    x = x & np.uint64(0x5555555555555555)
    for shift, mask in ((1, 0x3333333333333333), (2, 0x0F0F0F0F0F0F0F0F), (4, 0x00FF00FF00FF00FF), (8, 0x0000FFFF0000FFFF), (16, 0x00000000FFFFFFFF)):
        x = (x | x >> np.uint64(shift)) & np.uint64(mask)
    return x.astype(np.int64)


def _place_type(bits: int) -> type:
    return np.uint8 if bits <= 8 else np.uint16 if bits <= 16 else np.uint32 if bits <= 32 else np.uint64


def treap(rows: np.ndarray, cols: np.ndarray, impacts: np.ndarray, height: int) -> dict:
    """The levels of a K2-treap of cells that differ, from the root down. A level's nodes are in the order of their squares."""
    z = _spread(rows) << np.uint64(1) | _spread(cols)
    order = np.argsort(z)
    z, impacts = z[order], impacts[order].astype(np.int64)
    sizes, children, falls, places = [], [], [], []
    above_square, above_top = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    level = 0
    while len(z):
        bits = 2 * (height - level)
        square = z >> np.uint64(bits)
        new = np.flatnonzero(np.r_[True, square[1:] != square[:-1]])
        group = np.cumsum(np.r_[False, square[1:] != square[:-1]])
        top = np.maximum.reduceat(impacts, new)
        best = np.flatnonzero(impacts == top[group])
        best = best[np.r_[True, group[best][1:] != group[best][:-1]]]  # of equal ones the first
        square = square[new]
        sizes.append(len(new))
        places.append((z[best] & np.uint64((1 << bits) - 1)).astype(_place_type(bits)).tobytes())
        if level:
            parent = np.searchsorted(above_square, square >> np.uint64(2))
            bitmap = np.zeros(len(above_square), np.uint8)
            np.bitwise_or.at(bitmap, parent, np.uint8(1) << (square & np.uint64(3)).astype(np.uint8))
            children.append(bitmap)
            falls.append((above_top[parent] - top).astype(np.uint32).tobytes())
        else:
            falls.append(top.astype(np.uint32).tobytes())
        left = np.ones(len(z), bool)
        left[best] = False
        z, impacts = z[left], impacts[left]
        above_square, above_top = square, top
        level += 1
    children.append(np.zeros(len(above_square), np.uint8))
    nibbles = np.concatenate(children)
    nibbles = np.r_[nibbles, np.zeros(len(nibbles) % 2, np.uint8)]
    return {"height": height, "sizes": sizes, "children": (nibbles[::2] | nibbles[1::2] << 4).tobytes(), "falls": b"".join(falls), "places": b"".join(places)}


class Treap:
    """A stored K2-treap: of every node its impact, row and column, bits of children and the number of its first child."""

    def __init__(self, block: dict) -> None:
        self.height, sizes = block["height"], block["sizes"]
        total = sum(sizes)
        packed = np.frombuffer(block["children"], np.uint8)
        self.bits = np.stack([packed & 15, packed >> 4], 1).ravel()[:total].astype(np.int64)
        count = _SET[self.bits]
        self.first = 1 + np.cumsum(count) - count
        self.impact, z = np.frombuffer(block["falls"], np.uint32).astype(np.int64), np.zeros(total, np.uint64)
        square, at, byte = np.zeros(1, np.uint64), 0, 0
        for level, n in enumerate(sizes):
            depth = 2 * (self.height - level)
            kind = _place_type(depth)
            place = np.frombuffer(block["places"], kind, n, byte).astype(np.uint64)
            byte += place.size * np.dtype(kind).itemsize
            z[at : at + n] = square << np.uint64(depth) | place
            if level + 1 < len(sizes):
                own = np.repeat(np.arange(at, at + n), count[at : at + n])
                has = (self.bits[at : at + n, None] >> np.arange(4)) & 1
                square = (square[:, None] << np.uint64(2) | np.arange(4, dtype=np.uint64))[has.astype(bool)]
                self.impact[at + n : at + n + sizes[level + 1]] = self.impact[own] - self.impact[at + n : at + n + sizes[level + 1]]
            at += n
        self.row, self.col = _gather(z >> np.uint64(1)), _gather(z)

    def best(self, rows: np.ndarray, weights: np.ndarray, k: int, floor: int, columns: int) -> tuple[np.ndarray, np.ndarray]:
        """Columns and scores of all documents whose score is above 0 and no less than floor and than the k-th best."""
        known = np.zeros(columns, np.int64)  # of each document, the part of its score that visited nodes hold
        level, start = np.zeros(1, np.int64), np.zeros(1, np.int64)
        node = np.zeros((1, len(rows)), np.int64)
        bound = np.array([np.iinfo(np.int64).max])
        floor = max(floor, 1)
        while len(bound):
            keep = np.flatnonzero(bound >= floor)
            if not len(keep):
                break
            take = max(RANGES, len(keep) // 4)
            if len(keep) > take:
                keep = keep[np.argpartition(-bound[keep], take - 1)]
            now, rest = keep[:take], keep[take:]
            nodes, there = node[now], node[now] >= 0
            hit = there & (self.row[nodes] == rows)
            at, term = np.nonzero(hit)
            found = nodes[at, term]
            np.add.at(known, self.col[found], weights[term] * self.impact[found])
            if columns > k:
                floor = max(floor, int(np.partition(known, columns - k)[columns - k]))
            shift = self.height - level[now] - 1
            inner = shift >= 0
            nodes, there, shift, begin, deeper = nodes[inner], there[inner], shift[inner], start[now][inner], level[now][inner] + 1
            if len(nodes):
                half = (rows >> shift[:, None] & 1) * 2
                bits = np.where(there, self.bits[nodes], 0)
                first = self.first[nodes]
                made = []
                for side in (0, 1):
                    quadrant = half + side
                    child = np.where(bits >> quadrant & 1, first + _SET[bits & ((1 << quadrant) - 1)], -1)
                    more = np.where(child >= 0, self.impact[child], 0) @ weights
                    made.append((child, more, begin + (side << shift)))
                child, more, begin = (np.concatenate(x) for x in zip(*made, strict=True))
                shift, deeper = np.tile(shift, 2), np.tile(deeper, 2)
                open_ = np.flatnonzero(more > 0)
                child, more, begin, shift, deeper = child[open_], more[open_], begin[open_], shift[open_], deeper[open_]
                # the most that a document of the range is known to have: maxima of known over runs of each width that occurs
                above = np.zeros(len(begin), np.int64)
                for s in np.unique(shift).tolist():
                    of = shift == s
                    width = 1 << s
                    padded = np.pad(known, (0, -columns % width)).reshape(-1, width).max(1)
                    above[of] = padded[begin[of] >> s]
                level, start = np.concatenate([level[rest], deeper]), np.concatenate([start[rest], begin])
                node, bound = np.concatenate([node[rest], child]), np.concatenate([bound[rest], more + above])
            else:
                level, start, node, bound = level[rest], start[rest], node[rest], bound[rest]
        out = np.flatnonzero(known >= floor)
        return out, known[out]


def block_of(ids: list, texts: list[bytes], wanted: frozenset[bytes] | None, n_docs: int, n_terms: int) -> dict:
    """The index row of some documents. wanted: the terms that get a row of the grid; None: all."""
    number: dict[bytes, int] = defaultdict(lambda: len(number))
    cols, rows, often, length = [], [], [], np.zeros(len(ids), np.int64)
    for k, raw in enumerate(texts):
        counts: Counter = Counter()
        for part in terms_of(raw):
            counts.update(part)
        length[k] = counts.total()
        mine = list(counts) if wanted is None else list(counts.keys() & wanted)
        cols.append(len(mine))
        rows += map(number.__getitem__, mine)
        often += map(counts.__getitem__, mine)
    col, row, tf = np.repeat(np.arange(len(ids)), cols), np.array(rows, np.int64), np.array(often, np.int64)
    df = np.bincount(row, minlength=len(number))
    # columns by the commonest term of a document, then by length; rows by their mean column: so squares are filled with what is alike
    top = np.full(len(ids), -1)
    by = np.lexsort((row, tf, col))
    top[col[by]] = row[by]  # the last one of a column stays
    order = np.lexsort((length, top))
    place = np.empty(len(ids), np.int64)
    place[order] = np.arange(len(ids))
    col = place[col]
    mean = np.bincount(row, col, len(number)) / np.maximum(df, 1)
    by_mean = np.argsort(mean, kind="stable")
    at = np.empty(len(number), np.int64)
    at[by_mean] = np.arange(len(number))
    row = at[row]
    m = 50 + (50 * length[order] * n_docs) // max(n_terms, 1)
    impact = (1_000_000_000 * tf) // (1000 * tf + 20 * m[col])
    some = impact > 0
    names = list(number)
    height = (max(len(number), len(ids), 2) - 1).bit_length()
    out = treap(row[some], col[some], impact[some], height)
    return out | {"doc_ids": [ids[k] for k in order.tolist()], "terms": b"\n".join(names[k] for k in by_mean.tolist()), "df": df[by_mean].tolist()}


def build_index(docs: DataFrame, wanted: frozenset[bytes] | None = None, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, int]:
    """The index, written to the shared folder, and N. Each task makes blocks of its own rows: nothing is shuffled.

    wanted: the terms that queries will ask about; grids then have rows for these alone. Every document is in the index.
    """
    n_docs, n_terms = corpus_size(docs, text_col)
    schema = pa.schema([("height", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("terms", pa.binary()), ("df", pa.list_(pa.int32())), ("sizes", pa.list_(pa.int32())), ("children", pa.binary()), ("falls", pa.binary()), ("places", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, size = [], [], 0
        made = lambda: pa.RecordBatch.from_pylist([block_of(ids, texts, wanted, n_docs, n_terms)], schema)
        for b in batches:
            for i, raw in zip(b.column(0), b.column(1), strict=True):
                ids.append(i.as_py())
                texts.append(raw.as_py())
                size += len(texts[-1])
                if len(ids) >= DOCS or size >= BYTES:
                    yield made()
                    ids, texts, size = [], [], 0
        if ids:
            yield made()

    rows = docs.select(F.col(id_col).cast("long").alias("id"), utf8(text_col).alias("raw"))
    return stage(rows.mapInArrow(run, INDEX), "k2-index"), n_docs


def item_terms(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item_id, term (bytes): the different terms of every item; rows of one id count together."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            pairs = [(k, t) for k, raw in enumerate(b["raw"]) for t in {t for part in terms_of(raw) for t in part}]
            out = b.iloc[[k for k, _ in pairs]][["item_id"]].reset_index(drop=True)
            out["term"] = pd.Series([t for _, t in pairs], dtype=object)
            yield out

    rows = items.select(F.col(id_col).alias("item_id"), utf8(text_col).alias("raw"))
    return rows.mapInPandas(run, f"item_id {rows.schema['item_id'].dataType.simpleString()}, term binary").distinct()


def weighted(terms: DataFrame, index: DataFrame, n_docs: int) -> DataFrame:
    """terms with weight, the whole part of 1000 * ln((2N + 2) / (2df + 1)), where a document holds them."""
    df = index.select(F.explode(F.arrays_zip(F.split(F.col("terms").cast("string"), "\n").alias("t"), F.col("df").alias("d"))).alias("x")).groupBy(F.col("x.t").alias("_t")).agg(F.sum("x.d").alias("df"))
    held = terms.withColumn("_t", F.col("term").cast("string")).join(df, "_t").drop("_t")
    return held.withColumn("weight", F.floor(1000 * F.log(F.lit(2.0 * n_docs + 2) / (2 * F.col("df") + 1))).cast("long"))


def _search(index: DataFrame, asked: list[tuple[int, bytes, int]], k: int) -> DataFrame:
    """item (its number), doc_id, score: the k best of each task for each item. asked: item, term, weight."""
    items: dict[int, list[tuple[bytes, int]]] = defaultdict(list)
    for item, term, weight in asked:
        items[item].append((term, weight))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, list[tuple]] = {i: [] for i in items}  # heaps of (score, nulls last, least id last, id)
        for b in batches:
            for r in range(b.num_rows):
                block = {c: b.column(c)[r].as_py() for c in ("height", "terms", "sizes", "children", "falls", "places")}
                if not block["sizes"]:
                    continue
                ids, tree = b.column("doc_ids")[r].as_py(), Treap(block)
                number = {t: n for n, t in enumerate(block["terms"].split(b"\n"))}
                for i, terms in items.items():
                    mine = [(number[t], w) for t, w in terms if t in number]
                    if not mine:
                        continue
                    heap = best[i]
                    cols, scores = tree.best(*np.array(mine, np.int64).T, k, heap[0][0] if len(heap) == k else 0, len(ids))
                    for c, s in zip(cols.tolist(), scores.tolist(), strict=True):
                        d = ids[c]
                        entry = (s, d is None, -(d or 0), d)
                        if len(heap) < k:
                            heapq.heappush(heap, entry)
                        elif entry[:3] > heap[0][:3]:
                            heapq.heapreplace(heap, entry)
        out = [(i, e[3], e[0]) for i, heap in best.items() for e in heap]
        yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int64()), pa.array([o[2] for o in out], pa.int64())], ["item", "doc_id", "score"])

    return index.mapInArrow(run, FOUND)


def ranked(docs: DataFrame, items: DataFrame, k: int = 50) -> DataFrame:
    """item_id, rank, doc_id, score: the k documents of the highest scores above 0 for every item; equal scores by doc_id, nulls first.

    A null text has no terms; an item without terms, or whose terms no document holds, has no rows; repeated rows of documents are documents of their
    own, rows of one item id count together, a null id too; other columns, whatever their names, don't matter; empty tables give no rows.
    Items go in groups of about TERMS terms, each with one pass over the index. Their terms are collected a group at a time; grids have rows for
    the terms of all items while these are FEW at most, else for all terms of documents.
    """
    spark = docs.sparkSession
    terms = stage(item_terms(items), "item-terms")
    different = terms.select("term").distinct()
    wanted = frozenset(bytes(r[0]) for r in different.collect()) if different.count() <= FEW else None
    index, n_docs = build_index(docs, wanted)
    groups = max(1, math.ceil(terms.count() / TERMS))
    numbered = stage(terms.select("item_id").distinct().withColumn("item", F.monotonically_increasing_id()), "items")
    names = numbered.withColumnRenamed("item_id", "_name")
    asked = stage(weighted(terms, index, n_docs).join(names, F.col("item_id").eqNullSafe(F.col("_name"))).select(F.pmod(F.xxhash64("item"), F.lit(groups)).alias("part"), "item", "term", "weight"), "asked")
    parts = []
    for g in range(groups):
        mine = [(r[0], bytes(r[1]), r[2]) for r in asked.where((F.col("part") == g) & (F.col("weight") > 0)).select("item", "term", "weight").collect()]
        parts.append(stage(_search(index, mine, k), "found"))
    found = parts[0] if len(parts) == 1 else spark.read.schema(parts[0].schema).parquet(*[p.staged_at for p in parts])
    best = found.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc("doc_id")))).where(F.col("rank") <= k)
    return best.join(F.broadcast(numbered) if groups == 1 else numbered, "item").select("item_id", "rank", "doc_id", "score")
