"""Word-shingle Jaccard self-join: size-banded tiles, hashed bitmaps, exact intersections.

Keys. Two sets that link differ in few shingles: with s1 + s2 = S, in at most S (1 - t) / (1 + t). The hash
range is cut into more segments than that, so some segments are equal in both; equal segments of documents of one
size band are an equi-join, on keys far more selective than single shingles. Spare segments are added, and as many of
a document's keys are left out, the commonest first (a prefix filter: one order for all documents, so two that link
still meet): segments without shingles, and those that hold nothing but a passage that many documents share.

Pairs. Sets that are equal are one class. In each group of equal keys, members are first held against the
least member only. Groups whose members are still in several components are compared, groups of the same members once, in
tiles: a small group is one tile, a larger one is cut into blocks of one size band, of about TILE documents, of one component
where it fills a block, and tiles are two blocks each; those within one component are left out. Bit counts of hashed bitmaps
bound the overlap from above, and pairs that they leave open are decided on the sorted sets; first a forest of the likeliest
pairs of each tile, then every pair across components. So no link is lost, no group emits all its pairs, and no key is
gathered in one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewlake.llm.common import drop, if_few, scratch, small_batches, stage, utf8
from reviewlake.llm.components import components
from reviewlake.llm.words import cut

#: Jaccard similarity, in hundredths, from which two documents link.
LEAST = 90
WORDS = 3
TILE = 256
#: Ratio of a size band's ends, and of the bands of a large group's blocks.
BAND, NARROW = 1.35, 1.06
#: Logarithm of the bits of a filter of keys that several documents have; where there are more keys it only lets more through.
FILTER = 27
#: A key is common from COMMON documents and one in 2**RARE documents on: at most 2**RARE times the keys of a document.
COMMON, RARE = 64, 14
#: Members of small groups that one call of the comparison takes.
DEAL = 4000


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingle_set(raw: bytes, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word n-grams; of a shorter text, of its whole sequence."""
    h = cut(b"\n" + raw.lower() + b"\n")[2]  # lower() of bytes: A-Z alone
    if not len(h):
        return h
    n = min(words, len(h))
    at = len(h) - n + 1
    s = np.full(at, n, np.uint64)
    for k in range(n):
        s = _mix(s * np.uint64(0x9E3779B97F4A7C15) + h[k : k + at])
    return np.unique(s)


@lru_cache(4)
def bands(least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First sizes of the bands, and by band the segments in all and the spare ones among them."""
    first = [1]
    while first[-1] < 2**40:
        first.append(max(first[-1] + 1, int(first[-1] * BAND)))
    top = np.array(first[1:]) - 1  # the largest size of each band
    differ = 2 * top * (100 - least) // (100 + least)
    spare = np.where(differ > 0, 1 + differ // 16, 0)
    return np.array(first[:-1]), differ + 1 + spare, spare


def bands_of(n: int, least: int) -> range:
    """A set's own band, and the next where a partner may be in it."""
    first = bands(least)[0]
    return range(int(np.searchsorted(first, n, "right")) - 1, int(np.searchsorted(first, n * 100 // least, "right")))


@lru_cache(256)
def empty_keys(band: int, least: int) -> np.ndarray:
    """The keys of a band's segments where they hold nothing."""
    return _mix(_mix(np.arange(int(bands(least)[1][band]), dtype=np.uint64) + np.uint64((band + 1) << 40)))


def segment_keys(s: np.ndarray, least: int) -> np.ndarray:
    """The join keys of a sorted set: one for each segment of each of its bands."""
    sums = np.concatenate(([np.uint64(0)], np.cumsum(_mix(s ^ np.uint64(0x5851F42D4C957F2D)), dtype=np.uint64)))
    out = []
    for band in bands_of(len(s), least):
        k = int(bands(least)[1][band])
        ends = np.searchsorted((s >> np.uint64(32)) * np.uint64(k) >> np.uint64(32), np.arange(k + 1, dtype=np.uint64))
        out.append(_mix((sums[ends[1:]] - sums[ends[:-1]]) ^ _mix(np.arange(k, dtype=np.uint64) + np.uint64((band + 1) << 40))))
    return np.concatenate(out)


def rarest_keys(keys: np.ndarray, n: int, least: int, common: np.ndarray, times: np.ndarray) -> np.ndarray:
    """A set's keys without the commonest of each band, as many as it has spare segments. common: sorted, with their times."""
    out, at = [], 0
    for band in bands_of(n, least):
        empty, spare = empty_keys(band, least), int(bands(least)[2][band])
        part = keys[at : at + len(empty)]
        at += len(empty)
        weight = np.zeros(len(part), np.int64)
        if len(common):
            spot = np.minimum(np.searchsorted(common, part), len(common) - 1)
            weight = np.where(common[spot] == part, times[spot], weight)
        weight[part == empty] = np.iinfo(np.int64).max
        out.append(part[np.lexsort((part, weight))[: len(part) - spare]])
    return np.concatenate(out)


def bitmap(s: np.ndarray) -> bytes:
    """Parities of the hashes by their low bits; two to four bits a shingle."""
    width = 1 << int(min(max(6, (2 * len(s) - 1).bit_length()), 16))
    return np.packbits(np.bincount((s & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1, bitorder="little").tobytes()


def fold(bits: np.ndarray, words: int) -> np.ndarray:
    """A bitmap of 64-bit words on fewer words: parities add up."""
    return np.bitwise_xor.reduce(bits.reshape(-1, words), axis=0)


def may_link(n1, n2, apart, least: int):
    """Whether sizes and the count of differing bits allow a link: differing bits bound the overlap from above."""
    most = np.minimum((n1 + n2 - apart) // 2, np.minimum(n1, n2))
    return 100 * most >= least * (n1 + n2 - most)


def sign(docs: DataFrame, id_col: str, text_col: str, least: int, words: int) -> DataFrame:
    """id, n, set_hash, keys, bits of every row; null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, whole, keys, bits = [], [], [], []
            for raw in b.column(1).to_pylist():
                s = shingle_set(raw, words)
                n.append(len(s))
                whole.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                keys.append(segment_keys(s, least).view(np.int64) if len(s) else np.empty(0, np.int64))
                bits.append(bitmap(s) if len(s) else b"")
            offsets = np.concatenate(([0], np.cumsum([len(k) for k in keys]))).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*keys, np.empty(0, np.int64)])))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(whole, pa.binary()), lists, pa.array(bits, pa.binary())], ["id", "n", "set_hash", "keys", "bits"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), utf8(text_col).alias("t"))
    return rows.mapInArrow(run, "id long, n long, set_hash binary, keys array<long>, bits binary")


def sets_of(docs: DataFrame, id_col: str, text_col: str, ids: DataFrame, words: int) -> DataFrame:
    """The sorted sets, as bytes, of the rows that some pair is about."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shingle_set(t, words).tobytes() for t in b.column(1).to_pylist()], pa.binary())], ["id", "shingles"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), utf8(text_col).alias("t")).join(ids, "id", "left_semi")
    return rows.mapInArrow(run, "id long, shingles binary")


def open_pairs(pairs: DataFrame, reps: DataFrame, least: int) -> DataFrame:
    """The pairs (a, b) that sizes and bitmaps leave open."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            col = b.to_pydict()
            keep = []
            for n1, x, n2, y in zip(col["n1"], col["bits1"], col["n2"], col["bits2"], strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                w = min(len(x), len(y))
                keep.append(bool(may_link(n1, n2, int(np.bitwise_count(fold(x, w) ^ fold(y, w)).sum()), least)))
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    side = lambda k, c: reps.select(F.col("id").alias(c), F.col("n").alias(f"n{k}"), F.col("bits").alias(f"bits{k}"))
    near = pairs.join(side(1, "a"), "a").join(side(2, "b"), "b")
    return near.where(100 * F.least("n1", "n2") >= least * F.greatest("n1", "n2")).mapInArrow(run, "a long, b long")


def links_of(pairs: DataFrame, sets: DataFrame, least: int) -> DataFrame:
    """The pairs that link, by exact intersection of the sorted sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column("s1").to_pylist(), b.column("s2").to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = int((x[np.minimum(np.searchsorted(x, y), len(x) - 1)] == y).sum())
                keep.append(100 * both >= least * (len(x) + len(y) - both))
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    side = lambda k, c: sets.select(F.col("id").alias(c), F.col("shingles").alias(f"s{k}"))
    return pairs.join(side(1, "a"), "a").join(side(2, "b"), "b").mapInArrow(run, "a long, b long")


def filter_of(keys: DataFrame) -> np.ndarray:
    """One bit for each key, by its low bits: 2**(FILTER - 6) words at most."""
    word, bit = F.col("key").bitwiseAND(F.lit((1 << FILTER - 6) - 1)), F.shiftrightunsigned("key", FILTER - 6).bitwiseAND(F.lit(63)).cast("int")
    rows = keys.groupBy(word.alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit)).alias("bits")).toArrow()
    out = np.zeros(1 << FILTER - 6, np.uint64)
    out[np.asarray(rows.column("word"))] = np.asarray(rows.column("bits")).view(np.uint64)
    return out


def posts_of(reps: DataFrame, least: int, sent: Broadcast) -> DataFrame:
    """id, key: the keys that each document meets others by. sent: common keys in order, their times, the filter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, times, bits = sent.value
        for b in batches:
            lists, n = b.column(2), b.column(1).to_pylist()
            flat, ends = np.asarray(lists.flatten()).view(np.uint64), np.asarray(lists.offsets) - lists.offsets[0].as_py()
            kept = [rarest_keys(flat[ends[i] : ends[i + 1]], n[i], least, common, times) for i in range(len(n))]
            ids = np.repeat(np.asarray(b.column(0)), [len(k) for k in kept])
            keys = np.concatenate([*kept, np.empty(0, np.uint64)])
            met = bits[(keys & np.uint64(len(bits) - 1)).astype(np.int64)] >> (keys >> np.uint64(FILTER - 6) & np.uint64(63)) & np.uint64(1) > 0
            yield pa.RecordBatch.from_arrays([pa.array(ids[met]), pa.array(keys[met].view(np.int64))], ["id", "key"])

    return reps.select("id", "n", "keys").mapInArrow(run, "id long, key long")


def shared_keys(reps: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """id, key of the keys that each document meets others by; and distinct (a, b): each document b with the least one of a key."""
    keys = reps.select(F.explode("keys").alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("times"))  # no ids: most keys are one document's
    keys = stage(keys.where("times > 1"), "keys")
    bar = max(COMMON, reps.count() >> RARE)
    found = keys.where(F.col("times") >= bar).select("key", "times").toArrow()  # 2**RARE times the keys of a document at most
    common, times = np.asarray(found.column("key")).view(np.uint64), np.asarray(found.column("times"))
    order = np.argsort(common)
    posts = posts_of(reps, least, reps.sparkSession.sparkContext.broadcast((common[order], times[order], filter_of(keys))))
    posts = stage(posts.join(keys, "key").select("id", "key"), "posts")
    least_ids = posts.groupBy("key").agg(F.min("id").alias("a"))
    return posts, posts.join(least_ids, "key").where(F.col("a") != F.col("id")).select("a", F.col("id").alias("b")).distinct()


def open_groups(posts: DataFrame, found: DataFrame) -> DataFrame:
    """id, family (a key), size, component of the groups with members in several components; of groups of the same members one.

    posts: id, key; found: node, component of those that links join. Members are told by two 64-bit sums of hashes and a count.
    """
    found = if_few(found.withColumnRenamed("node", "id"), "found")
    members = stage(posts.join(found, "id", "left").withColumn("component", F.coalesce("component", "id")), "members")
    same = [F.count(F.lit(1)).alias("size"), F.bit_xor(F.xxhash64("id")).alias("x"), F.bit_xor(F.xxhash64("id", F.lit(1))).alias("y")]
    groups = members.groupBy("key").agg(*same, F.min("component").alias("c1"), F.max("component").alias("c2")).where("c1 != c2")
    groups = if_few(groups.groupBy("size", "x", "y").agg(F.min("key").alias("key")).select("key", "size"), "groups")
    return members.join(groups, "key").withColumnRenamed("key", "family")


def in_blocks(nodes: DataFrame) -> DataFrame:
    """Add band, part and salt to id, n, family, component: blocks of about TILE documents of a family, by counts alone.

    A component with TILE documents in a band has blocks of its own (part: its id); the others of a band share blocks.
    """
    nodes = nodes.withColumn("band", F.floor(F.log("n") / F.lit(float(np.log(NARROW)))))
    sizes = nodes.groupBy("family", "band", "component").agg(F.count(F.lit(1)).alias("members"))
    sizes = sizes.withColumn("part", F.when(F.col("members") >= TILE, F.col("component")))
    blocks = sizes.groupBy("family", "band", "part").agg(F.ceil(F.sum("members") / TILE).alias("salts"))
    plain = sizes.select("family", "band", "component", "part")
    same = (plain["family"] == blocks["family"]) & (plain["band"] == blocks["band"]) & plain["part"].eqNullSafe(blocks["part"])
    where = plain.join(blocks, same).select(plain["family"], plain["band"], plain["component"], plain["part"], "salts")
    out = nodes.join(where, ["family", "band", "component"])
    return out.withColumns({"part": F.coalesce("part", F.lit(-1)), "own": F.col("part").isNotNull(), "salt": F.pmod(F.xxhash64("id"), F.col("salts"))}).drop("salts")


def tiles_of(nodes: DataFrame, least: int) -> DataFrame:
    """family, left, right (blocks as structs) of all tiles in which documents of different components may link."""
    block = F.struct("band", "own", "part", "salt").alias("block")
    ends = [F.min("n").alias("low"), F.max("n").alias("high"), F.min("component").alias("c1"), F.max("component").alias("c2")]
    blocks = nodes.groupBy("family", block).agg(*ends)
    other = blocks.select("family", *[F.col(c).alias(f"{c}_r") for c in ("block", "low", "high", "c1", "c2")])
    apart = F.least("c1", "c1_r") != F.greatest("c2", "c2_r")
    sizes = (100 * F.col("high") >= least * F.col("low_r")) & (100 * F.col("high_r") >= least * F.col("low"))
    return blocks.join(other, "family").where((F.col("block") <= F.col("block_r")) & apart & sizes).select("family", F.col("block").alias("left"), F.col("block_r").alias("right"))


def in_tiles(nodes: DataFrame, least: int) -> DataFrame:
    """id, n, component, tile, alone (of one block), first (of the left block), and the deal of tiles that is compared at once.

    nodes: id, n, family, size, component. Small groups are dealt out together, each as one tile; a tile of two blocks is a deal.
    """
    tile = ["id", "n", "component", "deal", "tile", "alone", "first"]
    small, large = nodes.where(F.col("size") <= TILE), nodes.where(F.col("size") > TILE)
    deal = F.pmod(F.xxhash64("family"), F.lit(1 + small.count() // DEAL))
    out = small.select("*", deal.alias("deal"), F.col("family").alias("tile"), F.lit(True).alias("alone"), F.lit(True).alias("first")).select(tile)
    if large.isEmpty():
        return out
    blocks = stage(in_blocks(large), "blocks")
    sides = tiles_of(blocks, least).select("*", (F.col("left") == F.col("right")).alias("alone"), F.explode(F.array_distinct(F.array("left", "right"))).alias("block"))
    sides = sides.select("family", F.xxhash64("family", "left", "right").alias("tile"), "alone", (F.col("block") == F.col("left")).alias("first"), "block.*")
    return out.unionByName(blocks.join(sides, ["family", "band", "own", "part", "salt"]).withColumn("deal", F.col("tile")).select(tile))


def spanning(found: list[tuple], part: np.ndarray) -> list[tuple]:
    """Of pairs in order of distance, those that join components that earlier ones leave apart."""
    root = {c: c for c in set(part.tolist())}

    def top(c: int) -> int:
        while root[c] != c:
            root[c] = c = root[root[c]]
        return c

    kept = []
    for f in sorted(found):
        x, y = top(part[f[1]]), top(part[f[2]])
        if x != y:
            root[max(x, y)] = min(x, y)
            kept.append(f)
    return kept


def tile_pairs(tiles: DataFrame, near: DataFrame, least: int, forest: bool) -> DataFrame:
    """Open pairs (a, b) across components, from tiles of bitmaps. near: id, bits.

    forest: of each tile only as many pairs as could join its components, those of the highest bound first.
    """

    def compare(rows: pd.DataFrame) -> Iterator[tuple[int, int]]:
        n, part, ids, first = (rows[c].to_numpy() for c in ("n", "component", "id", "first"))
        maps = [np.frombuffer(x, np.uint64) for x in rows["bits"]]
        widths = np.array([len(x) for x in maps])  # they grow with n
        alone, found = bool(rows["alone"].iloc[0]), []
        folded = {w: np.stack([fold(x, min(w, len(x))) if len(x) >= w else np.zeros(w, np.uint64) for x in maps]) for w in (np.unique(widths).tolist() if alone else [int(widths.min())])}
        for i in np.flatnonzero(first):
            if alone:
                bits, j = folded[int(widths[i])], np.arange(i + 1, np.searchsorted(n, n[i] * 100 // least, "right"))
            else:
                bits, j = folded[int(widths.min())], np.flatnonzero(~first)
            j = j[part[j] != part[i]]
            apart = np.bitwise_count(bits[j] ^ bits[i]).sum(1).astype(np.int64)
            ok = may_link(n[i], n[j], apart, least)
            found += zip(apart[ok] / (n[i] + n[j][ok]), [i] * int(ok.sum()), j[ok], strict=True)
        for f in spanning(found, part) if forest else found:
            yield min(ids[f[1]], ids[f[2]]), max(ids[f[1]], ids[f[2]])

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["tile", "n", "id"], ignore_index=True)
        pairs = [p for _, tile in rows.groupby("tile", sort=False) for p in compare(tile)]
        return pd.DataFrame({"a": [a for a, _ in pairs], "b": [b for _, b in pairs]}, dtype="int64")

    return tiles.join(near.select("id", "bits"), "id").groupBy("deal").applyInPandas(run, "a long, b long").distinct()


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, words: int = WORDS) -> DataFrame:
    """id_col, n_shingles, component_id for every row.

    Rows without words have no shingles and link with nothing; rows with a null id get a null component;
    repeated rows share their component; an empty table gives no rows.
    """
    with small_batches(docs.sparkSession), scratch(docs.sparkSession) as keep:
        return keep(stage(_similar(docs, id_col, text_col, least, words), "similar"))


def _similar(docs: DataFrame, id_col: str, text_col: str, least: int, words: int) -> DataFrame:
    signed = stage(sign(docs, id_col, text_col, least, words), "signed")
    linked = signed.where((F.col("n") > 0) & F.col("id").isNotNull())
    classes = linked.groupBy("set_hash").agg(F.min("id").alias("id"))
    own = linked.join(classes.withColumnRenamed("id", "first"), "set_hash").where(F.col("id") != F.col("first"))
    copies = if_few(own.select("set_hash", "id").distinct(), "copies")
    reps = linked.join(copies, ["set_hash", "id"], "left_anti")  # keys aren't shuffled where copies are few
    posts, stars = shared_keys(reps, least)
    stars = stage(stars, "stars")
    in_group = stars.select(F.col("a").alias("id")).union(stars.select("b")).distinct()
    near = stage(linked.select("id", "n", "bits").join(in_group, "id", "left_semi").dropDuplicates(["id"]), "near")
    narrow = stage(signed.select("id", "n", "set_hash"), "narrow")
    drop(signed)  # keys and bitmaps of all documents
    linked = narrow.where((F.col("n") > 0) & F.col("id").isNotNull())
    classes = linked.groupBy("set_hash").agg(F.min("id").alias("id"))
    first = stage(open_pairs(stars, near, least), "pairs")

    def decided(pairs: DataFrame) -> DataFrame:
        ids = if_few(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct(), "ids")
        sets = stage(sets_of(docs, id_col, text_col, ids, words).dropDuplicates(["id"]), "sets")
        out = stage(links_of(pairs, sets, least), "links")
        drop(sets)
        return out

    links = decided(first)
    for forest in (True, False):
        found = components(links, "a", "b")
        nodes = stage(open_groups(posts, found).join(near.select("id", "n"), "id"), "nodes")
        more = stage(tile_pairs(in_tiles(nodes, least), near, least, forest), "pairs")
        drop(nodes)
        if more.isEmpty():
            break
        links = stage(links.unionByName(decided(more)), "links")
    else:
        found = components(links, "a", "b")
    where = classes.join(found.withColumnRenamed("node", "id"), "id", "left").select("set_hash", F.coalesce("component", "id").alias("component_id"))
    out = narrow.join(where, "set_hash", "left")
    own = F.when(F.col("id").isNotNull() & (F.col("n") == 0), F.col("id")).when(F.col("id").isNotNull(), F.col("component_id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), own.alias("component_id"))
