"""Benchmark decontamination by a prefix-filtered set join, with DataFrame functions only.

An item's window of WINDOW words is present where all its shingles are, so the rarest one is a necessary
prefix: the corpus is counted once for the items' shingles, each window keeps its rarest as anchor, and
only places of anchors are looked at. There the window's position in the text follows from the anchor's
offset; position and length bounds and the comparison of all its words decide. Anchors are broadcast in blocks of
at most BLOCK windows, each block another pass over the texts. Texts are never shuffled.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewlake.llm.common import stage, text_key

WINDOW, SHINGLE = 13, 3
#: Windows, and shingles, that are broadcast at once: some tens of MB.
BLOCK = 200_000
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower_az(text: Column) -> Column:
    """A-Z in lower case, and nothing else."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words_of(text: Column) -> Column:
    """The words in order; null text has none."""
    return F.filter(F.split(lower_az(F.coalesce(text, F.lit(""))), SEPARATORS), lambda w: w != "")


def shingles_of(words: Column, size: int) -> Column:
    """The hash of each run of `size` words, by its place."""
    hashed = lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(size)])
    places = F.when(F.size(words) >= size, F.sequence(F.lit(0), F.size(words) - size)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, hashed)


def item_windows(items: DataFrame, window: int, shingle: int) -> DataFrame:
    """content (array of words), length, size (words of a shingle) and item_ids of each different window."""
    words = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), words_of(F.col("text")).alias("words"))
    words = words.where(F.size("words") > 0).withColumn("length", F.least(F.size("words"), F.lit(window)))
    starts = words.select("item_id", "words", "length", F.explode(F.expr("sequence(1, size(words) - length + 1)")).alias("at"))
    one = starts.select("item_id", "length", F.slice("words", F.col("at"), F.col("length")).alias("content"))
    return one.groupBy("content", "length").agg(F.collect_set("item_id").alias("item_ids")).withColumn("size", F.least(F.col("length"), F.lit(shingle)))


def _places(docs: DataFrame, size: int) -> DataFrame:
    """One row for each shingle of each text, and a last one with a null hash: at, hash beside the text's columns."""
    cut = docs.withColumn("words", words_of(F.col("text"))).withColumn("n_words", F.size("words").cast("long"))
    cut = cut.withColumn("hashes", F.array_append(shingles_of(F.col("words"), size), F.lit(None).cast("long")))
    return cut.select("doc_id", "text_key", "n_words", "words", F.posexplode_outer("hashes").alias("at", "hash"))


def anchors_of(docs: DataFrame, windows: DataFrame, size: int) -> DataFrame:
    """content, length, item_ids of windows of one shingle size, with the hash and offset of their rarest shingle in docs."""
    all_of = windows.where(F.col("size") == size).select("content", "length", "item_ids", F.posexplode(shingles_of(F.col("content"), size)).alias("offset", "hash"))
    known = stage(all_of.select("hash").distinct(), "shingles")
    blocks = math.ceil(known.count() / BLOCK)
    parts = []
    for b in range(blocks):
        part = F.broadcast(known.where(F.pmod("hash", F.lit(blocks)) == b))
        parts.append(_places(docs, size).join(part, "hash").groupBy("hash").agg(F.count(F.lit(1)).alias("times")))
    times = reduce(DataFrame.unionByName, parts)
    counted = all_of.join(times, "hash", "left").withColumn("rank", F.struct(F.coalesce("times", F.lit(0)).alias("times"), "hash", "offset"))
    best = counted.groupBy("content", "length").agg(F.min("rank").alias("rank"), F.first("item_ids").alias("item_ids"))
    return best.select("content", "length", "item_ids", F.col("rank.hash").alias("hash"), F.col("rank.offset").alias("offset"))


def hits_of(docs: DataFrame, anchors: DataFrame, size: int, with_rows: bool) -> DataFrame:
    """One row for each occurrence of a window: start, length, item_ids. with_rows: and one for each text, without a start."""
    found = _places(docs, size).join(F.broadcast(anchors), "hash", "left" if with_rows else "inner")
    start = F.col("at") - F.col("offset")
    inside = (start >= 0) & (start + F.col("length") <= F.col("n_words"))
    same = inside & (F.slice("words", F.when(inside, start + 1).otherwise(1), F.when(inside, F.col("length")).otherwise(0)) == F.col("content"))
    same = F.coalesce(same, F.lit(False))
    keep = same | F.col("hash").isNull() if with_rows else same
    only = lambda c: F.when(same, c)
    return found.where(keep).select("doc_id", "text_key", "n_words", only(start).alias("start"), only(F.col("length")).alias("length"), only(F.col("item_ids")).alias("item_ids"))


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, percent: int = 5) -> DataFrame:
    """doc_id, text_key, n_words, n_hit, n_items, items_sha256, contaminated for every row of docs.

    Null and wordless texts and items hit nothing; rows with a null id are judged like others; repeated rows give repeated results; columns
    of docs other than doc_id and text don't matter, whatever their names; a null item id counts as an empty one; without items
    nothing is hit; an empty table gives no rows.
    """
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), text_key())
    windows = stage(item_windows(items, window, shingle), "windows")
    sizes = [r["size"] for r in windows.groupBy("size").count().orderBy(F.desc("size")).collect()]  # as many rows as a shingle has words at most
    parts = []
    for size in sizes:
        anchors = stage(anchors_of(docs, windows, size), "anchors")
        blocks = max(1, math.ceil(anchors.count() / BLOCK))
        parts += [hits_of(docs, anchors.where(F.pmod("hash", F.lit(blocks)) == b), size, not parts and b == 0) for b in range(blocks)]
    if not parts:
        none = docs.select("doc_id", "text_key", F.size(words_of(F.col("text"))).cast("long").alias("n_words"))
        parts = [none.withColumns({"start": F.lit(None).cast("int"), "length": F.lit(None).cast("int"), "item_ids": F.lit(None).cast("array<string>")})]
    hits = reduce(DataFrame.unionByName, parts)
    by_text = hits.groupBy("doc_id", "text_key").agg(
        F.max("n_words").alias("n_words"), F.count_if(F.col("start").isNull()).alias("copies"),
        F.sort_array(F.collect_set(F.when(F.col("start").isNotNull(), F.struct("start", "length")))).alias("runs"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("item_ids")))).alias("found"),
    )
    covered = F.aggregate(
        "runs", F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n")),
        lambda a, r: F.struct(
            F.greatest(a["end"], r["start"] + r["length"]).alias("end"),
            (a["n"] + F.greatest(F.lit(0), r["start"] + r["length"] - F.greatest(a["end"], r["start"]))).alias("n"),
        ), lambda a: a["n"],
    )
    each = by_text.withColumn("n_hit", covered).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return each.select(
        "doc_id", "text_key", "n_words", "n_hit", F.size("found").cast("long").alias("n_items"), F.sha2(F.array_join("found", ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (100 * F.col("n_hit") >= percent * F.col("n_words"))).alias("contaminated"),
    )


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, percent: int = 5) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated: the digest of contamination."""
    return contamination(docs, items, window, shingle, percent).drop("text_key")
