"""Sharding by a Hilbert curve over quantised metadata, with DataFrame functions only.

Each dimension is cut into 2**bits ranges at quantiles over all rows (approximate ones for numbers; for strings
those of the whole values, by counts of the different ones), and a cell's coordinates become its position on
the curve. Rows are ranked along the curve and the ranking is cut into runs whose row counts differ by
at most one, so a shard covers a small box of every dimension and min/max statistics prune it.

A global rank needs no global sort: rows are counted by (cell, salt), counts are summed along the at most
2**(bits*dims) cells, and row_number runs inside one (cell, salt) only. The salt splits a cell that holds
a large share of all rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewlake.llm.common import stage

#: Salts of a cell at least, and rows of the table for each further one.
SALTS, SALT_ROWS = 64, 1_000_000


def is_text(df: DataFrame, name: str) -> bool:
    return dict(df.dtypes)[name] in ("string", "binary")


def number_cuts(df: DataFrame, dims: list[str], bits: int) -> dict[str, list[float]]:
    """Inner quantile bounds of the number columns, without repeats: 2**bits - 1 of each at most. Nulls lie below all bounds."""
    shares = F.array(*[F.lit(i / 2**bits) for i in range(1, 2**bits)])
    row = df.agg(F.count(F.lit(1)), *[F.percentile_approx(F.coalesce(F.col(d).cast("double"), F.lit(float("-inf"))), shares, 10000) for d in dims]).first()
    return {d: sorted({x for x in row[i + 1] or [] if x != float("-inf")}) for i, d in enumerate(dims)}


def text_cuts(df: DataFrame, name: str, bits: int) -> list:
    """Inner quantile bounds of a string column by its whole values, without repeats: 2**bits - 1 at most.

    The different values, with their counts, are dealt in order to partitions; counts before a partition and within it add up to a
    value's rank, and those that cross a quantile are the bounds.
    """
    values = df.groupBy(F.col(name).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    dealt = stage(values.repartitionByRange("v").withColumn("part", F.spark_partition_id()), "values")
    parts = dealt.groupBy("part").agg(F.sum("n").alias("held"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    parts = parts.select("part", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("before"), F.sum("held").over(Window.partitionBy()).alias("total"))
    through = F.col("before") + F.sum("n").over(Window.partitionBy("part").orderBy("v"))
    ranked = dealt.join(F.broadcast(parts), "part").withColumn("through", through)
    share = lambda c: F.floor(c * F.lit(2**bits) / F.col("total"))
    crossing = ranked.where(F.col("v").isNotNull() & (share(F.col("through")) > share(F.col("through") - F.col("n"))))
    return sorted(r["v"] for r in crossing.select("v").collect())


def cuts(df: DataFrame, dims: list[str], bits: int) -> list[list]:
    """The bounds of each dimension."""
    numbers = number_cuts(df, [d for d in dims if not is_text(df, d)], bits)
    return [text_cuts(df, d, bits) if is_text(df, d) else numbers[d] for d in dims]


def hilbert_index(df: DataFrame, coords: list[str], bits: int, out: str) -> DataFrame:
    """Add the curve position of integer coordinates below 2**bits (Skilling's transform, unrolled)."""
    n = len(coords)
    x = [f"_x{i}" for i in range(n)]
    df = df.withColumns({x[i]: F.col(coords[i]).cast("long") for i in range(n)})
    for level in range(bits - 1, 0, -1):
        q, p = 1 << level, F.lit((1 << level) - 1)
        for i in range(n):
            low = F.col(x[0]).bitwiseXOR(F.col(x[i])).bitwiseAND(p)
            df = df.withColumns({"_on": F.col(x[i]).bitwiseAND(F.lit(q)) != 0, "_t": low})
            df = df.withColumns(
                {x[0]: F.when(F.col("_on"), F.col(x[0]).bitwiseXOR(p)).otherwise(F.col(x[0]).bitwiseXOR(F.col("_t")))}
                | ({x[i]: F.when(F.col("_on"), F.col(x[i])).otherwise(F.col(x[i]).bitwiseXOR(F.col("_t")))} if i else {})
            )
    for i in range(1, n):
        df = df.withColumn(x[i], F.col(x[i]).bitwiseXOR(F.col(x[i - 1])))
    flips = [F.when(F.col(x[-1]).bitwiseAND(F.lit(1 << k)) != 0, (1 << k) - 1).otherwise(0).cast("long") for k in range(bits - 1, 0, -1)]
    df = df.withColumn("_t", reduce(lambda a, b: a.bitwiseXOR(b), flips, F.lit(0).cast("long")))
    spread = [
        F.shiftleft(F.shiftright(F.col(x[i]).bitwiseXOR(F.col("_t")), k).bitwiseAND(F.lit(1)), k * n + (n - 1 - i)) for k in range(bits) for i in range(n)
    ]
    return df.withColumn(out, reduce(lambda a, b: a + b, spread)).drop("_t", "_on", *x)


def hilbert_shards(df: DataFrame, dims: list[str], shards: int, order_by: list[str], bits: int = 4) -> DataFrame:
    """Add hilbert, shard and slot (gapless from 0 within a shard) to every row.

    Null dimensions sort first; rows equal in every order_by column take any order among themselves; an
    empty table gives an empty result; columns other than those added are kept as they are.
    """
    bounds = cuts(df, dims, bits)
    salts = max(SALTS, df.count() // SALT_ROWS)
    coords = [f"_c{i}" for i in range(len(dims))]
    cell = F.lit(0).cast("long")
    for name, d, at in zip(coords, dims, bounds, strict=True):
        value = F.col(d) if is_text(df, d) else F.col(d).cast("double")
        above = [F.when(value >= F.lit(b), 1).otherwise(0) for b in at]  # null is above none
        df = df.withColumn(name, reduce(lambda a, b: a + b, above, F.lit(0)))
        cell = F.shiftleft(cell, bits) + F.col(name)
    df = df.withColumns({"_cell": cell, "_salt": F.pmod(F.xxhash64(*order_by), F.lit(salts)).cast("int")})
    counts = df.groupBy("_cell", "_salt", *coords).agg(F.count(F.lit(1)).alias("_n"))
    cells = hilbert_index(counts.groupBy("_cell", *coords).agg(F.sum("_n").alias("_n")), coords, bits, "hilbert")
    along = Window.orderBy("hilbert").rowsBetween(Window.unboundedPreceding, -1)  # over the cells: 2**(bits*dims) rows at most
    whole = Window.partitionBy()
    cells = cells.select("_cell", "hilbert", F.coalesce(F.sum("_n").over(along), F.lit(0)).alias("_before"), F.sum("_n").over(whole).alias("_total"))
    within = Window.partitionBy("_cell").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.join(F.broadcast(cells), "_cell").select(
        "_cell", "_salt", "hilbert", "_total", (F.col("_before") + F.coalesce(F.sum("_n").over(within), F.lit(0))).alias("_start")
    )
    rank = F.row_number().over(Window.partitionBy("_cell", "_salt").orderBy(*order_by)) - 1
    placed = df.drop(*coords).join(starts.hint("merge"), ["_cell", "_salt"]).withColumn("_rank", F.col("_start") + rank)
    shard = F.expr(f"_rank * {shards} div _total")
    first = F.expr(f"(shard * _total + {shards - 1}) div {shards}")
    return placed.withColumn("shard", shard.cast("int")).withColumn("slot", F.col("_rank") - first).drop("_cell", "_salt", "_start", "_rank", "_total")


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder per shard, rows in curve order, for pruning by file statistics."""
    sharded.repartition("shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def shard_documents(docs: DataFrame, shards: int = 24) -> DataFrame:
    """The digest: doc_id, size, text_crc32, law, shard, slot, grown_shard. Texts are never shuffled.

    Null text counts as empty; null ids and metadata sort first; repeated rows each have their slot; other columns of docs, whatever their
    names, don't matter; an empty table gives no rows.
    """
    text = F.encode(F.coalesce(F.col("text"), F.lit("")), "utf-8")
    meta = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), "lang", "source", "n_chars",
        (F.octet_length(F.coalesce(F.col("text"), F.lit(""))).cast("long") + 8).alias("size"), F.crc32(text).alias("text_crc32"),
    )
    placed = hilbert_shards(meta, ["lang", "source", "n_chars"], shards, ["doc_id", "text_crc32", "size"])
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "hilbert"
    )
