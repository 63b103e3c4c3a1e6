"""Two joins that need care: ranges by buckets, and first-wins ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Each level of cells is so many bits wider than the one below.
STEP = 3


def _level(lo: str, hi: str, width: int) -> Column:
    """The first level whose cells are no shorter than an interval: it then lies in two of them at most."""
    cells = F.greatest(F.lit(1), F.ceil((F.col(hi) - F.col(lo) + 1) / width))
    return F.ceil(F.length(F.bin(cells - 1)) * (cells > 1).cast("int") / STEP).cast("int")


def _levels(df: DataFrame, lo: str, hi: str, width: int) -> Column:
    """The levels that occur: a handful of numbers, asked for once, as a scalar subquery."""
    return df.select(_level(lo, hi, width).alias("_l")).agg(F.collect_set("_l")).scalar()


def _dealt(df: DataFrame, lo: str, hi: str, width: int, theirs: Column | None) -> DataFrame:
    """df in the cells of its own level, or of each higher one that occurs on the other side: the level of a pair is that of its longer interval.

    theirs: the levels that occur there; None: the first level alone.
    """
    level = lambda l: F.call_function("shiftleft", F.lit(width).cast("long"), l * STEP)  # noqa: E731, E741
    cells = lambda l: F.transform(F.sequence(F.floor(F.col(lo) / level(l)), F.floor(F.col(hi) / level(l))), lambda x: F.struct(l.alias("_level"), x.alias("_bucket")))  # noqa: E731, E741
    own = df.withColumn("_own", F.lit(0) if theirs is None else _level(lo, hi, width)).withColumn("_theirs", F.array(F.lit(0)) if theirs is None else theirs)
    spots = F.flatten(F.transform(F.array_distinct(F.transform("_theirs", lambda x: F.greatest(x, F.col("_own")))), cells))
    return own.withColumn("_spot", F.explode(spots)).select(*[F.col(f"`{c}`") for c in df.columns], "_own", "_spot.*")


def range_join(left: DataFrame, right: DataFrame, keys: list[str], lo: tuple[str, str], hi: tuple[str, str], width: int, how: str = "inner", short: bool = False) -> DataFrame:
    """Rows whose closed intervals [lo, hi] intersect, equal in keys.

    Both sides are dealt to cells, which makes the join an equi-join: a long file isn't compared line by line. Cells have levels, from
    `width` up in steps of 2^STEP; an interval lies in two cells at most of its level or a higher one. A pair meets at the level of
    its longer interval, so short rows go to higher levels only if the other side has any, and however long an interval is, it takes
    two rows a level. A pair is kept only in the cell of the later start, so it comes once.
    Columns other than keys must differ. how: inner, left_semi or left_anti. short: intervals are known to be about `width` long at most;
    levels then aren't asked for, and all cells are of the first one, longer intervals in more of them.
    """
    meet = (F.col(lo[0]) <= F.col(hi[1])) & (F.col(lo[1]) <= F.col(hi[0])) & (F.col("_level") == F.greatest("_own", "_other"))
    spot = [*keys, "_level", "_bucket"]
    ask = lambda df, k: None if short else _levels(df, lo[k], hi[k], width)
    b = _dealt(right, lo[1], hi[1], width, ask(left, 0)).withColumnRenamed("_own", "_other")
    ours = ask(right, 1)
    if how == "inner":
        once = F.floor(F.greatest(lo[0], lo[1]) / F.call_function("shiftleft", F.lit(width).cast("long"), F.col("_level") * STEP)) == F.col("_bucket")
        return _dealt(left, lo[0], hi[0], width, ours).join(b, spot).where(meet & once).drop("_level", "_bucket", "_own", "_other")
    # semi and anti: a left row may meet many, so it is asked in its cells and answered once, by a row id that is made before
    a = left.withColumn("_row", F.struct(*[F.col(c) for c in left.columns]))
    hit = _dealt(a, lo[0], hi[0], width, ours).join(b, spot).where(meet).select("_row").distinct()
    return a.join(hit, a["_row"].eqNullSafe(hit["_row"]), how).select(left.columns)


def least_cover(points: DataFrame, intervals: DataFrame, keys: list[str], point: str, lo: str, hi: str, value: str) -> DataFrame:
    """keys, point, value: for each point that closed intervals of its keys cover, the least value of these.

    An interval is cut into the fewest dyadic cells, at most two a level, and a cell keeps its least value; a point asks one cell of each
    level up to that of the longest interval. However many intervals overlap, no pairs are made. Points and bounds are whole numbers.
    """
    at = lambda c, k: F.floor(c / F.call_function("shiftleft", F.lit(1).cast("long"), k))

    def cells(k: Column) -> Column:
        begin, end = -at(-F.col(lo), k), at(F.col(hi) + 1, k)
        one = lambda x, odd: F.when((begin < end) & (F.pmod(odd, F.lit(2)) == 1), F.struct(k.alias("_level"), x.alias("_cell")))
        return F.array(one(begin, begin), one(end - 1, end))

    bits = F.length(F.bin((F.col(hi) - F.col(lo) + 1).cast("long")))
    spots = F.array_distinct(F.array_compact(F.flatten(F.transform(F.sequence(F.lit(0), bits), cells))))
    held = intervals.where(F.col(lo) <= F.col(hi)).select(*keys, value, F.explode(spots).alias("_s")).groupBy(*keys, "_s._level", "_s._cell").agg(F.min(value).alias(value))
    longest = intervals.agg(F.max(bits)).scalar()
    asked = points.select(*keys, point).distinct().withColumn("_level", F.explode(F.sequence(F.lit(0), F.coalesce(longest, F.lit(0))))).withColumn("_cell", at(F.col(point), F.col("_level")))
    return asked.join(held, [*keys, "_level", "_cell"]).groupBy(*keys, point).agg(F.min(value).alias(value))


def first_by(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """The first row of each key in the given order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def first_n(df: DataFrame, keys: list[str], order: list[Column | str], n: int, rank: str | None = None) -> DataFrame:
    """The first n rows of each key; their rank stays if named."""
    name = rank or "_n"
    out = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(name) <= n)
    return out if rank else out.drop(name)


def as_of(df: DataFrame, keys: list[str], order: list[str], is_def: Column, value: Column, out: str) -> DataFrame:
    """For each row the value of the last defining row before it, in order, within keys. One window, no join."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(out, F.last(F.when(is_def, value), ignorenulls=True).over(w))
