"""Diffs as lines, evidence windows, source context and diff scope."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reviewlake.functions.columns import effective_line, normalize_path, paths_overlap, split_lines
from reviewlake.operators.joins import first_n, range_join

MAX_LINES, RADIUS, SAMPLES = 12, 8, 25
#: Ranges that a task merges.
MERGED = 1_000_000
#: Lines of a bucket by which findings meet scoped ranges.
BUCKET = 64
HUNK = r"^@@ -(\d+)(?:,\d+)? \+(\d+)(?:,\d+)? @@"


def changed_lines(diffs: DataFrame, key: str = "review_id", text: str = "diff_text") -> DataFrame:
    """key, seq, file_path, old_line, new_line, content, change_type: one row for each added, deleted or context line.

    One window over a review's lines carries the file, the hunk's first numbers and the counts at its header;
    a line's number is the hunk's first plus what has advanced since. Null diffs give no rows.
    """
    raw = diffs.select(key, F.posexplode(split_lines(text)).alias("seq", "raw"))
    w = Window.partitionBy(key).orderBy("seq")
    last = lambda c: F.last(c, ignorenulls=True).over(w)
    file = F.when(F.col("raw").rlike(r"^\+\+\+ b/."), F.substr("raw", F.lit(7)))
    hunk = F.col("raw").rlike(HUNK)
    number = lambda k: F.when(hunk, F.regexp_extract("raw", HUNK, k).cast("int"))
    state = raw.select(key, "seq", "raw", hunk.alias("is_hunk"), file.isNotNull().alias("is_file"), last(file).alias("file_path"), last(number(1)).alias("old0"), last(number(2)).alias("new0"))
    starts = lambda p: F.startswith("raw", F.lit(p))
    kind = F.when(starts("+") & ~starts("+++"), "add").when(starts("-") & ~starts("---"), "delete").when(starts(" ") | (F.col("raw") == ""), "context")
    live = ~F.col("is_hunk") & ~F.col("is_file") & F.col("file_path").isNotNull() & F.col("old0").isNotNull()
    state = state.withColumn("change_type", F.when(live, kind))
    moves = lambda *kinds: F.when(F.col("change_type").isin(*kinds), 1).otherwise(0)
    olds, news = F.sum(moves("delete", "context")).over(w), F.sum(moves("add", "context")).over(w)
    counted = state.withColumns({"olds": olds, "news": news})
    since = lambda c: F.col(c) - F.coalesce(last(F.when(F.col("is_hunk"), F.col(c))), F.lit(0))
    counted = counted.withColumns({"o": F.col("old0") + since("olds") - 1, "n": F.col("new0") + since("news") - 1}).where(F.col("change_type").isNotNull())
    content = F.when(F.col("raw") == "", "").otherwise(F.substr("raw", F.lit(2)))
    return counted.select(
        key, "seq", "file_path", F.when(F.col("change_type") != "add", F.col("o")).cast("int").alias("old_line"),
        F.when(F.col("change_type") != "delete", F.col("n")).cast("int").alias("new_line"), content.alias("content"), "change_type",
    )


def evidence_windows(lines: DataFrame, key: str = "review_id", max_lines: int = MAX_LINES, triggers: tuple[str, ...] = ("add", "delete")) -> DataFrame:
    """key, window_id (the trigger's seq), file_path, start_line, end_line, lines: what stands around each trigger.

    Members are the file's lines by effective number in the window's range, in diff order, max_lines at most. They come from a frame
    along the file, so a line is shuffled once, not once for each window that it stands in.
    """
    half = max_lines // 2
    line = F.struct("seq", "old_line", "new_line", "content", "change_type")
    near = Window.partitionBy(key, "file_path").orderBy(F.col("_line").cast("long")).rangeBetween(-half, half)
    seen = lines.withColumn("_line", effective_line("new_line", "old_line")).withColumn("_near", F.collect_list(line).over(near))
    t = seen.where(F.col("change_type").isin(*triggers) & F.col(key).isNotNull() & F.col("file_path").isNotNull() & F.col("_line").isNotNull())
    low = F.greatest(F.lit(1), F.col("_line") - half)
    members = F.filter("_near", lambda x: effective_line(x["new_line"], x["old_line"]) >= low)
    return t.select(
        key, F.col("seq").alias("window_id"), "file_path", low.alias("start_line"), (F.col("_line") + half).alias("end_line"),
        F.slice(F.sort_array(members), 1, max_lines).alias("lines"),
    ).where(F.size("lines") > 0)


def source_context(windows: DataFrame, source_lines: DataFrame, key: str = "review_id", radius: int = RADIUS) -> DataFrame:
    """key, window_id, available, rationale, start_line, end_line, lines (line_number, content, role) of the checkout around a window.

    source_lines: key, file_path, line_number, content; an empty file has one row of a null line number.
    """
    files = source_lines.groupBy(key, "file_path").agg(F.max("line_number").alias("n_lines"))
    w = windows.select(key, "window_id", "file_path", F.col("start_line").alias("w_start"), F.col("end_line").alias("w_end"), F.col("lines").alias("w_lines"))
    added = F.transform(F.filter("w_lines", lambda x: (x["change_type"] == "add") & x["new_line"].isNotNull()), lambda x: x["new_line"])
    w = w.join(files.withColumn("_known", F.lit(True)), [key, "file_path"], "left").withColumn("added", added)
    parts = F.filter(F.split(F.col("file_path"), "/"), lambda p: (p != "") & (p != "."))
    depth = F.aggregate(parts, F.struct(F.lit(0).alias("at"), F.lit(0).alias("low")), lambda a, p: F.struct(
        (a["at"] + F.when(p == "..", -1).otherwise(1)).alias("at"), F.least(a["low"], a["at"] + F.when(p == "..", -1).otherwise(1)).alias("low")), lambda a: a["low"])
    outside = (depth < 0) | F.startswith("file_path", F.lit("/"))
    why = (
        F.when(outside, "Skipped because the diff path resolves outside the repository.")
        .when(F.col("_known").isNull(), "Skipped because the changed file is not present in the repository.")
        .when(F.col("n_lines").isNull(), "Changed file is empty in the repository checkout.")
        .otherwise("Repository source context around the changed line range.")
    )
    w = w.withColumns({"rationale": why, "available": F.startswith(why, F.lit("Changed")) | F.startswith(why, F.lit("Repository"))})
    full = F.startswith("rationale", F.lit("Repository"))
    low = F.when(full, F.greatest(F.lit(1), F.col("w_start") - radius)).when(F.col("available"), 0).otherwise(F.col("w_start"))
    high = F.when(full, F.least("n_lines", F.col("w_end") + radius)).when(F.col("available"), 0).otherwise(F.col("w_end"))
    w = w.withColumns({"start_line": low, "end_line": high})
    spans = w.where(full & (F.col("start_line") <= F.col("end_line"))).select(key, "window_id", "file_path", "start_line", "end_line", "added")
    points = source_lines.where(F.col("line_number").isNotNull()).withColumn("_to", F.col("line_number"))
    near = range_join(spans, points, [key, "file_path"], ("start_line", "line_number"), ("end_line", "_to"), 2 * radius + MAX_LINES + 1, short=True)
    role = F.when(F.array_contains("added", F.col("line_number")), "changed").otherwise("context")
    got = near.groupBy(key, "window_id").agg(F.sort_array(F.collect_list(F.struct("line_number", "content", role.alias("role")))).alias("lines"))
    out = w.select(key, "window_id", "file_path", "available", "rationale", "start_line", "end_line").join(got, [key, "window_id"], "left")
    none = F.array().cast("array<struct<line_number:int,content:string,role:string>>")
    return out.withColumn("lines", F.coalesce("lines", none))


def merge_ranges(df: DataFrame, keys: list[str], lo: str, hi: str) -> DataFrame:
    """keys, lo, hi: the union of overlapping or adjacent ranges, by a running maximum and a running count of new islands.

    Tasks grow in number with the ranges, MERGED in each, so that what one sorts stays the same; ranges of one key are in one task.
    """
    spark = df.sparkSession
    df = df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // MERGED)), *keys)
    order = Window.partitionBy(*keys).orderBy(lo, hi)
    before = F.max(hi).over(order.rowsBetween(Window.unboundedPreceding, -1))
    flagged = df.withColumn("_new", F.when(before.isNull() | (F.col(lo) > before + 1), 1).otherwise(0))
    islands = flagged.withColumn("_island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return islands.groupBy(*keys, "_island").agg(F.min(lo).alias(lo), F.max(hi).alias(hi)).drop("_island")


def diff_scope(lines: DataFrame, key: str = "review_id", max_lines: int = MAX_LINES) -> tuple[DataFrame, DataFrame]:
    """Merged ranges (key, file_path, scope_start, scope_end), and by review changed_line_count, window_count, files."""
    half = max_lines // 2
    line = effective_line("new_line", "old_line")
    t = lines.where("change_type <> 'context'").select(key, normalize_path("file_path").alias("file_path"), F.greatest(F.lit(1), line - half).alias("scope_start"), (line + half).alias("scope_end"))
    counts = t.groupBy(key).agg(F.count(F.lit(1)).alias("changed_line_count"), F.count(F.lit(1)).alias("window_count"), F.array_sort(F.collect_set("file_path")).alias("files"))
    return merge_ranges(t, [key, "file_path"], "scope_start", "scope_end"), counts


def split_in_scope(findings: DataFrame, ranges: DataFrame, key: str = "review_id") -> DataFrame:
    """findings with in_scope: its path overlaps a scoped path and its lines meet one of that path's ranges. A review without ranges has all in scope.

    Overlapping paths have the same last part, so the join is on review and last part; the rest is its condition. Findings need a seq, their
    own in a review, or in a review and tool where they have a tool_name.
    """
    own = [key, *(["tool_name"] if "tool_name" in findings.columns else []), "seq"]
    tail = lambda p: F.element_at(F.split(normalize_path(p), "/"), -1)
    scoped = ranges.select(key, tail("file_path").alias("_tail"), F.col("file_path").alias("_path"), "scope_start", "scope_end")
    f = findings.select(*own, F.col("file_path").alias("_file"), tail("file_path").alias("_tail"), F.col("start_line").alias("_lo"), F.coalesce("end_line", "start_line").alias("_hi"))
    met = range_join(f.where("_lo > 0"), scoped, [key, "_tail"], ("_lo", "scope_start"), ("_hi", "scope_end"), BUCKET)
    hits = met.where(paths_overlap("_file", "_path")).select(own).distinct().withColumn("_hit", F.lit(True))
    known = ranges.select(key).distinct().withColumn("_scoped", F.lit(True))
    out = findings.join(hits, own, "left").join(known, key, "left")
    return out.withColumn("in_scope", F.col("_scoped").isNull() | F.col("_hit").isNotNull()).drop("_hit", "_scoped")


def finding_samples(findings: DataFrame, key: str = "review_id", n: int = SAMPLES) -> DataFrame:
    """The first n findings of each review, in input order."""
    return first_n(findings, [key], ["seq"], n, "sample")
