"""The operators on the driver's tables: findings are rule hits on documents' lines, labels are the labels table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlake.operators import rules as R
from reviewlake.operators import scoring as S

#: A small rule set that Java and RE2 read alike: id, severity, confidence, pattern.
TEXT_RULES = [
    ("email", "high", 0.72, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z0-9.-]+"),
    ("key-token", "critical", 0.90, r"AKIA[0-9A-Z]{16}"),
    ("licence", "low", 0.40, r"Licensed under|License, Version|Public License"),
    ("ipv4", "medium", 0.58, r"\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b"),
    ("phone", "medium", 0.66, r"\+[0-9] \([0-9]{3}\) [0-9]{3}-[0-9]{4}"),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def doc_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, line_no (from 0), line."""
    return table(spark, sf_dir, "documents").select("doc_id", "lang", "source", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


def text_rules(spark: SparkSession) -> DataFrame:
    return R.rule_table([R.pack(spark, [{"rule_id": r, "severity": s, "confidence": c, "pattern": p, "title": r, "recommended_validation": []} for r, s, c, p in TEXT_RULES], "text")])


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line and rule that meet: one pass over the lines, all patterns as literals."""
    lines = doc_lines(spark, sf_dir).withColumns({"text_kept": F.col("line"), "text_code": F.col("line")})
    return R.rule_scan(lines, text_rules(spark)).drop("text_kept", "text_code")


_kept: dict[tuple[str, str], DataFrame] = {}


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The findings, which many operators of one query use: scanned once and kept in memory or on disk."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _kept or not _kept[key].storageLevel.useMemory:
        _kept[key] = _findings(spark, sf_dir).persist()
    return _kept[key]


def _findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """suite (lang), case_id (document), seq, rule_id, severity, confidence, file_path (source), start_line, end_line; first of equal lines."""
    h = hits(spark, sf_dir).withColumns({"text_key": F.trim("line"), "window_id": F.col("line_no"), "is_regex": F.lit(1), "file_path": F.col("source"), "review_id": F.col("doc_id")})
    first = R.dedupe_findings(h)
    meta = text_rules(spark).select("rule_id", "severity", "confidence")
    return first.join(meta, "rule_id").select(
        F.col("lang").alias("suite"), F.col("doc_id").cast("string").alias("case_id"), (F.col("line_no") * 10 + F.col("rule_ord")).alias("seq"), "rule_id", "severity", "confidence",
        "file_path", (F.col("line_no") + 1).alias("start_line"), (F.col("line_no") + 1).alias("end_line"), F.concat("rule_id", F.lit("@"), F.col("doc_id").cast("string"), F.lit(":"), (F.col("line_no") + 1).cast("string")).alias("finding_id"),
    )


def expected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of labelled documents: the rule by the id, the role by quality and toxicity, some with severity, path or lines."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    x = table(spark, sf_dir, "labels").join(docs, "doc_id")
    k = F.col("doc_id") % 5
    rule = F.element_at(F.array(*[F.lit(r[0]) for r in TEXT_RULES]), (k + 1).cast("int"))
    severity = F.element_at(F.array(*[F.lit(r[1]) for r in TEXT_RULES]), (k + 1).cast("int"))
    role = F.when(F.col("toxic") == 1, "primary").when(F.col("quality") == 0, "supporting").when(F.col("doc_id") % 3 == 0, "benign").otherwise("negative-control")
    part = lambda n, v: F.when(F.col("doc_id") % n == 0, v)
    return x.select(
        F.col("lang").alias("suite"), F.col("doc_id").cast("string").alias("case_id"), F.lit(0).alias("exp_idx"), rule.alias("rule_id"), part(7, F.col("source")).alias("file_path"),
        part(4, F.lit(1)).alias("start_line"), part(4, F.lit(5)).alias("end_line"), part(2, severity).alias("severity"), role.alias("role"),
    )


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One case a document: found and expected rules, counters and a status; every eleventh is an error."""
    docs = table(spark, sf_dir, "documents")
    f = findings(spark, sf_dir).groupBy("case_id").agg(F.count(F.lit(1)).alias("finding_count"), F.collect_list("rule_id").alias("found_rules"), F.round(F.avg(F.col("confidence").cast("decimal(8,4)")), 2).cast("double").alias("avg_confidence"))
    e = expected(spark, sf_dir).groupBy("case_id").agg(F.collect_list("rule_id").alias("expected_rules"))
    c = docs.select(F.col("lang").alias("suite"), F.col("doc_id").cast("string").alias("case_id"), "source", (F.col("doc_id") % 4).alias("validation_step_count"), F.floor((F.col("doc_id") % 4) / 2).alias("validation_covered"), (F.col("doc_id") % 2).alias("tool_supported_findings"), (F.col("doc_id") % 3).alias("validation_gap_findings"), F.when(F.col("doc_id") % 11 == 0, "error").otherwise("completed").alias("status"), F.when(F.col("doc_id") % 6 == 0, "CVE").alias("cve"), F.when(F.col("doc_id") % 10 == 0, "").alias("advisory"), F.lit(None).cast("string").alias("upstream_pr"), F.lit("").alias("error"))
    c = c.join(f, "case_id", "left").join(e, "case_id", "left")
    return c.withColumns({"finding_count": F.coalesce("finding_count", F.lit(0)), "avg_confidence": F.coalesce("avg_confidence", F.lit(0.0)), "verification_count": F.lit(2), "verification_passed": F.when(F.col("validation_step_count") == 3, 1).otherwise(2)})


def summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = ("suite", "case_id")
    f, e = findings(spark, sf_dir), expected(spark, sf_dir)
    return S.suite_summary(cases(spark, sf_dir), S.label_findings(f, e, keys), S.expected_hits_misses(f, e, keys))


def intervals(spark: SparkSession, sf_dir: str, flag: str | None = None) -> DataFrame:
    """review_id (supplier), lo, hi of line items' ranges [l_partkey, l_partkey + l_quantity]."""
    x = table(spark, sf_dir, "lineitem")
    x = x.where(F.col("l_returnflag") == flag) if flag else x
    return x.select(F.col("l_suppkey").alias("review_id"), F.col("l_partkey").cast("long").alias("lo"), (F.col("l_partkey") + F.col("l_quantity")).cast("long").alias("hi"))


def event_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as lines of a file for each user: review_id 0, file_path, seq, new_line by time, change_type add for errors."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    x = table(spark, sf_dir, "events").withColumn("new_line", F.row_number().over(w))
    kind = F.when(F.col("event_type") == "error", "add").otherwise("context")
    return x.select(F.col("user_id").alias("review_id"), F.lit("f").alias("file_path"), F.col("new_line").alias("seq"), F.lit(None).cast("int").alias("old_line"), "new_line", F.col("event_type").alias("content"), kind.alias("change_type"), "event_id", "ts")
