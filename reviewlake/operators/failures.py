"""Why labels were missed and findings weren't wanted."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewlake.functions.columns import filled
from reviewlake.operators.joins import first_by


def classify_misses(misses: DataFrame, unexpected: DataFrame, key: str = "case_id") -> DataFrame:
    """key, exp_idx, category, expected_rule_id, expected_file_path, actual_rule_id, actual_finding_id of every missed label.

    The first unexpected finding in the same file speaks for confusion if its rule differs; else the first of the same rule for a wrong
    place. Paths are compared as they are. unexpected: key, seq, finding_id, rule_id, file_path.
    """
    m = misses.select(key, "exp_idx", F.col("rule_id").alias("expected_rule_id"), filled("file_path").alias("expected_file_path"))
    one = lambda keys: first_by(unexpected, keys, ["seq"])
    by_file = one([key, "file_path"]).select(key, F.col("file_path").alias("expected_file_path"), F.col("rule_id").alias("file_rule"), F.col("finding_id").alias("file_id"))
    by_rule = one([key, "rule_id"]).select(key, F.col("rule_id").alias("expected_rule_id"), F.col("finding_id").alias("rule_finding"))
    j = m.join(by_file, [key, "expected_file_path"], "left").join(by_rule, [key, "expected_rule_id"], "left")
    confused = F.col("file_id").isNotNull() & (F.col("file_rule") != F.col("expected_rule_id"))
    category = (
        F.when(confused, "semantic-rule-confusion").when(F.col("rule_finding").isNotNull(), "rule-location-mismatch")
        .when(F.col("expected_file_path").isNotNull(), "undetected-labeled-location").otherwise("undetected-expected-finding")
    )
    return j.select(
        key, "exp_idx", category.alias("category"), "expected_rule_id", "expected_file_path",
        F.when(confused, F.col("file_rule")).when(F.col("rule_finding").isNotNull(), F.col("expected_rule_id")).alias("actual_rule_id"),
        F.when(confused, F.col("file_id")).otherwise(F.col("rule_finding")).alias("actual_finding_id"),
    )


def unexplained_findings(unexpected: DataFrame, classified: DataFrame, key: str = "case_id") -> DataFrame:
    """Unexpected findings that explain no miss."""
    used = classified.select(key, F.col("actual_finding_id").alias("finding_id")).where("finding_id is not null").distinct()
    return unexpected.join(used, [key, "finding_id"], "left_anti").withColumn("category", F.lit("unexpected-finding"))


def execution_errors(cases: DataFrame, key: str = "case_id") -> DataFrame:
    return cases.where(F.col("status") == "error").select(key, F.lit("execution-error").alias("category"), F.coalesce(filled("error"), F.lit("unknown evaluation error")).alias("error"))


def failures(misses: DataFrame, unexpected: DataFrame, cases: DataFrame, key: str = "case_id") -> DataFrame:
    """All failures: key, category, expected_rule_id, actual_rule_id, actual_finding_id, verification_passed."""
    classified = classify_misses(misses, unexpected, key)
    a = classified.select(key, "category", "expected_rule_id", "actual_rule_id", "actual_finding_id")
    none = F.lit(None).cast("string")
    b = unexplained_findings(unexpected, classified, key).select(key, "category", none.alias("expected_rule_id"), F.col("rule_id").alias("actual_rule_id"), F.col("finding_id").alias("actual_finding_id"))
    c = execution_errors(cases, key).select(key, "category", none.alias("expected_rule_id"), none.alias("actual_rule_id"), none.alias("actual_finding_id"))
    passed = (F.coalesce("verification_count", F.lit(0)) > 0) & (F.col("verification_passed") == F.col("verification_count"))
    return a.unionByName(b).unionByName(c).join(cases.select(key, passed.alias("all_passed")), key, "left").withColumn("verification_passed", F.coalesce("all_passed", F.lit(False))).drop("all_passed")


def failure_summary(found: DataFrame, key: str = "case_id") -> tuple[DataFrame, DataFrame]:
    """Totals (cases_with_failures, failure_count, verified_failure_count), and counts by category."""
    totals = found.agg(F.count_distinct(key).alias("cases_with_failures"), F.count(F.lit(1)).alias("failure_count"), F.count_if("verification_passed").alias("verified_failure_count"))
    return totals, found.groupBy("category").agg(F.count(F.lit(1)).alias("n"))
