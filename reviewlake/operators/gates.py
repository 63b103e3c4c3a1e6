"""Gates over suite metrics, release tables, regressions and verdicts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Metrics of the gate with the words of its messages, those a release compares, and defaults.
GATE = {
    "validation_coverage_rate": "validation coverage", "tool_evidence_rate": "tool evidence rate", "avg_confidence": "average confidence",
    "accepted_finding_rate": "accepted finding rate", "primary_precision": "primary precision", "primary_finding_recall": "primary finding recall",
    "supporting_evidence_rate": "supporting evidence rate", "validation_gap_rate": "validation gap rate", "unexpected_finding_rate": "unexpected finding rate",
    "negative_control_violation_count": "negative-control violations", "required_failure_count": "required failures", "policy_blocked_count": "policy-blocked tools",
    "error_count": "errors", "critical_count": "critical findings", "high_count": "high findings", "finding_count": "findings",
}
DEFAULTS = [
    *[(m, "min", 0.0) for m in list(GATE)[:7]], ("validation_gap_rate", "max", 1.0), ("unexpected_finding_rate", "max", 1.0),
    *[(m, "max", 0.0) for m in ("negative_control_violation_count", "required_failure_count", "policy_blocked_count", "error_count")],
]
HIGHER = [
    "validation_coverage_rate", "accepted_finding_rate", "primary_precision", "primary_finding_recall", "supporting_evidence_rate", "expected_rule_recall",
    "expected_rule_precision", "expected_finding_recall", "tool_evidence_rate",
]
LOWER = ["error_count", "validation_gap_rate", "unexpected_finding_rate", "negative_control_violation_count", "required_failure_count", "policy_blocked_count", "policy_warning_count"]
RELEASE = [
    "case_count", "finding_count", "validation_coverage_rate", "accepted_finding_rate", "primary_precision", "primary_finding_recall", "supporting_evidence_rate",
    "unexpected_finding_rate", "negative_control_violation_count", "expected_rule_recall", "expected_finding_recall", "error_count", "validation_gap_rate",
    "required_failure_count", "policy_blocked_count", "policy_warning_count", "avg_confidence",
]


def long_metrics(wide: DataFrame, suite: str, metrics: list[str], zero: bool) -> DataFrame:
    """suite, metric, value of the metrics that the table has; nulls become 0.0, or go."""
    have = [m for m in metrics if m in wide.columns]
    cols = [F.coalesce(F.col(m).cast("double"), F.lit(0.0)).alias(m) if zero else F.col(m).cast("double").alias(m) for m in have]
    out = wide.select(suite, *cols).unpivot(suite, have, "metric", "value")
    return out if zero else out.where("value is not null")


def gate_metrics(summary: DataFrame, suite: str = "suite") -> DataFrame:
    """suite, metric, value for the gate. A null recall counts as 0.0, so a floor on it fails where there is nothing to recall."""
    return long_metrics(summary, suite, list(GATE), True)


def gate(metrics: DataFrame, thresholds: DataFrame, suite: str = "suite") -> DataFrame:
    """suite, passed, failures: messages of violated thresholds. thresholds: suite, metric, op (min or max), bound.

    A floor on average confidence is skipped where there are no findings. Thresholds on unknown metrics are refused, as a failure.
    """
    findings = metrics.where(F.col("metric") == "finding_count").select(suite, F.col("value").alias("_findings"))
    name = reduce(lambda a, m: F.when(F.col("metric") == m, GATE[m]).otherwise(a), GATE, F.col("metric"))
    j = thresholds.join(metrics, [suite, "metric"], "left").join(findings, suite, "left")
    vacuous = (F.col("metric") == "avg_confidence") & (F.coalesce("_findings", F.lit(0.0)) == 0)
    said = (
        F.when(~F.col("metric").isin(list(GATE)), F.concat(F.lit("unknown threshold "), "metric"))
        .when((F.col("op") == "min") & (F.col("value") < F.col("bound")) & ~vacuous, F.format_string("%s %.2f is below required minimum %.2f", name, "value", "bound"))
        .when((F.col("op") == "max") & (F.col("value") > F.col("bound")), F.format_string("%s %.2f exceeds allowed maximum %.2f", name, "value", "bound"))
    )
    by = j.withColumn("_said", said).groupBy(suite).agg(F.array_sort(F.collect_list("_said")).alias("failures"))
    return by.select(suite, (F.size("failures") == 0).alias("passed"), "failures")


def default_thresholds(suites: DataFrame, suite: str = "suite") -> DataFrame:
    rows = F.array(*[F.struct(F.lit(m).alias("metric"), F.lit(o).alias("op"), F.lit(b).alias("bound")) for m, o, b in DEFAULTS])
    return suites.select(suite, F.explode(rows).alias("t")).select(suite, "t.metric", "t.op", "t.bound")


def release_matrix(summary: DataFrame, gates: DataFrame, suite: str = "suite") -> tuple[DataFrame, DataFrame]:
    """Suites with their release metrics and gate flag, and totals."""
    have = [m for m in RELEASE if m in summary.columns]
    m = summary.select(suite, *have).join(gates.select(suite, F.col("passed").alias("gate_passed")), suite, "left")
    totals = m.agg(F.count(F.lit(1)).alias("suite_count"), F.sum("case_count").alias("total_cases"), F.sum("finding_count").alias("total_findings"), F.count("gate_passed").alias("gates_total"), F.count_if("gate_passed").alias("gates_passed"))
    return m, totals


def regressions(current: DataFrame, baseline: DataFrame, suite: str = "suite") -> DataFrame:
    """suite, metric, baseline, current: metrics that got worse, suites that are missing, gates that no longer pass. New suites are none.

    Both: suite, metric, value; a gate is metric 'gate_passed' with 1.0 or 0.0.
    """
    c = current.select(suite, "metric", F.col("value").alias("current"))
    b = baseline.select(suite, "metric", F.col("value").alias("baseline"))
    j = b.join(c, [suite, "metric"])
    worse = (F.col("metric").isin(HIGHER) & (F.col("current") < F.col("baseline"))) | (F.col("metric").isin(LOWER) & (F.col("current") > F.col("baseline")))
    worse = worse | ((F.col("metric") == "gate_passed") & (F.col("baseline") == 1) & (F.col("current") == 0))
    gone = b.select(suite).distinct().join(c.select(suite).distinct(), suite, "left_anti")
    return j.where(worse).select(suite, "metric", "baseline", "current").unionByName(gone.select(suite, F.lit("suite_presence").alias("metric"), F.lit(1.0).alias("baseline"), F.lit(0.0).alias("current")))


def portfolio_verdict(overlaps: DataFrame, audits: DataFrame, gates: DataFrame, worse: DataFrame, suite: str = "suite", fail_on_overlap: bool = True) -> DataFrame:
    """kind, subject of every failure of the whole; it has passed iff there is none."""
    parts = [
        overlaps.where(F.lit(fail_on_overlap)).select(F.lit("partition-overlap").alias("kind"), F.col(overlaps.columns[0]).cast("string").alias("subject")),
        audits.where(F.col("status") == "blocked").select(F.lit("case-audit").alias("kind"), F.col(suite).cast("string").alias("subject")),
        gates.where(~F.col("passed")).select(F.lit("gate").alias("kind"), F.col(suite).cast("string").alias("subject")),
        worse.select(F.lit("regression").alias("kind"), F.concat_ws(":", F.col(suite).cast("string"), "metric").alias("subject")),
    ]
    return reduce(DataFrame.unionByName, parts)


def table_freshness(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Rows that one of the tables has more often than the other, tagged by side; column order doesn't matter."""
    e, a = expected.select(sorted(expected.columns)), actual.select(sorted(actual.columns))
    return e.exceptAll(a).withColumn("side", F.lit("expected")).unionByName(a.exceptAll(e).withColumn("side", F.lit("actual")))
