"""Findings against labels: matches, roles, metrics of cases and suites, scanner results, system matrix, claims."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewlake.functions.columns import accepted_rate, case_id_slug, coverage_rate, filled, normalize_path, safe_div, weighted_avg
from reviewlake.operators.joins import first_by

# Roles by priority, and scanners' names for severities and rules.
ROLES = ["negative-control", "primary", "supporting", "benign"]
SEVERITY_MAP = {"warning": "medium", "error": "high", "note": "low"}
RULE_MAP = {
    "python.lang.security.audit.subprocess-shell-true": "py-shell-true",
    "python.lang.security.audit.subprocess-shell-true.subprocess-shell-true": "py-shell-true",
    "python.lang.security.deserialization.pyyaml-load": "py-unsafe-yaml",
    "python.lang.security.audit.insecure-hash-algorithms": "weak-hash",
    "python.lang.security.audit.eval-exec": "py-eval-exec",
    "python.lang.security.audit.redos": "py-regex-redos-hardening",
    "py/command-line-injection": "py-shell-true",
}
CASE_COUNTERS = [
    "finding_count", "verification_count", "verification_passed", "required_failure_count", "validation_step_count", "validation_covered", "validation_missing",
    "tool_finding_count", "tool_artifact_count", "tool_supported_findings", "validation_gap_findings", "scanner_dampened_findings", "policy_blocked_count", "policy_warning_count",
]


def match_expected(findings: DataFrame, expected: DataFrame, keys: tuple[str, ...] = ("case_id",)) -> DataFrame:
    """Pairs of finding and label: equal in keys and rule, and in severity, path and lines where the label has them.

    findings: keys, seq, rule_id, file_path, start_line, end_line, severity. expected: keys, exp_idx, rule_id and the same with nulls.
    """
    e = expected.select(*keys, "exp_idx", "rule_id", *[F.col(c).alias(f"e_{c}") for c in ("file_path", "start_line", "end_line", "severity", "role")])
    free = lambda c, test: c.isNull() | test
    last = F.coalesce("end_line", "start_line")
    e_last = F.coalesce(F.nullif("e_end_line", F.lit(0)), "e_start_line")
    ok = (
        free(filled("e_severity"), F.col("severity") == F.col("e_severity"))
        & free(filled("e_file_path"), normalize_path("file_path") == normalize_path("e_file_path"))
        & free(F.col("e_start_line"), (F.col("start_line") <= e_last) & (F.col("e_start_line") <= last))
    )
    return findings.join(e, [*keys, "rule_id"]).where(ok)


def expected_hits_misses(findings: DataFrame, expected: DataFrame, keys: tuple[str, ...] = ("case_id",)) -> DataFrame:
    """Each label that is no negative control, with hit: whether any finding matches it."""
    hits = match_expected(findings, expected, keys).select(*keys, "exp_idx").distinct().withColumn("_hit", F.lit(True))
    wanted = expected.where(F.coalesce("role", F.lit("primary")) != "negative-control")
    return wanted.join(hits, [*keys, "exp_idx"], "left").withColumn("hit", F.col("_hit").isNotNull()).drop("_hit")


def taxonomy(role: Column, path: Column) -> Column:
    """What kind a finding is that no wanted label explains."""
    p = normalize_path(path)
    test = F.startswith(p, F.lit("test")) | F.contains(p, F.lit("/test"))
    return (
        F.when(role == "negative-control", "negative-control-violation").when(role != "unexpected", "expected").when(F.coalesce(test, F.lit(False)), "test-only-unlabeled").otherwise("unlabeled-rule-or-location")
    )


def label_findings(findings: DataFrame, expected: DataFrame, keys: tuple[str, ...] = ("case_id",)) -> DataFrame:
    """findings with matched_idx, role and taxonomy: the matching label of the first role by priority, then the first label."""
    priority = reduce(lambda a, r: F.when(F.col("e_role") == r[1], r[0]).otherwise(a), enumerate(ROLES), F.lit(99))
    best = first_by(match_expected(findings, expected, keys).withColumn("_p", priority), [*keys, "seq"], ["_p", "exp_idx"])
    best = best.select(*keys, "seq", F.col("exp_idx").alias("matched_idx"), F.col("e_role").alias("role"))
    out = findings.drop("role").join(best, [*keys, "seq"], "left").withColumn("role", F.coalesce("role", F.lit("unexpected")))
    return out.withColumn("taxonomy", taxonomy(F.col("role"), F.col("file_path")))


def role_counts(labels: DataFrame, keys: tuple[str, ...] = ("case_id",)) -> DataFrame:
    return labels.groupBy(*keys, "role").agg(F.count(F.lit(1)).alias("n"))


def unexpected_taxonomy(labels: DataFrame, keys: tuple[str, ...] = ("case_id",)) -> DataFrame:
    return labels.where(~F.col("role").isin("primary", "supporting", "benign")).groupBy(*keys, "taxonomy").agg(F.count(F.lit(1)).alias("n"))


def rule_set_diff(cases: DataFrame) -> DataFrame:
    """cases (expected_rules, found_rules as arrays) with hits, misses, unexpected rules and distinct found rules; repeats of expected rules stay."""
    empty = F.array().cast("array<string>")
    e, f = F.coalesce("expected_rules", empty), F.coalesce("found_rules", empty)
    return cases.withColumns({
        "expected_rule_hits": F.filter(e, lambda r: F.array_contains(f, r)), "expected_rule_misses": F.filter(e, lambda r: ~F.array_contains(f, r)),
        "unexpected_rules": F.when(F.size(e) > 0, F.array_sort(F.array_except(f, e))).otherwise(empty), "found_rule_set": F.array_sort(F.array_distinct(f)),
    })


def case_metrics(summary: DataFrame, keys: tuple[str, ...] = ("case_id",)) -> DataFrame:
    """The counters carried for each case, 0 where the summary has none."""
    have = set(summary.columns)
    required = F.size("required_failures") if "required_failures" in have else F.lit(0)
    pick = lambda c: F.coalesce(required, F.lit(0)) if c == "required_failure_count" and c not in have else (F.coalesce(F.col(c), F.lit(0)) if c in have else F.lit(0))
    return summary.select(*keys, *[pick(c).cast("long").alias(c) for c in CASE_COUNTERS], (F.coalesce("avg_confidence", F.lit(0.0)) if "avg_confidence" in have else F.lit(0.0)).alias("avg_confidence"))


def suite_summary(cases: DataFrame, labels: DataFrame, outcomes: DataFrame, suite: str = "suite", key: str = "case_id") -> DataFrame:
    """One row a suite: ratios of summed counts over completed and resumed cases.

    cases: suite, case_id, status, the counters, expected_rules, found_rules, and cve, advisory, upstream_pr if there. labels: of
    label_findings. outcomes: of expected_hits_misses. Recalls are null where there is nothing to recall.
    """
    done = F.col("status").isin("completed", "resumed")
    ruled = rule_set_diff(cases)
    have = set(cases.columns)
    n = lambda c: F.coalesce(F.sum(F.when(done, F.col(c))), F.lit(0)).alias(c)
    with_rules = done & (F.size(F.coalesce("expected_rules", F.array().cast("array<string>"))) > 0)
    some = [filled(F.col(c)).isNotNull() for c in ("cve", "advisory", "upstream_pr") if c in have]
    advisory = reduce(lambda a, b: a | b, some, F.lit(False))
    by_case = ruled.groupBy(suite).agg(
        F.count(F.lit(1)).alias("case_count"), F.count_if(done).alias("completed_count"), F.count_if(~done).alias("error_count"), F.count_if(advisory).alias("security_advisory_case_count"),
        *[n(c) for c in CASE_COUNTERS if c in have], weighted_avg(F.when(done, F.col("avg_confidence")), F.when(done, F.col("finding_count"))).alias("avg_confidence"),
        F.count_if(with_rules).alias("_ruled"), F.sum(F.when(with_rules, F.size("expected_rule_hits"))).alias("_rule_hits"),
        F.sum(F.when(with_rules, F.size("expected_rules"))).alias("_rules"), F.sum(F.when(with_rules, F.size("found_rule_set"))).alias("_found"),
    )
    live = cases.where(done).select(suite, key)
    role = lambda r: F.count_if(F.col("role") == r).alias(f"{r.replace('-', '_')}_count")
    by_label = labels.join(live, [suite, key], "left_semi").groupBy(suite).agg(*[role(r) for r in [*ROLES, "unexpected"]])
    primary = F.coalesce("role", F.lit("primary")) == "primary"
    by_outcome = outcomes.join(live, [suite, key], "left_semi").groupBy(suite).agg(
        F.count(F.lit(1)).alias("_wanted"), F.count_if("hit").alias("_hits"), F.count_if(primary).alias("_primaries"), F.count_if(primary & F.col("hit")).alias("_primary_hits")
    )
    s = by_case.join(by_label, suite, "left").join(by_outcome, suite, "left")
    null_or = lambda a, b: F.when(F.coalesce(F.col(b), F.lit(0)) > 0, safe_div(a, b))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    accepted = zero("primary_count") + zero("supporting_count") + zero("benign_count")
    counter = lambda c: zero(c) if c in have else F.lit(0)
    return s.select(
        suite, "case_count", "completed_count", "error_count", "security_advisory_case_count", *[zero(c).alias(c) for c in CASE_COUNTERS if c in have], "avg_confidence",
        accepted_rate(accepted, "finding_count").alias("accepted_finding_rate"), safe_div("primary_count", "finding_count").alias("primary_precision"),
        null_or("_primary_hits", "_primaries").alias("primary_finding_recall"), safe_div("supporting_count", "finding_count").alias("supporting_evidence_rate"),
        safe_div("unexpected_count", "finding_count").alias("unexpected_finding_rate"), zero("negative_control_count").alias("negative_control_violation_count"),
        safe_div("finding_count", "completed_count").alias("avg_findings_per_case"),
        coverage_rate(counter("validation_covered"), counter("validation_step_count"), "finding_count").alias("validation_coverage_rate"),
        safe_div(counter("tool_supported_findings"), "finding_count").alias("tool_evidence_rate"), safe_div(counter("validation_gap_findings"), "finding_count").alias("validation_gap_rate"),
        F.when(F.col("_ruled") > 0, safe_div("_rule_hits", "_rules")).alias("expected_rule_recall"), F.when(F.col("_ruled") > 0, safe_div("_rule_hits", "_found")).alias("expected_rule_precision"),
        null_or("_hits", "_wanted").alias("expected_finding_recall"),
    )


def tag_counts(cases: DataFrame, suite: str = "suite", tags: str = "tags") -> DataFrame:
    return cases.select(suite, F.explode(tags).alias("tag")).groupBy(suite, "tag").agg(F.count(F.lit(1)).alias("n"))


def sum_maps(df: DataFrame, keys: list[str], counts: str) -> DataFrame:
    """Key-wise sum of maps of counts, in long form."""
    return df.select(*keys, F.explode(counts).alias("name", "n")).groupBy(*keys, "name").agg(F.sum("n").alias("n"))


def advisory_case_count(cases: DataFrame, columns: list[str]) -> Column:
    """Aggregate: cases with any of the columns filled."""
    return F.count_if(reduce(lambda a, b: a | b, [filled(F.col(c).cast("string")).isNotNull() for c in columns]))


def resume(cases: DataFrame, done: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Cases still to run, and stored results with status 'resumed'."""
    return cases.join(done.select(*keys), keys, "left_anti"), done.join(cases.select(*keys), keys, "left_semi").withColumn("status", F.lit("resumed"))


def case_errors(cases: DataFrame, reviews: DataFrame, key: str = "case_id") -> DataFrame:
    """cases with status and error: a case whose diff can't be read, or without a review, is an error and the rest go on."""
    why = F.when(filled("diff").isNull() & filled("diff_url").isNull(), "no diff").when(F.col("_reviewed").isNull(), "review failed")
    out = cases.join(reviews.select(key).distinct().withColumn("_reviewed", F.lit(True)), key, "left").withColumn("error", why)
    return out.withColumn("status", F.when(F.col("error").isNull(), "completed").otherwise("error")).drop("_reviewed")


def map_rules(findings: DataFrame, rule_maps: DataFrame, severity_maps: DataFrame, key: str = "case_id") -> DataFrame:
    """Scanner rules and severities by their canonical names; a case's map goes before the manifest's, that before the defaults.

    rule_maps, severity_maps: case_id (null: the manifest's), name, canonical. Unmapped names stay. finding_id is '{case}:scanner:{n}'.
    """
    spark = findings.sparkSession

    def mapped(df: DataFrame, column: Column, maps: DataFrame, defaults: dict[str, str], out: str) -> DataFrame:
        own = maps.where(F.col(key).isNotNull()).select(key, F.col("name").alias("_name"), F.col("canonical").alias("_own"))
        rest = maps.where(F.col(key).isNull()).select(F.col("name").alias("_name"), F.col("canonical").alias("_all"))
        base = spark.createDataFrame(list(defaults.items()), "_name string, _base string")
        df = df.withColumn("_name", column)
        df = df.join(own, [key, "_name"], "left").join(rest, "_name", "left").join(F.broadcast(base), "_name", "left")
        return df.withColumn(out, F.coalesce("_own", "_all", "_base", "_name")).drop("_name", "_own", "_all", "_base")

    df = findings.withColumn("scanner_rule_id", F.col("rule_id"))
    df = mapped(df, F.col("scanner_rule_id"), rule_maps, RULE_MAP, "rule_id")
    df = mapped(df, F.lower("severity"), severity_maps, SEVERITY_MAP, "severity")
    return df.withColumn("finding_id", F.concat(case_id_slug(key), F.lit(":scanner:"), F.col("seq").cast("string")))


def score_scanner(cases: DataFrame, findings: DataFrame, expected: DataFrame, ranges: DataFrame, rule_maps: DataFrame, severity_maps: DataFrame, suite: str = "suite") -> DataFrame:
    """A scanner's findings scored like our own, within the diff's scope: suite_summary with raw, out-of-scope, skipped and error counts."""
    from reviewlake.operators.lines import split_in_scope

    scoped = split_in_scope(map_rules(findings, rule_maps, severity_maps), ranges, "case_id")
    keys = (suite, "case_id")
    scoped = scoped.join(cases.select(*keys), "case_id")
    inside = scoped.where("in_scope")
    counts = scoped.groupBy(*keys).agg(F.count_if("in_scope").alias("finding_count"), F.count(F.lit(1)).alias("tool_finding_count"), F.count_if(~F.col("in_scope")).alias("out_of_scope"), F.collect_list(F.when(F.col("in_scope"), F.col("rule_id"))).alias("found_rules"))
    per = cases.join(counts, list(keys), "left").withColumn("avg_confidence", F.lit(0.0)).withColumn("tool_supported_findings", F.coalesce("finding_count", F.lit(0)))
    per = per.withColumn("finding_count", F.coalesce("finding_count", F.lit(0)))
    summary = suite_summary(per, label_findings(inside, expected, keys), expected_hits_misses(inside, expected, keys), suite)
    extra = per.groupBy(suite).agg(
        F.coalesce(F.sum("tool_finding_count"), F.lit(0)).alias("raw_tool_finding_count"), F.coalesce(F.sum("out_of_scope"), F.lit(0)).alias("out_of_scope_finding_count"),
        F.count_if(F.col("status") == "skipped").alias("skipped_count"), F.count_if(F.col("status") == "error").alias("scanner_error_count"),
    )
    return summary.join(extra, suite)


MATRIX = ["primary_finding_recall", "primary_precision", "finding_count", "validation_coverage_rate", "tool_evidence_rate"]


def benchmark_matrix(systems: DataFrame, sources: DataFrame) -> DataFrame:
    """One row a system: metrics of its positive source, violations of its negative one, and a status that a display override can only demote.

    systems: label, suite, baseline, negative_suite, negative_baseline, display_status. sources: name, kind ('suite' or 'baseline'), status,
    the metrics and negative_control_violation_count.
    """
    pick = lambda a, b: F.coalesce(filled(a), filled(b))
    s = systems.withColumns({"_pos": pick("suite", "baseline"), "_pos_kind": F.when(filled("suite").isNotNull(), "suite").otherwise("baseline"), "_neg": pick("negative_suite", "negative_baseline"), "_neg_kind": F.when(filled("negative_suite").isNotNull(), "suite").otherwise("baseline")})
    pos = sources.select(F.col("name").alias("_pos"), F.col("kind").alias("_pos_kind"), F.col("status").alias("_status"), *MATRIX)
    neg = sources.select(F.col("name").alias("_neg"), F.col("kind").alias("_neg_kind"), F.col("status").alias("_neg_status"), F.col("negative_control_violation_count").alias("_violations"))
    out = s.join(pos, ["_pos", "_pos_kind"], "left").join(neg, ["_neg", "_neg_kind"], "left")
    status = F.coalesce("_status", F.lit("not-run"))
    shown = F.when((status == "measured") & filled("display_status").isNotNull(), F.col("display_status")).otherwise(status)
    out = out.withColumn("status", shown)
    ok = F.col("status") == "measured"
    return out.select("label", "status", *[F.when(ok, F.col(c)).alias(c) for c in MATRIX], F.when(ok & (F.col("_neg_status") == "measured"), F.col("_violations")).alias("negative_control_violations"))


def resolve_claims(templates: DataFrame, metrics: DataFrame) -> DataFrame:
    """templates (claim_id, template) with text: each {system:metric} replaced by its value; errors names those without one.

    metrics: system, metric, value (string).
    """
    asked = templates.select("claim_id", "template", F.explode_outer(F.array_distinct(F.regexp_extract_all("template", F.lit(r"\{([^{}:]+:[^{}:]+)\}"), F.lit(1)))).alias("ask"))
    asked = asked.withColumns({"system": F.substring_index("ask", ":", 1), "metric": F.substring_index("ask", ":", -1)})
    known = metrics.select("system").distinct().withColumn("_system", F.lit(True))
    got = asked.join(metrics.withColumn("_metric", F.lit(True)), ["system", "metric"], "left").join(known, "system", "left")
    why = F.when(F.col("ask").isNull(), None).when(F.col("_system").isNull(), "unknown system").when(F.col("_metric").isNull(), "unknown metric").when(F.col("value").isNull(), "null value")
    got = got.withColumn("_error", F.when(why.isNotNull(), F.concat("ask", F.lit(": "), why)))
    per = got.groupBy("claim_id", "template").agg(
        F.array_sort(F.collect_list(F.when(F.col("value").isNotNull(), F.struct("ask", "value")))).alias("pairs"), F.array_sort(F.collect_list("_error")).alias("errors")
    )
    text = F.aggregate("pairs", F.col("template"), lambda t, p: F.replace(t, F.concat(F.lit("{"), p["ask"], F.lit("}")), p["value"]))
    return per.select("claim_id", text.alias("text"), "errors")
