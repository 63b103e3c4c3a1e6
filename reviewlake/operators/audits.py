"""Audits of labelled cases: sources, labels, promotion and leakage between partitions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewlake.functions.columns import filled

# Roles, metadata that make a case a security advisory, and floors of evaluation evidence.
ROLES = ["primary", "supporting", "benign", "negative-control"]
SECURITY_KEYS = ["cve", "ghsa", "advisory", "upstream_pr", "upstream_commit", "advisory_url"]
FLOORS = {"validation_coverage": 1.0, "tool_evidence_rate": 1.0, "primary_precision": 0.5, "primary_finding_recall": 1.0, "expected_finding_recall": 1.0}


def text(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def messages(*pairs: tuple[Column, Column | str]) -> Column:
    """The messages whose tests hold, in order."""
    return F.array_compact(F.array(*[F.when(F.coalesce(t, F.lit(False)), m if isinstance(m, Column) else F.lit(m)) for t, m in pairs]))


def has(c: str) -> Column:
    return filled(F.col(c).cast("string")).isNotNull()


def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    """Keys seen more than once, and how often."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def source_status(cases: DataFrame, paths: DataFrame) -> DataFrame:
    """cases with source_kind, source_errors, source_warnings. paths: path, of all files and folders that exist."""
    there = paths.select("path").distinct()
    for c in ("diff", "repo"):
        cases = cases.join(there.select(F.col("path").alias(c), F.lit(True).alias(f"_{c}")), c, "left")
    repo, url = has("repo") | has("repo_url"), has("diff_url")
    pair, on_base = repo & has("base_ref") & has("head_ref"), repo & has("base_ref") & url
    kind = F.when(pair, "git-pair").when(on_base, "diff-url-on-base").when(url, "remote-diff").when(has("diff"), "local-diff").otherwise("missing")
    errors = messages(
        (~has("diff") & ~url & ~pair, "case must provide diff/diff_url or repo/repo_url with base_ref/head_ref"),
        (has("diff") & F.col("_diff").isNull(), text("diff path does not exist: ", F.col("diff"))), (has("repo") & F.col("_repo").isNull(), text("repo path does not exist: ", F.col("repo"))),
    )
    warnings = messages((kind == "remote-diff", "remote diff without base checkout limits source-context verification"))
    return cases.withColumns({"source_kind": kind, "source_errors": errors, "source_warnings": warnings}).drop("_diff", "_repo")


def label_status(cases: DataFrame, expected: DataFrame, keys: list[str]) -> DataFrame:
    """By case: label_summary, has_positive_label, has_negative_control, label_errors, label_warnings. expected: keys, exp_idx (from 0), rule_id, role, file_path, severity."""
    role = F.coalesce(filled("role"), F.lit("primary"))
    at = text("expected_findings[", (F.col("exp_idx") + 1).cast("string"), "]")
    e = expected.withColumn("_role", role).withColumn("_known", F.col("_role").isin(ROLES))
    positive = F.col("_role").isin("primary", "supporting")
    e = e.withColumn("_errors", messages((~F.col("_known"), text(at, " has unknown role: ", F.col("_role"))), (F.col("_known") & ~has("rule_id"), text(at, " is missing rule_id"))))
    e = e.withColumn("_warnings", messages((positive & ~has("file_path"), text(at, " should include file_path")), (positive & ~has("severity"), text(at, " should include severity"))))
    in_order = lambda c: F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("exp_idx", c))), lambda x: x[c]))
    per = e.groupBy(*keys).agg(
        F.bool_or(positive & F.col("_known")).alias("has_positive_label"), F.bool_or(F.col("_role") == "negative-control").alias("has_negative_control"),
        F.count_if(F.col("_role") == "primary").alias("_primary"), in_order("_errors").alias("label_errors"), in_order("_warnings").alias("_w"),
    )
    counts = e.where("_known").groupBy(*keys, "_role").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_list(text(F.col("_role"), ":", F.col("n").cast("string")))), ", ").alias("label_summary"))
    out = cases.select(*keys).join(per, keys, "left").join(counts, keys, "left")
    none = F.array().cast("array<string>")
    first = messages((F.col("_primary").isNull(), "expected_findings are missing; reviewer-noise metrics will be weak"))
    last = messages((F.coalesce("has_positive_label", F.lit(False)) & (F.col("_primary") == 0), "positive case has no primary expected finding"))
    return out.select(
        *keys, F.coalesce("label_summary", F.lit("unlabeled")).alias("label_summary"), F.coalesce("has_positive_label", F.lit(False)).alias("has_positive_label"),
        F.coalesce("has_negative_control", F.lit(False)).alias("has_negative_control"), F.coalesce("label_errors", none).alias("label_errors"), F.concat(first, F.coalesce("_w", none), last).alias("label_warnings"),
    )


def case_audit(cases: DataFrame, expected: DataFrame, paths: DataFrame, commands: DataFrame | None = None, suite: str = "suite", require_verification: bool = False) -> DataFrame:
    """One row a case: status (ready without errors, else blocked), errors, warnings, source_kind, label_summary, verification_status and flags.

    cases: suite, case_id (null or empty: missing), seq (place in its file), the source columns, config, tags, metadata (map). commands: config, n, of
    existing configurations.
    """
    meta = lambda k: filled(F.try_element_at("metadata", F.lit(k))).isNotNull()
    named = cases.withColumns({"_missing": ~has("case_id"), "case_id": F.coalesce(filled("case_id"), text("case-", F.col("seq").cast("string")))})
    keys = [suite, "case_id", "seq"]
    c = source_status(named, paths).withColumn("_times", F.count(F.lit(1)).over(Window.partitionBy(suite, "case_id")))
    c = c.join(label_status(named, expected, [suite, "case_id"]).dropDuplicates([suite, "case_id"]), [suite, "case_id"])
    if commands is not None:
        c = c.join(commands.select("config", F.col("n").alias("_commands")), "config", "left")
    else:
        c = c.withColumn("_commands", F.lit(None).cast("int"))
    advisory = reduce(lambda a, b: a | b, [meta(k) for k in SECURITY_KEYS])
    tags = F.coalesce("tags", F.array().cast("array<string>"))
    positive, negative = F.col("has_positive_label"), F.col("has_negative_control")
    errors = F.concat(messages((F.col("_missing"), "case id is missing"), (F.col("_times") > 1, "case id is duplicated")), "source_errors", "label_errors")
    more = messages(
        (~meta("project"), "metadata.project is missing"), (~meta("language"), "metadata.language is missing"), (~meta("vulnerability_class"), "metadata.vulnerability_class is missing"),
        (positive & ~F.coalesce(advisory, F.lit(False)), "positive case should include CVE/GHSA/advisory/upstream PR metadata"),
        (negative & ~F.array_contains(tags, "negative-control"), "negative-control case should include the negative-control tag"),
        (positive & ~F.arrays_overlap(tags, F.array(*map(F.lit, ("oss", "cve", "github-advisory")))), "positive case should include an OSS/advisory tag"),
        (~has("config") & positive & F.lit(require_verification), "positive case should define a verification config"),
        (has("config") & F.col("_commands").isNull(), text("verification config does not exist: ", F.col("config"))), (F.col("_commands") == 0, "verification config has no commands"),
    )
    verification = F.when(F.col("_commands") > 0, text(F.col("_commands").cast("string"), " command(s)")).when(F.col("_commands") == 0, "empty").otherwise("missing")
    out = c.withColumns({"errors": errors, "warnings": F.concat("source_warnings", "label_warnings", more), "verification_status": verification, "is_security_advisory": F.coalesce(advisory, F.lit(False))})
    return out.select(*keys, F.when(F.size("errors") == 0, "ready").otherwise("blocked").alias("status"), "errors", "warnings", "source_kind", "label_summary", "verification_status", "has_positive_label", "has_negative_control", "is_security_advisory")


def audit_summary(audit: DataFrame, suite: str = "suite") -> DataFrame:
    s = audit.groupBy(suite).agg(
        F.count(F.lit(1)).alias("case_count"), F.count_if(F.col("status") == "ready").alias("ready_count"), F.count_if(F.col("status") == "blocked").alias("blocked_count"),
        F.sum(F.size("errors")).alias("error_count"), F.sum(F.size("warnings")).alias("warning_count"), F.count_if("has_positive_label").alias("positive_case_count"),
        F.count_if("has_negative_control").alias("negative_control_case_count"), F.count_if("is_security_advisory").alias("security_advisory_case_count"),
        F.count_if(F.contains("verification_status", F.lit("command"))).alias("verification_ready_count"),
    )
    status = F.when(F.col("error_count") > 0, "blocked").when(F.col("warning_count") > 0, "ready-with-warnings").otherwise("ready")
    return s.withColumn("status", status)


def rate(n: Column | str, d: Column | str) -> Column:
    """n / d to four places, half up; null for an empty denominator."""
    from reviewlake.functions.columns import col, safe_div

    return F.when(F.coalesce(col(d), F.lit(0)) > 0, safe_div(n, d))


def evidence_metrics(evaluation: DataFrame) -> DataFrame:
    """evaluation with its rates; null, not 0, where there is nothing to divide by."""
    return evaluation.withColumns({
        "validation_coverage": rate("validation_covered", "validation_step_count"), "tool_evidence_rate": rate("tool_supported_findings", "finding_count"),
        "primary_precision": rate("primary_findings", "finding_count"), "primary_finding_recall": rate("primary_hits", "primary_expected"),
        "expected_finding_recall": rate("expected_hits", "expected_total"),
    })


def evaluation_blockers(floors: dict[str, float] | None = None) -> Column:
    """Messages against promotion from an evaluated case's columns (those of evidence_metrics)."""
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    low = [
        (F.col(k).isNull() | (F.col(k) < v), text(f"{k} ", F.coalesce(F.col(k).cast("string"), F.lit("n/a")), f" < {v}")) for k, v in (FLOORS | (floors or {})).items()
    ]
    return messages(
        (F.coalesce("status", F.lit("None")) != "completed", text("evaluation status is ", F.coalesce("status", F.lit("None")))), (n("finding_count") <= 0, "evaluation produced no findings"),
        (n("verification_count") <= 0, "evaluation has no verification command"), (n("verification_passed") < n("verification_count"), "not all verification commands passed"),
        (n("required_failure_count") > 0, "required verification failed"), (n("policy_blocked_count") > 0, "policy blocked at least one verification command"),
        (n("validation_gap_findings") > 0, "validation gaps remain"), (n("unexpected_count") > 0, "unexpected findings remain"), *low,
    )


def plan_promotions(cases: DataFrame, audit: DataFrame, evaluation: DataFrame, promoted: DataFrame, expected: DataFrame, require_evaluation: bool = True, floors: dict[str, float] | None = None) -> DataFrame:
    """case_id, status (eligible, blocked, already-promoted), blockers, by left joins of the four tables on case_id."""
    primaries = expected.where(F.coalesce(filled("role"), F.lit("primary")) == "primary").select("case_id").distinct().withColumn("_primary", F.lit(True))
    ev = evidence_metrics(evaluation).withColumn("_evaluation", evaluation_blockers(floors)).select("case_id", "_evaluation")
    au = audit.select("case_id", "errors", "warnings", F.lit(True).alias("_audited"))
    c = cases.join(au, "case_id", "left").join(ev, "case_id", "left").join(promoted.select("case_id").distinct().withColumn("_done", F.lit(True)), "case_id", "left").join(primaries, "case_id", "left")
    none = F.array().cast("array<string>")
    each = lambda c, p: F.transform(F.coalesce(c, none), lambda m: F.concat(F.lit(p), m))
    advisory = reduce(lambda a, b: a | b, [filled(F.try_element_at("metadata", F.lit(k))).isNotNull() for k in ("cve", "ghsa", "advisory", "upstream_pr")])
    blockers = F.concat(
        messages((F.col("_audited").isNull(), "case is missing from audit result")), each("errors", "audit error: "), each("warnings", "audit warning: "),
        messages(
            (~has("config"), "verification config is required for measured promotion"), (F.col("_primary").isNull(), "at least one primary expected finding is required"),
            (~F.coalesce(advisory, F.lit(False)), "CVE/GHSA/advisory/upstream PR metadata is required"), (F.array_contains("tags", "holdout"), "frozen holdout cases cannot be promoted into the measured benchmark"),
            (F.col("_evaluation").isNull() & F.lit(require_evaluation), "evaluation evidence is required"),
        ), F.coalesce("_evaluation", none),
    )
    done = F.col("_done").isNotNull()
    c = c.withColumn("blockers", F.when(done, none).otherwise(blockers))
    return c.select("case_id", F.when(done, "already-promoted").when(F.size("blockers") == 0, "eligible").otherwise("blocked").alias("status"), "blockers")


def promote(cases: DataFrame, decisions: DataFrame) -> DataFrame:
    """Eligible cases with tag 'promoted' first and without 'candidate'."""
    ready = decisions.where(F.col("status") == "eligible").select("case_id")
    return cases.join(ready, "case_id", "left_semi").withColumn("tags", F.concat(F.array(F.lit("promoted")), F.array_remove(F.coalesce("tags", F.array().cast("array<string>")), "candidate")))


def fingerprints(cases: DataFrame, id_col: str = "case_id") -> DataFrame:
    """id_col, fingerprint: the typed identity keys of a case. cases: repo or repo_url, base_ref, head_ref, diff_url, metadata (map)."""
    meta = lambda k: filled(F.try_element_at("metadata", F.lit(k)))
    plain = lambda c: F.lower(F.rtrim(F.trim(c), F.lit("/")))
    repo = F.coalesce(filled("repo_url"), filled("repo"))
    keys = F.array(
        text("case-id:", F.lower(filled(id_col))), *[text(f"{k}:", F.lower(F.trim(meta(k)))) for k in ("cve", "ghsa", "advisory")],
        text("source-pair:", plain(repo), "@", plain(filled("base_ref")), "..", plain(filled("head_ref"))), text("diff-url:", plain(filled("diff_url"))),
        text("upstream-commit:", plain(meta("upstream_commit"))),
    )
    return cases.select(id_col, F.explode(F.array_distinct(F.array_compact(keys))).alias("fingerprint"))


def partition_overlap(left: DataFrame, refs: DataFrame, left_id: str = "case_id", ref_id: str = "reference_case_id") -> DataFrame:
    """Pairs that share a fingerprint, with the sorted reasons. Both sides: an id and fingerprint."""
    pairs = left.select(left_id, "fingerprint").distinct().join(refs.select(ref_id, "fingerprint").distinct(), "fingerprint")
    return pairs.groupBy(left_id, ref_id).agg(F.array_sort(F.collect_set("fingerprint")).alias("reasons"))
