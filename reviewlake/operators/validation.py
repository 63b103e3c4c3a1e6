"""Evidence for findings: plans, calibration, review summaries and the policy audit."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewlake.functions.columns import filled, normalize_path
from reviewlake.operators.joins import range_join

# Words of a check, and the capabilities that meet it; the first line with a hit decides.
CAPABILITIES = [
    (["semgrep"], ["semgrep"]),
    (["codeql"], ["codeql"]),
    (["unit"], ["unit-test", "regression-test"]),
    (["regression", "malicious input"], ["unit-test", "regression-test", "exploit-regression", "poc"]),
    (["command-injection", "shell"], ["command-injection"]),
    (["sql"], ["sql-injection", "database-security", "static-analysis"]),
    (["taint"], ["taint-analysis", "dataflow-analysis"]),
    (["static"], ["static-analysis"]),
    (["integration"], ["integration-test", "regression-test"]),
    (["fuzz"], ["fuzzing"]),
    (["sanitizer"], ["sanitizer"]),
    (["crypto", "policy"], ["crypto-policy", "policy-check", "static-analysis"]),
]
# Words of a check, then words looked for in the run's name and in its command; tried second.
NAMES = [
    (["unit", "regression"], ["test", "unit", "regression"], ["pytest", "unittest"]),
    (["command-injection", "shell"], *[["semgrep", "codeql", "command-injection", "shell-injection"]] * 2),
    (["static", "taint"], *[["semgrep", "codeql", "ruff", "bandit", "mypy", "taint"]] * 2),
    (["semgrep"], *[["semgrep"]] * 2),
    (["codeql"], *[["codeql"]] * 2),
    (["fuzz"], *[["fuzz", "atheris", "hypothesis", "libfuzzer"]] * 2),
    (["sanitizer"], *[["asan", "ubsan", "sanitizer"]] * 2),
    (["crypto", "policy"], *[["semgrep", "codeql", "bandit", "crypto", "policy"]] * 2),
    (["sql"], ["test", "sql"], ["pytest", "unittest", "semgrep", "codeql", "sql"]),
]
SCANNERS, SCANNER_TAGS = ["semgrep", "codeql"], ["semgrep", "codeql", "taint-analysis", "dataflow-analysis", "command-injection", "sql-injection"]
COVERED = "This check has matching structured evidence from the listed tool(s), but reviewer judgment is still needed for exploitability and production exposure."
RAN = "Candidate tool(s) ran for this check, but none produced a matching scanner finding, test marker, payload assertion, or changed-line evidence. Treat this as unvalidated until '{}' is tied to structured evidence."
NOTHING = "No configured tool currently covers '{}'. Confidence rests on localized evidence and deterministic rules until this validation is added."
HIT, QUIET, MISSING, UNMATCHED, UNPLANNED = (
    "Matched structured tool evidence on the same file and line range.",
    "A configured security scanner covered this check but did not emit a matching finding.",
    "recommended validation check(s) are still missing.",
    "Validation coverage exists, but no structured tool finding was matched.",
    "No validation recommendations were attached to this finding.",
)


def _any(text: Column, words: list[str]) -> Column:
    return reduce(lambda a, w: a | F.contains(text, F.lit(w)), words, F.lit(False))


def check_matches_run(check: Column, name: Column, command: Column, capabilities: Column) -> Column:
    """Whether a run can speak for a recommended check: by capability tags, else by words in its name and command."""
    check, name, command = F.lower(check), F.lower(name), F.lower(command)
    caps = F.transform(F.coalesce(capabilities, F.array().cast("array<string>")), F.lower)
    tagged = reduce(lambda a, r: F.when(_any(check, r[0]), F.arrays_overlap(caps, F.array(*map(F.lit, r[1])))).otherwise(a), reversed(CAPABILITIES), F.lit(False))
    both = F.concat_ws(" ", name, command)
    named = reduce(lambda a, r: F.when(_any(check, r[0]), _any(name, r[1]) | _any(command, r[2])).otherwise(a), reversed(NAMES), F.contains(both, check))
    return F.coalesce(tagged, F.lit(False)) | F.coalesce(named, F.lit(False))


def passed(status: str = "policy_status", exit_code: str = "exit_code", timed_out: str = "timed_out") -> Column:
    return F.coalesce((F.col(status) == "allowed") & (F.col(exit_code) == 0) & ~F.coalesce(timed_out, F.lit(False)), F.lit(False))


def tool_overlap(findings: DataFrame, tool_findings: DataFrame, key: str = "review_id", width: int = 64) -> DataFrame:
    """Pairs of a finding and a tool's finding in the same file on meeting lines; tool columns come with the prefix t_."""
    t = tool_findings.select(key, normalize_path("file_path").alias("_path"), *[F.col(c).alias(f"t_{c}") for c in tool_findings.columns if c != key])
    f = findings.withColumn("_path", normalize_path("file_path"))
    return range_join(f, t, [key, "_path"], ("start_line", "t_start_line"), ("end_line", "t_end_line"), width).drop("_path")


def _plain(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), "[-_]", " "), r"\s+", " "))


def marker_match(steps: DataFrame, markers: DataFrame, key: str = "review_id") -> DataFrame:
    """Pairs of a step and a marker that speaks for it; marker columns come with the prefix m_.

    Two equi-joins: markers that name a finding join on it; the others, by rule where they have one, else within the review,
    and every part given must agree. steps: key, finding_id, rule_id, file_path, start_line, end_line, recommended_check.
    """
    m = markers.select(key, *[F.col(c).alias(f"m_{c}") for c in markers.columns if c != key])
    named, ruled = filled("m_finding_id").isNotNull(), filled("m_rule_id").isNotNull()
    a, b = _plain(F.col("m_check")), _plain(F.col("recommended_check"))
    about = filled("m_check").isNull() | F.contains(b, a) | F.contains(a, b)
    path = filled("m_file_path").isNull() | (normalize_path("m_file_path") == normalize_path("file_path"))
    lines = F.col("m_start_line").isNull() | F.col("m_end_line").isNull() | ((F.col("m_end_line") >= F.col("start_line")) & (F.col("m_start_line") <= F.col("end_line")))
    by_id = steps.join(m.where(named), [steps[key] == m[key], steps["finding_id"] == m["m_finding_id"]]).drop(m[key]).where(about)
    by_rule = steps.join(m.where(~named & ruled), [steps[key] == m[key], steps["rule_id"] == m["m_rule_id"]]).drop(m[key]).where(about & path & lines)
    placed = filled("m_file_path").isNotNull() | F.col("m_start_line").isNotNull()
    by_place = steps.join(m.where(~named & ~ruled & placed), key).where(about & path & lines)
    return by_id.unionByName(by_rule.select(by_id.columns)).unionByName(by_place.select(by_id.columns))


def failure_boundary(covered: Column, ran: Column, check: Column) -> Column:
    said = lambda text: F.concat(F.lit(text.split("{}")[0]), check, F.lit(text.split("{}")[1]))
    return F.when(covered, COVERED).when(ran, said(RAN)).otherwise(said(NOTHING))


def validation_plan(findings: DataFrame, runs: DataFrame, tool_findings: DataFrame, markers: DataFrame, key: str = "review_id") -> DataFrame:
    """One row for each finding and recommended check: covered by runs with evidence, with other candidates beside.

    A run is a candidate when it passed and matches the check; only structured evidence covers, never an exit code.
    """
    steps = findings.select(key, "finding_id", "rule_id", "title", "file_path", "start_line", "end_line", F.posexplode("recommended_validation").alias("check_no", "recommended_check"))
    r = runs.where(passed()).select(key, F.col("name").alias("tool_name"), "command", "capabilities")
    candidates = steps.join(r, key).where(check_matches_run(F.col("recommended_check"), F.col("tool_name"), F.col("command"), F.col("capabilities")))
    candidates = candidates.select(key, "finding_id", "check_no", "tool_name").distinct()
    seen = tool_overlap(steps.select(key, "finding_id", "check_no", "file_path", "start_line", "end_line"), tool_findings, key)
    message = F.when(filled("t_message").isNotNull(), F.concat(F.lit(": "), "t_message")).otherwise("")
    location = F.concat("t_file_path", F.lit(":"), F.col("t_start_line").cast("string"), F.lit("-"), F.col("t_end_line").cast("string"))
    seen = seen.select(key, "finding_id", "check_no", F.col("t_tool_name").alias("tool_name"), F.concat("t_tool_name", F.lit("/"), "t_rule_id", F.lit(" at "), location, F.lit(" ("), "t_severity", F.lit(")"), message).alias("evidence"))
    marked = marker_match(steps, markers, key)
    at = F.when(filled("m_file_path").isNull(), "").when(F.col("m_start_line").isNull(), F.concat(F.lit(" at "), normalize_path("m_file_path"))).otherwise(
        F.concat(F.lit(" at "), normalize_path("m_file_path"), F.lit(":"), F.col("m_start_line").cast("string"), F.lit("-"), F.coalesce("m_end_line", "m_start_line").cast("string"))
    )
    tag = lambda c, p: F.when(filled(c).isNotNull(), F.concat(F.lit(p), F.col(c)))
    marked = marked.select(key, "finding_id", "check_no", F.col("m_tool_name").alias("tool_name"), F.concat_ws(" | ", F.concat("m_tool_name", F.lit("/"), "m_kind", at), tag("m_rule_id", "rule="), tag("m_message", ""), tag("m_payload", "payload="), tag("m_assertion", "assertion=")).alias("evidence"))
    evidence = candidates.join(seen.unionByName(marked), [key, "finding_id", "check_no", "tool_name"], "left")
    tools = evidence.groupBy(key, "finding_id", "check_no", "tool_name").agg(F.array_sort(F.collect_list("evidence")).alias("evidence"))
    has = F.size("evidence") > 0
    plan = tools.groupBy(key, "finding_id", "check_no").agg(
        F.array_sort(F.collect_list(F.when(has, F.col("tool_name")))).alias("covered_by"), F.array_sort(F.collect_list(F.when(~has, F.col("tool_name")))).alias("candidate_tools"),
        F.flatten(F.array_sort(F.collect_list("evidence"))).alias("tool_evidence"),
    )
    empty = F.array().cast("array<string>")
    out = steps.join(plan, [key, "finding_id", "check_no"], "left")
    out = out.withColumns({c: F.coalesce(c, empty) for c in ("covered_by", "candidate_tools", "tool_evidence")})
    covered = F.size("covered_by") > 0
    return out.select(
        key, "finding_id", "check_no", F.concat(F.lit("Validate "), "title").alias("objective"), "recommended_check", F.when(covered, "covered").otherwise("missing").alias("status"),
        "covered_by", "tool_evidence", "candidate_tools", failure_boundary(covered, F.size("candidate_tools") > 0, F.col("recommended_check")).alias("failure_boundary"),
    )


def is_security_scanner(adapter: Column, capabilities: Column) -> Column:
    caps = F.transform(F.coalesce(capabilities, F.array().cast("array<string>")), F.lower)
    return adapter.isin(SCANNERS) | F.arrays_overlap(caps, F.array(*map(F.lit, SCANNER_TAGS)))


def calibrated(base: Column, steps: Column, evidence: Column, quiet: Column, missing: Column) -> Column:
    """A finding's confidence from its steps: +0.12 with evidence, -0.08 for a quiet scanner, -0.04 a missing check and 0.10 at most; -0.04 without steps."""
    d = lambda v: F.lit(v).cast("decimal(6,2)")
    change = F.when(evidence, d("0.12")).otherwise(d("0")) - F.when(quiet, d("0.08")).otherwise(d("0")) - F.least(d("0.10"), missing.cast("decimal(10,0)") * d("0.04"))
    value = base.cast("decimal(10,4)") + F.when(steps == 0, d("-0.04")).otherwise(change)
    return F.round(F.greatest(F.lit(0), F.least(d("0.99"), value)), 2).cast("double")


def calibrate(findings: DataFrame, steps: DataFrame, runs: DataFrame, key: str = "review_id") -> DataFrame:
    """findings with base_confidence, confidence and confidence_notes."""
    tools = F.when(F.size("candidate_tools") > 0, F.col("candidate_tools")).when(F.col("status") == "covered", F.col("covered_by"))
    open_steps = steps.where(F.size("tool_evidence") == 0).select(key, "finding_id", F.explode(tools).alias("name"))
    scanners = runs.where(is_security_scanner(F.col("adapter"), F.col("capabilities"))).select(key, "name").distinct()
    quiet = open_steps.join(scanners, [key, "name"], "left_semi").select(key, "finding_id").distinct().withColumn("_quiet", F.lit(True))
    per = steps.groupBy(key, "finding_id").agg(F.count(F.lit(1)).alias("_steps"), F.count_if(F.size("tool_evidence") > 0).alias("_hits"), F.count_if(F.col("status") == "missing").alias("_missing"), F.count_if(F.col("status") == "covered").alias("_covered"))
    f = findings.join(per, [key, "finding_id"], "left").join(quiet, [key, "finding_id"], "left")
    f = f.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("_steps", "_hits", "_missing", "_covered")}).withColumn("_quiet", F.coalesce("_quiet", F.lit(False)))
    notes = F.when(F.col("_steps") == 0, UNPLANNED).otherwise(F.concat_ws(
        " ", F.when(F.col("_hits") > 0, HIT), F.when(F.col("_quiet"), QUIET), F.when(F.col("_missing") > 0, F.concat(F.col("_missing").cast("string"), F.lit(f" {MISSING}"))),
        F.when((F.col("_covered") > 0) & (F.col("_hits") == 0), UNMATCHED),
    ))
    confidence = calibrated(F.col("confidence"), F.col("_steps"), F.col("_hits") > 0, F.col("_quiet"), F.col("_missing"))
    out = f.withColumns({"base_confidence": F.col("confidence"), "confidence_notes": notes, "_c": confidence}).withColumn("confidence", F.col("_c"))
    return out.drop("_steps", "_hits", "_missing", "_covered", "_quiet", "_c")


def review_summary(reviews: DataFrame, findings: DataFrame, runs: DataFrame, steps: DataFrame, tool_findings: DataFrame, key: str = "review_id") -> DataFrame:
    """Counts by review; severity_counts is a map, required_failures an array of names. reviews: key."""
    said = lambda text: F.count_if(F.contains("confidence_notes", F.lit(text)))
    by_f = findings.groupBy(key).agg(
        F.count(F.lit(1)).alias("finding_count"), F.round(F.avg(F.col("confidence").cast("decimal(8,4)")), 2).cast("double").alias("avg_confidence"),
        said(HIT[:32]).alias("tool_supported_findings"), said(MISSING[:-1]).alias("validation_gap_findings"), said("did not emit a matching finding").alias("scanner_dampened_findings"),
    )
    severities = findings.groupBy(key, "severity").agg(F.count(F.lit(1)).alias("n")).groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("severity", "n")))).alias("severity_counts"))
    ok = passed()
    by_r = runs.groupBy(key).agg(
        F.count(F.lit(1)).alias("verification_count"), F.count_if(ok).alias("verification_passed"), F.array_sort(F.collect_list(F.when(F.col("required") & ~ok, F.col("name")))).alias("required_failures"),
        F.sum(F.coalesce("artifact_count", F.lit(0))).alias("tool_artifact_count"), F.count_if(F.col("policy_status") == "blocked").alias("policy_blocked_count"),
        F.sum(F.greatest(F.size("policy_warnings"), F.lit(0))).alias("policy_warning_count"),
    )
    by_s = steps.groupBy(key).agg(F.count(F.lit(1)).alias("validation_step_count"), F.count_if(F.col("status") == "covered").alias("validation_covered"), F.count_if(F.col("status") == "missing").alias("validation_missing"), F.count_if(F.size("tool_evidence") > 0).alias("validation_with_tool_evidence"))
    by_t = tool_findings.groupBy(key).agg(F.count(F.lit(1)).alias("tool_finding_count"))
    out = reduce(lambda a, b: a.join(b, key, "left"), [by_f, severities, by_r, by_s, by_t], reviews.select(key).distinct())
    fixed = {"avg_confidence": F.lit(0.0), "severity_counts": F.create_map().cast("map<string,bigint>"), "required_failures": F.array().cast("array<string>")}
    return out.select(key, *[F.coalesce(c, fixed.get(c, F.lit(0))).alias(c) for c in out.columns if c != key])


def normalize_command(command: Column) -> Column:
    """Lower case, single spaces, none around pipes, one at both ends."""
    piped = F.regexp_replace(F.lower(command), r"\s*\|\s*", "|")
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(piped, r"\s+", " ")), F.lit(" "))


def policy_audit(commands: DataFrame, policy: DataFrame) -> DataFrame:
    """commands with policy_status and reasons. policy: one row of enabled, allowed_adapters, allowed_executables, blocked_command_patterns,
    max_timeout_seconds, max_output_bytes, environment_mode, network_access."""
    row = policy.first()  # one row by definition: its values become literals
    p = lambda c: F.array(*map(F.lit, row[c])).cast("array<string>") if isinstance(row[c], list) else F.lit(row[c])
    rows = commands
    text = lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])
    names = F.array_join(p("allowed_adapters"), ", ")
    tokens = lambda e: F.array(F.lower(e), F.lower(F.element_at(F.split(F.replace(e, F.lit("\\"), F.lit("/")), "/"), -1)), F.regexp_replace(F.lower(F.element_at(F.split(F.replace(e, F.lit("\\"), F.lit("/")), "/"), -1)), r"\.exe$", ""))
    first = F.get("argv", 0)
    allowed = F.exists(p("allowed_executables"), lambda a: F.arrays_overlap(tokens(a), tokens(first)))
    blocked = F.transform(F.filter(p("blocked_command_patterns"), lambda x: F.contains(normalize_command(F.col("command")), normalize_command(x))), lambda x: text("command contains blocked pattern '", x, "'"))
    own = lambda test, message: F.when(test, message)
    before = F.array(
        own(~F.array_contains(p("allowed_adapters"), F.col("adapter")), text("adapter '", F.col("adapter"), "' is not in the allowed adapter set (", F.when(names == "", "none").otherwise(names), ")")),
        own(F.col("timeout_seconds") > p("max_timeout_seconds"), text("timeout ", F.col("timeout_seconds").cast("string"), "s exceeds policy maximum ", p("max_timeout_seconds").cast("string"), "s")),
        own(p("max_output_bytes") <= 0, F.lit("max_output_bytes must be greater than zero")),
    )
    after = F.array(
        F.when(F.coalesce(F.size("argv"), F.lit(0)) <= 0, "command could not be rendered into argv for shell-free execution").when(~allowed, text("executable '", first, "' is not in the allowed executable set")),
        own(~p("environment_mode").isin("minimal", "inherit"), F.lit("environment_mode must be one of: minimal, inherit")),
        own(~p("network_access").isin("inherit", "disabled"), F.lit("network_access must be one of: inherit, disabled")),
    )
    reasons = F.when(p("enabled"), F.array_compact(F.concat(before, blocked, after))).otherwise(F.array().cast("array<string>"))
    return rows.withColumn("reasons", reasons).withColumn("policy_status", F.when(F.size("reasons") > 0, "blocked").otherwise("allowed"))
