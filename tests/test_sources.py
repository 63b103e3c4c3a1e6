"""Golden rows: scanner reports, cases, markers, evidence, audits, gates, streams."""

import json

from pyspark.sql import functions as F

from reviewlake.operators import audits as A
from reviewlake.operators import gates as G
from reviewlake.operators import lines as L
from reviewlake.operators import scoring as S
from reviewlake.operators import validation as V
from reviewlake.sources import cases as K
from reviewlake.sources import tool_output as P
from reviewlake.streaming import trace as X

SARIF = {"runs": [{"tool": {"driver": {"rules": [{"id": "r", "defaultConfiguration": {"level": "error"}}]}}, "results": [{"ruleId": "r", "message": {"text": "m"}, "locations": [{"physicalLocation": {"artifactLocation": {"uri": "file:///app.py"}, "region": {"startLine": 3}}}]}, {"ruleId": "r"}]}]}
PAYLOADS = [
    ("semgrep", {"results": [{"check_id": "c", "path": "examples\\demo_app.py", "start": {"line": 7}, "end": {"line": 7}, "extra": {"severity": "WARNING", "message": "m"}}, {"path": "", "start": {"line": 1}}]}),
    ("codeql", SARIF),
    ("bandit", {"results": [{"filename": "app.py", "line_number": 3, "line_range": [3, 4], "test_id": "B602", "issue_severity": "HIGH", "issue_text": "t"}]}),
    ("pip-audit", [{"name": "flask", "version": "0.5", "vulns": [{"id": "PYSEC-1", "fix_versions": ["1.0"], "description": "d"}]}]),
    ("pip_audit", {"dependencies": [{"name": "flask", "version": "0.5", "vulns": [{"id": "PYSEC-1"}]}]}),
    ("unknown", {}),
]


def test_scanner_reports(spark):
    runs = spark.createDataFrame([(a, a, a, json.dumps(p)) for a, p in PAYLOADS] + [("bad", "semgrep", "semgrep", "{nope"), ("none", "semgrep", "semgrep", None)], "review_id string, tool_name string, adapter string, payload string")
    got = {r["review_id"]: r for r in P.parse_tool_output(runs).collect()}
    assert set(got) == {"semgrep", "codeql", "bandit", "pip-audit", "pip_audit"}
    short = lambda k: tuple(got[k][c] for c in ("rule_id", "file_path", "start_line", "end_line", "severity"))
    assert short("semgrep") == ("c", "examples/demo_app.py", 7, 7, "warning")
    assert short("codeql") == ("r", "app.py", 3, 3, "error")
    assert short("bandit") == ("B602", "app.py", 3, 4, "high")
    assert short("pip-audit") == ("PYSEC-1", "dependencies/flask", 1, 1, "high") and "fix: 1.0" in got["pip-audit"]["message"]
    assert short("pip_audit")[-1] == "medium"


def test_cases_are_read_with_rejects_beside(spark, tmp_path):
    doc = {"cases": [{"diff": "a.diff", "cve": "CVE-1", "metadata": {"project": "p"}, "expected_findings": ["r1", {"rule_id": "r2", "role": "negative-control", "start_line": 4}, {"rule_id": "r3", "role": "odd"}, {"role": "primary"}]}, {"case_id": "x", "patch_url": "u", "expected_rules": ["q"], "tags": ["t"]}]}
    (tmp_path / "suite1.json").write_text(json.dumps(doc))
    cases, expected, bad = K.read_cases(spark, str(tmp_path))
    c = {r["case_id"]: r for r in cases.collect()}
    assert c["case-1"]["expected_rules"] == ["r1"] and c["case-1"]["metadata"] == {"project": "p", "cve": "CVE-1"} and c["case-1"]["suite"] == "suite1"
    assert c["x"]["diff_url"] == "u" and c["x"]["expected_rules"] == ["q"] and c["x"]["tags"] == ["t"]
    assert sorted((r["rule_id"], r["role"]) for r in expected.collect()) == [("r1", "primary"), ("r2", "negative-control")]
    assert bad.count() == 2


def test_evidence_raises_and_silence_lowers_confidence(spark):
    finding = spark.createDataFrame([("r", "f", "py-shell-true", "T", "examples/demo_app.py", 1, 8, ["static command-injection rules"], 0.70)], "review_id string, finding_id string, rule_id string, title string, file_path string, start_line int, end_line int, recommended_validation array<string>, confidence double")
    runs = spark.createDataFrame([("r", "semgrep", "semgrep scan", "semgrep", ["command-injection"], True, 0, False, "allowed")], "review_id string, name string, command string, adapter string, capabilities array<string>, required boolean, exit_code int, timed_out boolean, policy_status string")
    tools = spark.createDataFrame([("r", "semgrep", "c", "m", "./examples/demo_app.py", 7, 7, "warning")], "review_id string, tool_name string, rule_id string, message string, file_path string, start_line int, end_line int, severity string")
    markers = spark.createDataFrame([], "review_id string, tool_name string, kind string, message string, rule_id string, finding_id string, file_path string, start_line int, end_line int, check string, payload string, assertion string")
    steps = V.validation_plan(finding, runs, tools, markers)
    s = steps.first()
    assert s["status"] == "covered" and s["covered_by"] == ["semgrep"] and len(s["tool_evidence"]) == 1
    assert V.calibrate(finding, steps, runs).first()["confidence"] == 0.82
    quiet = V.validation_plan(finding, runs, tools.where("false"), markers)
    assert quiet.first()["status"] == "missing" and V.calibrate(finding, quiet, runs).first()["confidence"] == 0.58


def test_scanner_scored_within_the_diff(spark):
    diff = "+++ b/app.py\n@@ -1,10 +1,10 @@\n" + "\n".join([" a"] * 6 + ["-b", "+c"] + [" d"] * 3)
    lines = L.changed_lines(spark.createDataFrame([("c1", diff)], "case_id string, diff_text string"), "case_id")
    ranges, _ = L.diff_scope(lines, "case_id")
    f = spark.createDataFrame([("c1", 1, "x", "app.py", 7, 7, "WARNING"), ("c1", 2, "x", "app.py", 50, 50, "WARNING")], "case_id string, seq int, rule_id string, file_path string, start_line int, end_line int, severity string")
    e = spark.createDataFrame([("s", "c1", 0, "py-x", "app.py", 7, 7, "medium", "primary")], "suite string, case_id string, exp_idx int, rule_id string, file_path string, start_line int, end_line int, severity string, role string")
    cases = spark.createDataFrame([("s", "c1", "completed", ["py-x"])], "suite string, case_id string, status string, expected_rules array<string>")
    maps = spark.createDataFrame([("c1", "x", "py-x")], "case_id string, name string, canonical string")
    r = S.score_scanner(cases, f, e, ranges, maps, maps.where("false")).first()
    assert (r["finding_count"], r["raw_tool_finding_count"], r["out_of_scope_finding_count"], r["primary_precision"]) == (1, 2, 1, 1.0)


def test_gate_messages(spark):
    m = {"validation_coverage_rate": 0.25, "tool_evidence_rate": 0.0, "avg_confidence": 0.52, "validation_gap_rate": 0.75, "required_failure_count": 1.0, "error_count": 1.0, "finding_count": 4.0}
    t = {"validation_coverage_rate": ("min", 0.8), "tool_evidence_rate": ("min", 0.2), "avg_confidence": ("min", 0.6), "validation_gap_rate": ("max", 0.2), "required_failure_count": ("max", 0.0), "error_count": ("max", 0.0)}
    th = spark.createDataFrame([("s", k, *v) for k, v in t.items()], "suite string, metric string, op string, bound double")
    metrics = spark.createDataFrame([("s", k, v) for k, v in m.items()], "suite string, metric string, value double")
    r = G.gate(metrics, th).first()
    assert not r["passed"] and len(r["failures"]) == 6 and "validation coverage 0.25 is below required minimum 0.80" in r["failures"]
    none = metrics.withColumn("value", F.when(F.col("metric") == "finding_count", 0.0).otherwise(F.col("value")))
    assert len(G.gate(none, th).first()["failures"]) == 5


def test_shared_fingerprints_are_leaks(spark):
    schema = "case_id string, repo string, repo_url string, base_ref string, head_ref string, diff_url string, metadata map<string,string>"
    left = spark.createDataFrame([("a", None, "https://x/r/", "b", "h", None, {"cve": " CVE-2099-0001"})], schema)
    refs = spark.createDataFrame([("z", None, "https://X/r", "b", "h", None, {"cve": "cve-2099-0001"}), ("q", None, None, None, None, None, {})], schema)
    o = A.partition_overlap(A.fingerprints(left), A.fingerprints(refs).withColumnRenamed("case_id", "reference_case_id")).collect()
    assert len(o) == 1 and o[0]["reasons"] == ["cve:cve-2099-0001", "source-pair:https://x/r@b..h"]


def test_streams_equal_batches(spark, tmp_path):
    rows = [("k1", f"2024-01-01 00:0{i}:00") for i in range(8)] * 2
    df = spark.createDataFrame(rows, "kind string, t string").select("kind", F.to_timestamp("t").alias("timestamp"))
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = X.event_rates(stream).writeStream.format("memory").queryName("rates").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    key = lambda d: sorted(map(tuple, d.collect()))
    assert key(spark.table("rates")) == key(X.event_rates(df))
    q = X.dedupe_events(stream, ["kind", "timestamp"]).writeStream.format("memory").queryName("once").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("once").count() == 8


def test_sarif(spark):
    f = spark.createDataFrame([("r", 1, "id1", "rule", "T", "high", 0.8, "a.py", 2, 4, "", "do")], "review_id string, seq int, finding_id string, rule_id string, title string, severity string, confidence double, file_path string, start_line int, end_line int, risk string, fix_guidance string")
    run = json.loads(K.to_sarif(f).first()["sarif"])["runs"][0]
    (r,) = run["results"]
    assert r["level"] == "error" and r["locations"][0]["physicalLocation"]["region"] == {"startLine": 2, "endLine": 4} and r["partialFingerprints"] == {"findingId": "id1"}


def test_sarif_rules_belong_to_their_report(spark):
    """Two reports of one review and tool that give one rule two levels."""
    from reviewlake.sources.tool_output import parse_sarif

    def report(level):
        place = '[{"physicalLocation": {"artifactLocation": {"uri": "a.py"}, "region": {"startLine": 3}}}]'
        return '{"runs": [{"tool": {"driver": {"rules": [{"id": "r", "defaultConfiguration": {"level": "%s"}}]}}, "results": [{"ruleId": "r", "message": {"text": "%s"}, "locations": %s}]}]}' % (level, level, place)

    runs = spark.createDataFrame([("1", "t", report("error")), ("1", "t", report("note"))], "review_id string, tool_name string, payload string")
    assert sorted((r["message"], r["severity"]) for r in parse_sarif(runs).collect()) == [("error", "error"), ("note", "note")]


def test_reports_of_one_review_share_no_numbers(spark):
    import json

    from reviewlake.operators.lines import split_in_scope
    from reviewlake.sources.tool_output import parse_pip_audit, parse_sarif

    at = lambda uri, line: {"ruleId": "x", "locations": [{"physicalLocation": {"artifactLocation": {"uri": uri}, "region": {"startLine": line}}}]}
    report = lambda *results: json.dumps({"runs": [{"results": [r]} for r in results]})
    runs = spark.createDataFrame([(1, "t", report(at("a.py", 3), at("b.py", 4))), (1, "t", report(at("c.py", 50))), (1, "u", report(at("a.py", 70)))], "review_id int, tool_name string, payload string")
    found = parse_sarif(runs).cache()
    assert sorted((r["tool_name"], r["seq"]) for r in found.collect()) == [("t", 0), ("t", 1), ("t", 2), ("u", 0)]
    ranges = spark.createDataFrame([(1, "a.py", 1, 9)], "review_id int, file_path string, scope_start int, scope_end int")
    assert {(r["tool_name"], r["file_path"], r["start_line"]) for r in split_in_scope(found, ranges).where("in_scope").collect()} == {("t", "a.py", 3)}
    many = json.dumps({"dependencies": [{"name": n, "vulns": [{"id": f"{n}{k}"} for k in range(1500)]} for n in "pq"]})
    seqs = [r["seq"] for r in parse_pip_audit(spark.createDataFrame([(1, "t", many)], "review_id int, tool_name string, payload string")).collect()]
    assert sorted(seqs) == list(range(3000))
