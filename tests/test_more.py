"""Manifests, logs, bundles, streams, extension points, promotion and integrity."""

import json
import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from reviewlake.operators import audits as A
from reviewlake.operators import failures as X
from reviewlake.operators import integrity as I
from reviewlake.operators import rules as R
from reviewlake.operators import scoring as S
from reviewlake.operators.integrity import top_findings
from reviewlake.operators.joins import range_join
from reviewlake.plans.review import register_rule_pack, review
from reviewlake.sources import cases as K
from reviewlake.sources import tool_output as P
from reviewlake.streaming import trace as T


def test_scanner_manifest_and_its_frozen_form(spark):
    doc = {"adapter": "semgrep", "cases": [{"id": "a", "artifact": "a.json"}, {"id": "b", "payload": {"results": []}}, {"id": "c", "results": [1]}, {"id": "d", "status": "skipped"}, {"id": "e", "status": "error", "error": "x"}, {"id": "f", "adapter": "codeql", "runs": []}]}
    docs = spark.createDataFrame([(json.dumps(doc),)], "j string").select(F.parse_json("j").alias("doc"))
    m = K.read_scanner_manifest(docs, spark.createDataFrame([("a.json", "{}")], "path string, text string"))
    got = {r["case_id"]: r for r in m.collect()}
    assert {k: r["payload"] for k, r in got.items()} == {"a": "{}", "b": '{"results":[]}', "c": '{"results":[1]}', "d": "", "e": "", "f": '{"runs":[]}'}
    assert got["d"]["skip_reason"] == "scanner execution skipped" and got["e"]["error"] == "x"
    frozen = {r["case_id"]: json.loads(r["frozen"]) for r in K.freeze_scanner_results(m, spark.createDataFrame([("a", "D")], "case_id string, diff_text string")).collect()}
    assert frozen["a"]["diff"] == "D" and "payload" not in frozen["d"]


def test_diffs_logs_and_bundles_are_read_back(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "one.diff").write_text("+++ b/a.py\n")
    assert [(r["review_id"], r["diff_text"]) for r in K.read_diffs(spark, str(tmp_path / "d")).collect()] == [("one", "+++ b/a.py\n")]
    (tmp_path / "log" / "r1").mkdir(parents=True)
    (tmp_path / "log" / "r1" / "trace.jsonl").write_text('{"kind": "tool.start", "message": "m", "payload": {"tool": "x"}, "timestamp": "2024-01-01T00:00:00Z"}\n')
    (row,) = K.read_trace(spark, str(tmp_path / "log" / "*" / "*.jsonl")).collect()
    assert (row["review_id"], row["kind"], json.loads(row["payload"])) == ("r1", "tool.start", {"tool": "x"})
    t = spark.createDataFrame([("s", 1), ("t", 2)], "suite string, n int")
    K.write_report_tables({"summary": t}, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out" / "summary")).where("suite = 't'").first()["n"] == 2


def test_registered_parsers_and_packs(spark):
    mine = P.register_parser(P.PARSERS, "own", lambda runs: runs.select("review_id", "tool_name", F.lit("own").alias("adapter"), F.lit("r").alias("rule_id"), F.col("payload").alias("message"), F.lit("p").alias("file_path"), F.lit(1).alias("start_line"), F.lit(1).alias("end_line"), F.lit("low").alias("severity"), F.lit(None).cast("string").alias("metadata"), F.lit(0).alias("seq")))
    runs = spark.createDataFrame([("x", "t", "own", "hello")], "review_id string, tool_name string, adapter string, payload string")
    assert P.parse_tool_output(runs, mine).first()["message"] == "hello" and P.parse_tool_output(runs).count() == 0
    packs, analyzers = register_rule_pack([R.pack(spark, R.RULES, "builtin")], [], R.pack(spark, [dict(rule_id="own", title="O", severity="low", confidence=0.5, pattern="danger", recommended_validation=[]), dict(rule_id="weak-hash", title="No", severity="low", confidence=0.5, pattern="x", recommended_validation=[])], "own"))
    rules = R.rule_table(packs)
    assert rules.where("rule_id = 'weak-hash'").first()["pack_id"] == "builtin" and analyzers == []
    d = spark.createDataFrame([("r", "+++ b/a.py\n@@ -1 +1 @@\n+danger()\n")], "review_id string, diff_text string")
    assert [r["rule_id"] for r in review(d, rules, semantic=False).collect()] == ["own"]


def test_live_findings_and_ratchet_equal_batches(spark, tmp_path):
    d = spark.createDataFrame([(f"r{i}", f"+++ b/a.py\n@@ -{i} +{i} @@\n+eval(x)\n") for i in range(1, 5)], "review_id string, diff_text string")
    d.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(d.schema).parquet(str(tmp_path / "in"))
    rules = R.shipped_rules(spark)
    q = T.stream_findings(stream, lambda b: review(b, rules, semantic=False).select("review_id", "finding_id"), str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination()
    key = lambda x: sorted(map(tuple, x.select("review_id", "finding_id").collect()))
    assert key(spark.read.parquet(str(tmp_path / "out"))) == key(review(d, rules, semantic=False)) != []
    rows = spark.createDataFrame([("s", 1), ("s", 2), ("t", 3)], "suite string, n int")
    assert sorted(map(tuple, T.ratchet_totals(rows, 1).collect())) == [("s", 2, True), ("t", 1, False)]


def test_tool_durations_of_a_stream(spark, tmp_path):
    t = spark.createDataFrame([("a", "2024-01-01 00:00:00")], "tool string, t string").select("tool", F.to_timestamp("t").alias("timestamp"))
    for name, late in (("s", 0), ("f", 7)):
        t.withColumn("timestamp", F.col("timestamp") + F.make_interval(secs=F.lit(late))).write.parquet(str(tmp_path / name))
    s, f = (spark.readStream.schema(t.schema).parquet(str(tmp_path / n)) for n in "sf")
    q = T.tool_durations(s, f, ["tool"]).writeStream.format("memory").queryName("took").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("took").first()["micros"] == 7_000_000


def test_promotion(spark):
    cases = spark.createDataFrame([("a", "c.toml", ["candidate", "x"], {"cve": "CVE-1"}), ("b", "c.toml", ["holdout"], {"cve": "CVE-2"}), ("d", "", [], {})], "case_id string, config string, tags array<string>, metadata map<string,string>")
    audit = spark.createDataFrame([("a", [], []), ("b", [], [])], "case_id string, errors array<string>, warnings array<string>")
    full = dict(status="completed", finding_count=1, verification_count=1, verification_passed=1, required_failure_count=0, policy_blocked_count=0, validation_gap_findings=0, unexpected_count=0, validation_covered=1, validation_step_count=1, tool_supported_findings=1, primary_findings=1, primary_hits=1, primary_expected=1, expected_hits=1, expected_total=1)
    ev = spark.createDataFrame([{"case_id": k} | full for k in ("a", "b")])
    exp = spark.createDataFrame([("a", None), ("b", "primary")], "case_id string, role string")
    none = spark.createDataFrame([], "case_id string")
    got = {r["case_id"]: r for r in A.plan_promotions(cases, audit, ev, none, exp).collect()}
    assert {k: r["status"] for k, r in got.items()} == {"a": "eligible", "b": "blocked", "d": "blocked"} and len(got["b"]["blockers"]) == 1
    assert "case is missing from audit result" in got["d"]["blockers"] and "evaluation evidence is required" in got["d"]["blockers"]
    assert [r["tags"] for r in A.promote(cases, A.plan_promotions(cases, audit, ev, none, exp)).collect()] == [["promoted", "x"]]
    again = A.plan_promotions(cases, audit, ev, cases.select("case_id"), exp)
    assert {r["status"] for r in again.collect()} == {"already-promoted"}


def test_miss_categories(spark):
    schema = "case_id string, exp_idx int, rule_id string, file_path string"
    misses = spark.createDataFrame([("c", 0, "expected-rule", "app.py"), ("d", 0, "expected-rule", "other.py"), ("e", 0, "r", None), ("f", 0, "r", "x")], schema)
    un = spark.createDataFrame([("c", 1, "f1", "wrong-rule", "app.py"), ("f", 1, "f2", "r", "y")], "case_id string, seq int, finding_id string, rule_id string, file_path string")
    got = {r["case_id"]: r["category"] for r in X.classify_misses(misses, un).collect()}
    assert got == {"c": "semantic-rule-confusion", "d": "undetected-labeled-location", "e": "undetected-expected-finding", "f": "rule-location-mismatch"}


def test_roles_and_errors(spark):
    f = spark.createDataFrame([("c", 1, "r", "tests/a.py", 5, 6, "high"), ("c", 2, "q", "a.py", 1, 1, "low")], "case_id string, seq int, rule_id string, file_path string, start_line int, end_line int, severity string")
    e = spark.createDataFrame([("c", 0, "r", None, None, None, None, "supporting"), ("c", 1, "r", "./tests/a.py", 6, None, "high", "negative-control")], "case_id string, exp_idx int, rule_id string, file_path string, start_line int, end_line int, severity string, role string")
    got = {r["seq"]: (r["role"], r["taxonomy"], r["matched_idx"]) for r in S.label_findings(f, e).collect()}
    assert got == {1: ("negative-control", "negative-control-violation", 1), 2: ("unexpected", "unlabeled-rule-or-location", None)}
    cases = spark.createDataFrame([("a", "d", None), ("b", None, None), ("c", "d", None)], "case_id string, diff string, diff_url string")
    status = {r["case_id"]: (r["status"], r["error"]) for r in S.case_errors(cases, cases.where("case_id = 'a'")).collect()}
    assert status == {"a": ("completed", None), "b": ("error", "no diff"), "c": ("error", "review failed")}


def test_tampering_shows(spark, tmp_path):
    for name in ("x", "y"):
        (tmp_path / name).write_text("one")
    index = I.artifact_index(I.read_artifacts(spark, str(tmp_path))).collect()
    index = spark.createDataFrame(index)
    (tmp_path / "x").write_text("two")
    (tmp_path / "y").unlink()
    got = {r["label"]: r for r in I.attest(index, I.artifact_index(I.read_artifacts(spark, str(tmp_path)))).collect()}
    assert len(got["x"]["failures"]) == 1 and "SHA-256 changed" in got["x"]["failures"][0] and "missing" in got["y"]["failures"][0]


def test_range_join_of_long_intervals(spark):
    rng = random.Random(5)
    top = [3, 70, 5_000, 400_000, 2**31 - 2]

    def some(n):
        rows = [(i, rng.choice("ab"), lo := rng.choice([rng.randint(0, 300), rng.randint(0, 2**31 - 2)]), min(lo + rng.randint(0, rng.choice(top)), 2**31 - 2)) for i in range(n)]
        return [*rows, (n, "a", 0, 2**31 - 2), (n + 1, "b", None, 5), (n + 2, None, 1, 5)]

    left, right = some(80), some(90)
    a, b = spark.createDataFrame(left, "i int, k string, lo int, hi int"), spark.createDataFrame(right, "j int, k string, lo2 int, hi2 int")
    full = lambda r: r[1] is not None and r[2] is not None
    want = sorted((x[0], y[0]) for x in left for y in right if full(x) and full(y) and x[1] == y[1] and x[2] <= y[3] and y[2] <= x[3])
    join = lambda how: range_join(a, b, ["k"], ("lo", "lo2"), ("hi", "hi2"), 64, how)
    assert sorted(map(tuple, join("inner").select("i", "j").collect())) == want
    met = {i for i, _ in want}
    assert {r["i"] for r in join("left_semi").collect()} == met
    assert sorted(r["i"] for r in join("left_anti").collect()) == sorted(x[0] for x in left if x[0] not in met)


def test_top_findings_counts_all(spark):
    f = spark.createDataFrame([("a", s) for s in range(9)] + [("b", 1), (None, 4), (None, 2)], "review_id string, seq int")
    got = sorted((str(r["review_id"]), r["seq"], r["total"], r["shown"]) for r in top_findings(f, n=3).collect())
    assert got == sorted([("a", s, 9, 3) for s in range(3)] + [("b", 1, 1, 1), ("None", 2, 2, 2), ("None", 4, 2, 2)])


def test_range_join_of_all_lengths_against_all_pairs(spark):
    import random

    some = random.Random(3)
    rows = lambda: [(some.randrange(2), x, x + some.choice([0, 0, 3, 63, 64, 511, 512, 5000]), k) for k, x in enumerate(some.randrange(-700, 9000) for _ in range(150))]
    left, right = rows(), rows()
    a, b = spark.createDataFrame(left, "k int, lo int, hi int, id int"), spark.createDataFrame(right, "k int, lo2 int, hi2 int, id2 int")
    want = sorted((p[3], q[3]) for p in left for q in right if p[0] == q[0] and p[1] <= q[2] and q[1] <= p[2])
    join = lambda how: range_join(a, b, ["k"], ("lo", "lo2"), ("hi", "hi2"), 8, how)
    assert sorted(map(tuple, join("inner").select("id", "id2").collect())) == want
    met = {p for p, _ in want}
    assert {r["id"] for r in join("left_semi").collect()} == met and {r["id"] for r in join("left_anti").collect()} == {p[3] for p in left} - met
    assert range_join(a, b.limit(0), ["k"], ("lo", "lo2"), ("hi", "hi2"), 8, "left_anti").count() == len(left)


def test_short_intervals_are_dealt_once(spark):
    from reviewlake.operators.joins import _dealt, _levels

    short = spark.createDataFrame([(1, x, x) for x in range(100)], "k int, lo int, hi int")
    assert _dealt(short, "lo", "hi", 64, _levels(short, "lo", "hi", 64)).count() == 100


def test_matches_are_attached_to_the_least_or_nearest_window(spark):
    import random

    from reviewlake.operators.taint import attach_to_window

    some = random.Random(4)
    windows = [(r, w, s, s + some.choice([0, 5, 40, 300]), some.random() < 0.3) for r in range(3) for w, s in enumerate(some.randrange(0, 2000) for _ in range(40))]
    matches = [(some.randrange(4), m, some.choice([None, some.randrange(-5, 2400)])) for m in range(300)]
    got = attach_to_window(spark.createDataFrame(matches, "r int, m int, sink_line int"), spark.createDataFrame(windows, "r int, window_id int, start_line int, end_line int, has_add boolean"), ["r"], ["m"])
    want = {}
    for r, m, x in matches:
        away = lambda w: (not w[4]) if x is None else -1 if w[2] <= x <= w[3] else min(abs(w[2] - x), abs(w[3] - x))  # noqa: E731, B023
        mine = [(away(w), w[1]) for w in windows if w[0] == r]
        if mine:
            want[(r, m)] = min(mine)[1]
    assert {(x["r"], x["m"]): x["window_id"] for x in got.collect()} == want
    assert "CartesianProduct" not in (plan := got._jdf.queryExecution().executedPlan().toString()) and "NestedLoop" not in plan


def test_the_running_ratchet_goes_on_after_a_restart(spark, tmp_path):
    schema = "suite string, finding_id int"
    batches = [[("s", 1), ("t", 2), ("s", 3)], [("s", 4), ("u", 5)], [("t", 6), ("t", 7)]]
    source, out, checkpoint = (str(tmp_path / n) for n in ("source", "out", "checkpoint"))

    def run() -> dict:
        q = T.running_ratchet(spark.readStream.schema(schema).parquet(source), 2, out, checkpoint)
        q.awaitTermination(120)
        assert q.exception() is None
        made = spark.read.parquet(out).withColumn("n", F.row_number().over(Window.partitionBy("suite").orderBy(F.desc("batch")))).where("n = 1")
        return {r["suite"]: (r["total"], r["exceeded"]) for r in made.collect()}

    rows = []
    for new in batches:  # each run is a query of its own, started from the checkpoint
        rows += new
        spark.createDataFrame(new, schema).coalesce(1).write.mode("append").parquet(source)
        assert run() == {r["suite"]: (r["total"], r["exceeded"]) for r in T.ratchet_totals(spark.createDataFrame(rows, schema), 2).collect()}
    assert any(p.suffix == ".zip" for p in (tmp_path / "checkpoint" / "state").rglob("*"))  # RocksDB's snapshots
