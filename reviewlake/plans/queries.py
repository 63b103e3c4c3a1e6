"""Registered queries of the change-review operators, with the DuckDB SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reviewlake.functions import columns as C
from reviewlake.operators import audits as A
from reviewlake.operators import failures as X
from reviewlake.operators import gates as G
from reviewlake.operators import integrity as I
from reviewlake.operators import joins as J
from reviewlake.operators import lines as L
from reviewlake.operators import rules as R
from reviewlake.operators import scoring as S
from reviewlake.operators import validation as V
from reviewlake.plans import bindings as B

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
KEYS = ("suite", "case_id")

quote = lambda s: "'" + s.replace("'", "''") + "'"
RULES = ", ".join(f"({i}, '{r}', '{s}', {c}, {quote(p)})" for i, (r, s, c, p) in enumerate(sorted(B.TEXT_RULES, key=lambda r: B.TEXT_RULES.index(r))))
WITH = rf"""WITH lines AS (SELECT doc_id, lang, source, i - 1 AS line_no, line FROM (SELECT doc_id, lang, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)),
rules(rule_ord, rule_id, severity, confidence, pattern) AS (VALUES {RULES}),
hits AS (SELECT l.*, r.rule_ord, r.rule_id, r.severity, r.confidence FROM lines l JOIN rules r ON regexp_matches(l.line, r.pattern)),
findings AS (SELECT lang AS suite, doc_id::VARCHAR AS case_id, line_no * 10 + rule_ord AS seq, rule_id, severity, confidence::DOUBLE AS confidence, source AS file_path, line_no + 1 AS start_line, line_no + 1 AS end_line, rule_id || '@' || doc_id || ':' || (line_no + 1) AS finding_id
  FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, rule_id, source, trim(line) ORDER BY line_no, rule_ord) AS n FROM hits) WHERE n = 1),
expected AS (SELECT d.lang AS suite, l.doc_id::VARCHAR AS case_id, 0 AS exp_idx, r.rule_id, CASE WHEN l.doc_id % 7 = 0 THEN d.source END AS file_path, CASE WHEN l.doc_id % 4 = 0 THEN 1 END AS start_line, CASE WHEN l.doc_id % 4 = 0 THEN 5 END AS end_line, CASE WHEN l.doc_id % 2 = 0 THEN r.severity END AS severity,
  CASE WHEN toxic = 1 THEN 'primary' WHEN quality = 0 THEN 'supporting' WHEN l.doc_id % 3 = 0 THEN 'benign' ELSE 'negative-control' END AS role
  FROM labels l JOIN documents d ON d.doc_id = l.doc_id JOIN rules r ON r.rule_ord = l.doc_id % 5),
matched AS (SELECT f.*, e.exp_idx, e.role FROM findings f JOIN expected e ON f.case_id = e.case_id AND f.rule_id = e.rule_id WHERE (e.severity IS NULL OR e.severity = f.severity) AND (e.file_path IS NULL OR e.file_path = f.file_path) AND (e.start_line IS NULL OR (f.start_line <= e.end_line AND e.start_line <= f.end_line))),
labelled AS (SELECT f.*, m.exp_idx AS matched_idx, coalesce(m.role, 'unexpected') AS role FROM findings f LEFT JOIN (SELECT case_id, seq, exp_idx, role FROM matched) m ON f.case_id = m.case_id AND f.seq = m.seq),
tagged AS (SELECT *, CASE WHEN role = 'negative-control' THEN 'negative-control-violation' WHEN role <> 'unexpected' THEN 'expected' ELSE 'unlabeled-rule-or-location' END AS taxonomy FROM labelled),
outcomes AS (SELECT e.*, EXISTS (SELECT 1 FROM matched m WHERE m.case_id = e.case_id AND m.exp_idx = e.exp_idx) AS hit FROM expected e WHERE role <> 'negative-control'),
per AS (SELECT case_id, count(*) AS finding_count, list(rule_id) AS found_rules, round(sum(confidence::DECIMAL(8,4)) / count(*), 2) AS avg_confidence FROM findings GROUP BY 1),
cases AS (SELECT d.lang AS suite, d.doc_id::VARCHAR AS case_id, d.doc_id, source, coalesce(finding_count, 0) AS finding_count, found_rules, coalesce(avg_confidence, 0.0) AS avg_confidence, r.rule_id AS expected_rule, d.doc_id % 4 AS validation_step_count, (d.doc_id % 4) // 2 AS validation_covered, d.doc_id % 2 AS tool_supported_findings, d.doc_id % 3 AS validation_gap_findings, CASE WHEN d.doc_id % 11 = 0 THEN 'error' ELSE 'completed' END AS status, CASE WHEN d.doc_id % 6 = 0 THEN 1 ELSE 0 END AS advisory, CASE WHEN d.doc_id % 4 = 3 THEN 1 ELSE 2 END AS verification_passed
  FROM documents d LEFT JOIN per p ON p.case_id = d.doc_id::VARCHAR LEFT JOIN labels l ON l.doc_id = d.doc_id LEFT JOIN rules r ON r.rule_ord = l.doc_id % 5) """
DIV = "CASE WHEN {1} = 0 THEN 0.0 ELSE ((20000 * {0} + {1}) // (2 * {1}))::DOUBLE / 10000.0 END"


def div(a: str, b: str) -> str:
    return DIV.format(f"({a})::BIGINT", f"({b})::BIGINT")


SUMMARY = f""", a AS (SELECT suite, count(*) AS case_count, count(*) FILTER (status = 'completed') AS completed_count, count(*) FILTER (status <> 'completed') AS error_count, sum(advisory)::BIGINT AS security_advisory_case_count,
  coalesce(sum(finding_count) FILTER (status = 'completed'), 0)::BIGINT AS finding_count, coalesce(sum(validation_step_count) FILTER (status = 'completed'), 0)::BIGINT AS steps, coalesce(sum(validation_covered) FILTER (status = 'completed'), 0)::BIGINT AS covered,
  coalesce(sum(tool_supported_findings) FILTER (status = 'completed'), 0)::BIGINT AS supported, coalesce(sum(validation_gap_findings) FILTER (status = 'completed'), 0)::BIGINT AS gaps,
  count(*) FILTER (status = 'completed' AND expected_rule IS NOT NULL) AS ruled, count(*) FILTER (status = 'completed' AND expected_rule IS NOT NULL AND list_contains(found_rules, expected_rule)) AS rule_hits,
  coalesce(sum(len(list_distinct(coalesce(found_rules, [])))) FILTER (status = 'completed' AND expected_rule IS NOT NULL), 0)::BIGINT AS found FROM cases GROUP BY 1),
b AS (SELECT suite, count(*) FILTER (role = 'primary') AS p, count(*) FILTER (role = 'supporting') AS s, count(*) FILTER (role = 'benign') AS g, count(*) FILTER (role = 'unexpected') AS u, count(*) FILTER (role = 'negative-control') AS nc FROM tagged WHERE case_id::BIGINT % 11 <> 0 GROUP BY 1),
c AS (SELECT suite, count(*) AS wanted, count(*) FILTER (hit) AS got, count(*) FILTER (role = 'primary') AS pw, count(*) FILTER (role = 'primary' AND hit) AS pg FROM outcomes WHERE case_id::BIGINT % 11 <> 0 GROUP BY 1),
summary AS (SELECT suite, case_count, completed_count, error_count, security_advisory_case_count, finding_count,
  CASE WHEN finding_count = 0 THEN 1.0 ELSE {div("coalesce(p,0)+coalesce(s,0)+coalesce(g,0)", "finding_count")} END AS accepted_finding_rate, {div("coalesce(p,0)", "finding_count")} AS primary_precision,
  CASE WHEN coalesce(pw, 0) > 0 THEN {div("pg", "pw")} END AS primary_finding_recall, {div("coalesce(s,0)", "finding_count")} AS supporting_evidence_rate, {div("coalesce(u,0)", "finding_count")} AS unexpected_finding_rate,
  coalesce(nc, 0) AS negative_control_violation_count, {div("finding_count", "completed_count")} AS avg_findings_per_case, CASE WHEN steps = 0 AND finding_count = 0 THEN 1.0 ELSE {div("covered", "steps")} END AS validation_coverage_rate,
  {div("supported", "finding_count")} AS tool_evidence_rate, {div("gaps", "finding_count")} AS validation_gap_rate, CASE WHEN ruled > 0 THEN {div("rule_hits", "ruled")} END AS expected_rule_recall,
  CASE WHEN ruled > 0 THEN {div("rule_hits", "found")} END AS expected_rule_precision, CASE WHEN coalesce(wanted, 0) > 0 THEN {div("got", "wanted")} END AS expected_finding_recall
  FROM a LEFT JOIN b USING (suite) LEFT JOIN c USING (suite)) """
SUMMARY_COLUMNS = [
    "suite", "case_count", "completed_count", "error_count", "security_advisory_case_count", "finding_count", "accepted_finding_rate", "primary_precision", "primary_finding_recall", "supporting_evidence_rate",
    "unexpected_finding_rate", "negative_control_violation_count", "avg_findings_per_case", "validation_coverage_rate", "tool_evidence_rate", "validation_gap_rate", "expected_rule_recall", "expected_rule_precision", "expected_finding_recall",
]


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


def longs(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("long") for n in names})


# ---- lines ------------------------------------------------------------------------------------------------

DIFF_SQL = """WITH p AS (SELECT doc_id, i - 1 AS i, line, CASE (i - 1) % 3 WHEN 0 THEN 'add' WHEN 1 THEN 'delete' ELSE 'context' END AS kind FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)),
k AS (SELECT *, line LIKE '++%' AND kind = 'add' OR line LIKE '--%' AND kind = 'delete' AS dropped FROM p),
changed AS (SELECT doc_id, i, line, kind, sum(CASE WHEN kind <> 'delete' THEN 1 ELSE 0 END) OVER w AS n, sum(CASE WHEN kind <> 'add' THEN 1 ELSE 0 END) OVER w AS o FROM k WHERE NOT dropped WINDOW w AS (PARTITION BY doc_id ORDER BY i)) """


def doc_diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A diff for each document: one header, one hunk, its lines prefixed by turns with '+', '-' and a space."""
    d = B.table(spark, sf_dir, "documents")
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.concat(F.element_at(F.array(F.lit("+"), F.lit("-"), F.lit(" ")), (i % 3 + 1).cast("int")), x))
    head = F.concat(F.lit("+++ b/"), "source", F.lit(".py\n@@ -1,9 +1,9 @@\n"))
    return d.select(F.col("doc_id").alias("review_id"), F.concat(head, F.array_join(lines, "\n")).alias("diff_text"))


@query("l1_changed_lines", DIFF_SQL + "SELECT doc_id AS review_id, CASE WHEN kind <> 'add' THEN o END::BIGINT AS old_line, CASE WHEN kind <> 'delete' THEN n END::BIGINT AS new_line, line AS content, kind AS change_type FROM changed")
def l1(spark, sf_dir):
    return longs(L.changed_lines(doc_diffs(spark, sf_dir)).select("review_id", "old_line", "new_line", "content", "change_type"), "old_line", "new_line")


@query("l2_effective_line", DIFF_SQL + "SELECT doc_id AS review_id, sum(CASE WHEN kind <> 'delete' THEN n ELSE o END)::BIGINT AS total, count(*) AS n FROM changed GROUP BY 1")
def l2(spark, sf_dir):
    x = L.changed_lines(doc_diffs(spark, sf_dir)).withColumn("e", C.effective_line("new_line", "old_line"))
    return x.groupBy("review_id").agg(F.sum("e").alias("total"), F.count(F.lit(1)).alias("n"))


EVENTS = "WITH e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS line FROM events) "
WINDOWS = EVENTS + """, t AS (SELECT user_id, line AS window_id, greatest(1, line - 3) AS lo, line + 3 AS hi FROM e WHERE event_type = 'error'),
m AS (SELECT t.*, e.line, e.event_type, row_number() OVER (PARTITION BY t.user_id, t.window_id ORDER BY e.line) AS n FROM t JOIN e ON e.user_id = t.user_id AND e.line BETWEEN t.lo AND t.hi) """


@query("l3_evidence_windows", WINDOWS + "SELECT user_id AS review_id, window_id, lo AS start_line, hi AS end_line, count(*) AS n_lines, string_agg(line::VARCHAR, ',' ORDER BY line) AS members FROM m WHERE n <= 6 GROUP BY 1, 2, 3, 4")
def l3(spark, sf_dir):
    w = L.evidence_windows(B.event_lines(spark, sf_dir), max_lines=6, triggers=("add",))
    w = w.select("review_id", "window_id", "start_line", "end_line", F.size("lines").alias("n_lines"), F.array_join(F.transform("lines", lambda x: x["seq"].cast("string")), ",").alias("members"))
    return longs(w, "window_id", "start_line", "end_line", "n_lines")


@query("l4_window_snippet", WINDOWS + "SELECT user_id AS review_id, window_id, string_agg(CASE WHEN event_type = 'error' THEN '+' ELSE ' ' END || line || ': ' || event_type, chr(10) ORDER BY line) AS snippet FROM m WHERE n <= 6 GROUP BY 1, 2")
def l4(spark, sf_dir):
    w = L.evidence_windows(B.event_lines(spark, sf_dir), max_lines=6, triggers=("add",))
    return longs(w.select("review_id", "window_id", C.snippet("lines").alias("snippet")), "window_id")


@query("l5_source_context", WINDOWS + """, s AS (SELECT user_id, max(line) AS n FROM e GROUP BY 1), w AS (SELECT DISTINCT m.user_id, window_id, greatest(1, lo - 2) AS a, least(s.n, hi + 2) AS b FROM m JOIN s ON s.user_id = m.user_id)
SELECT w.user_id AS review_id, window_id, a AS start_line, b AS end_line, count(e.line) AS n_lines, count(*) FILTER (e.event_type = 'error' AND e.line IN (SELECT line FROM m x WHERE x.user_id = w.user_id AND x.window_id = w.window_id AND x.n <= 6)) AS n_changed FROM w JOIN e ON e.user_id = w.user_id AND e.line BETWEEN a AND b GROUP BY 1, 2, 3, 4""")
def l5(spark, sf_dir):
    e = B.event_lines(spark, sf_dir)
    w = L.evidence_windows(e, max_lines=6, triggers=("add",))
    src = e.select("review_id", "file_path", F.col("new_line").alias("line_number"), "content")
    c = L.source_context(w, src, radius=2)
    return longs(c.select("review_id", "window_id", "start_line", "end_line", F.size("lines").alias("n_lines"), F.size(F.filter("lines", lambda x: x["role"] == "changed")).alias("n_changed")), "window_id", "start_line", "end_line", "n_lines", "n_changed")


ISLANDS = """WITH r AS (SELECT l_suppkey AS review_id, l_partkey::BIGINT AS lo, (l_partkey + l_quantity)::BIGINT AS hi FROM lineitem),
f AS (SELECT *, max(hi) OVER (PARTITION BY review_id ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM r),
g AS (SELECT *, sum(CASE WHEN before IS NULL OR lo > before + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY review_id ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS island FROM f),
merged AS (SELECT review_id, min(lo) AS lo, max(hi) AS hi FROM g GROUP BY review_id, island) """


@query("l6_merge_ranges", ISLANDS + "SELECT review_id, lo, hi FROM merged")
def l6(spark, sf_dir):
    return L.merge_ranges(B.intervals(spark, sf_dir), ["review_id"], "lo", "hi")


@query("l7_diff_scope", EVENTS + "SELECT user_id AS review_id, count(*) AS changed_line_count, count(*) AS window_count FROM e WHERE event_type = 'error' GROUP BY 1")
def l7(spark, sf_dir):
    return L.diff_scope(B.event_lines(spark, sf_dir))[1].select("review_id", "changed_line_count", "window_count")


OVERLAPS = """WITH a AS (SELECT l_suppkey AS review_id, l_orderkey, l_partkey::BIGINT AS lo, (l_partkey + l_quantity)::BIGINT AS hi FROM lineitem WHERE l_returnflag = 'R'), b AS (SELECT l_suppkey AS review_id, l_partkey::BIGINT AS lo, (l_partkey + l_quantity)::BIGINT AS hi FROM lineitem WHERE l_returnflag = 'A') """


@query("l8_split_in_scope", OVERLAPS + "SELECT review_id, count(*) FILTER (hit) AS inside, count(*) FILTER (NOT hit) AS outside FROM (SELECT a.*, NOT EXISTS (SELECT 1 FROM b WHERE b.review_id = a.review_id) OR EXISTS (SELECT 1 FROM b WHERE b.review_id = a.review_id AND a.lo <= b.hi AND b.lo <= a.hi) AS hit FROM a) GROUP BY 1")
def l8(spark, sf_dir):
    path = F.lit("./src/app.py").alias("file_path")
    f = B.intervals(spark, sf_dir, "R").select("review_id", path, (F.col("lo") + 1).alias("start_line"), (F.col("hi") + 1).alias("end_line"))
    ranges = L.merge_ranges(B.intervals(spark, sf_dir, "A").withColumns({"lo": F.col("lo") + 1, "hi": F.col("hi") + 1, "file_path": F.lit("app.py")}), ["review_id", "file_path"], "lo", "hi").withColumnsRenamed({"lo": "scope_start", "hi": "scope_end"})
    f = L.split_in_scope(f.select("review_id", F.xxhash64("review_id", "start_line", "end_line").alias("seq"), "file_path", "start_line", "end_line"), ranges)
    return f.groupBy("review_id").agg(F.count_if("in_scope").alias("inside"), F.count_if(~F.col("in_scope")).alias("outside"))


@query("l9_finding_samples", WITH + "SELECT suite, case_id, seq, rule_id FROM (SELECT *, row_number() OVER (PARTITION BY suite ORDER BY case_id, seq) AS n FROM findings) WHERE n <= 25")
def l9(spark, sf_dir):
    f = B.findings(spark, sf_dir).withColumnRenamed("seq", "s").withColumn("seq", F.struct("case_id", "s"))
    return longs(L.finding_samples(f, "suite").select("suite", "case_id", F.col("s").alias("seq"), "rule_id"), "seq")


@query("l10_normalize_path", "SELECT page_id, ltrim(replace('..\\' || url, '\\', '/'), './') AS path FROM pages")
def l10(spark, sf_dir):
    return B.table(spark, sf_dir, "pages").select("page_id", C.normalize_path(F.concat(F.lit("..\\"), "url")).alias("path"))


@query("l11_line_range_overlap", OVERLAPS + "SELECT review_id, count(*) AS n FROM (SELECT a.review_id FROM a JOIN b ON a.review_id = b.review_id WHERE a.lo <= b.hi AND b.lo <= a.hi) GROUP BY 1")
def l11(spark, sf_dir):
    b = B.intervals(spark, sf_dir, "A").withColumnsRenamed({"lo": "lo2", "hi": "hi2"})
    return J.range_join(B.intervals(spark, sf_dir, "R"), b, ["review_id"], ("lo", "lo2"), ("hi", "hi2"), 64).groupBy("review_id").agg(F.count(F.lit(1)).alias("n"))


@query("l12_is_python_path", "SELECT page_id, regexp_matches(lower(url || CASE page_id % 3 WHEN 0 THEN '.PY' WHEN 1 THEN '.pyi' ELSE '.pyc' END), '\\.pyi?$') AS is_python FROM pages")
def l12(spark, sf_dir):
    tail = F.element_at(F.array(F.lit(".PY"), F.lit(".pyi"), F.lit(".pyc")), (F.col("page_id") % 3 + 1).cast("int"))
    return B.table(spark, sf_dir, "pages").select("page_id", C.is_python_path(F.concat("url", tail)).alias("is_python"))


# ---- rules -------------------------------------------------------------------------------------------------


@query("r2_rule_scan", WITH + "SELECT doc_id, line_no, rule_id FROM hits")
def r2(spark, sf_dir):
    return longs(B.hits(spark, sf_dir).select("doc_id", "line_no", "rule_id"), "line_no")


@query("r4_mask_multiline_strings", """WITH e AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS line, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS q FROM events),
c AS (SELECT *, sum(q) OVER (PARTITION BY user_id ORDER BY line) AS upto, sum(q) OVER (PARTITION BY user_id) AS total FROM e)
SELECT user_id, count(*) FILTER ((upto % 2 = 1 OR (upto - q) % 2 = 1) AND (upto < total OR total % 2 = 0 OR ((upto - q) % 2 = 1 AND q > 0))) AS n_masked FROM c GROUP BY 1""")
def r4(spark, sf_dir):
    e = B.event_lines(spark, sf_dir).withColumn("content", F.when(F.col("content") == "error", '"""').otherwise("x"))
    m = R.mask_multiline_strings(e.withColumnRenamed("review_id", "user_id"), ["user_id"], "new_line")
    return m.groupBy("user_id").agg(F.count_if("masked").alias("n_masked"))


@query("r5_dedupe_findings", WITH + "SELECT case_id, seq, rule_id, file_path FROM findings")
def r5(spark, sf_dir):
    return longs(B.findings(spark, sf_dir).select("case_id", "seq", "rule_id", "file_path"), "seq")


@query("r7_supersede", WITH + "SELECT case_id, seq, rule_id FROM findings f WHERE NOT (rule_id = 'ipv4' AND EXISTS (SELECT 1 FROM findings g WHERE g.case_id = f.case_id AND g.file_path = f.file_path AND g.rule_id = 'phone'))")
def r7(spark, sf_dir):
    return longs(R.supersede(B.findings(spark, sf_dir), "phone", "ipv4", ["case_id", "file_path"]).select("case_id", "seq", "rule_id"), "seq")


@query("r8_build_findings", WITH + "SELECT case_id, seq, rule_id || '@' || file_path || ':' || start_line || '-' || end_line AS finding_id, severity, confidence FROM findings")
def r8(spark, sf_dir):
    f = R.build_findings(B.findings(spark, sf_dir).drop("finding_id"), B.text_rules(spark), "case_id")
    return longs(f.select("case_id", "seq", "finding_id", "severity", "confidence"), "seq")


@query("r9_min_confidence", WITH + "SELECT case_id, seq, rule_id FROM findings WHERE confidence >= 0.6")
def r9(spark, sf_dir):
    return longs(R.min_confidence(B.findings(spark, sf_dir), 0.6).select("case_id", "seq", "rule_id"), "seq")


# ---- scoring -----------------------------------------------------------------------------------------------


@query("e1_match_expected", WITH + "SELECT case_id, seq, rule_id, role FROM matched")
def e1(spark, sf_dir):
    m = S.match_expected(B.findings(spark, sf_dir), B.expected(spark, sf_dir), KEYS)
    return longs(m.select("case_id", "seq", "rule_id", F.col("e_role").alias("role")), "seq")


@query("e2_expected_hits_misses", WITH + "SELECT case_id, rule_id, role, hit FROM outcomes")
def e2(spark, sf_dir):
    return S.expected_hits_misses(B.findings(spark, sf_dir), B.expected(spark, sf_dir), KEYS).select("case_id", "rule_id", "role", "hit")


@query("e3_label_findings", WITH + "SELECT case_id, seq, role, matched_idx::BIGINT AS matched_idx FROM labelled")
def e3(spark, sf_dir):
    return longs(S.label_findings(B.findings(spark, sf_dir), B.expected(spark, sf_dir), KEYS).select("case_id", "seq", "role", "matched_idx"), "seq", "matched_idx")


@query("e4_finding_taxonomy", WITH + "SELECT case_id, seq, taxonomy FROM tagged")
def e4(spark, sf_dir):
    return longs(S.label_findings(B.findings(spark, sf_dir), B.expected(spark, sf_dir), KEYS).select("case_id", "seq", "taxonomy"), "seq")


@query("e5_role_counts", WITH + "SELECT suite, role, count(*) AS n FROM tagged GROUP BY 1, 2")
def e5(spark, sf_dir):
    return S.role_counts(S.label_findings(B.findings(spark, sf_dir), B.expected(spark, sf_dir), KEYS), ("suite",))


@query("e5_unexpected_taxonomy", WITH + "SELECT suite, taxonomy, count(*) AS n FROM tagged WHERE role NOT IN ('primary', 'supporting', 'benign') GROUP BY 1, 2")
def e5b(spark, sf_dir):
    return S.unexpected_taxonomy(S.label_findings(B.findings(spark, sf_dir), B.expected(spark, sf_dir), KEYS), ("suite",))


@query("e6_rule_set_diff", WITH + """SELECT case_id, CASE WHEN expected_rule IS NOT NULL AND list_contains(found_rules, expected_rule) THEN expected_rule ELSE '' END AS hits, CASE WHEN expected_rule IS NOT NULL AND NOT coalesce(list_contains(found_rules, expected_rule), false) THEN expected_rule ELSE '' END AS misses,
CASE WHEN expected_rule IS NULL THEN '' ELSE coalesce(array_to_string(list_sort(list_filter(list_distinct(found_rules), lambda x: x <> expected_rule)), ','), '') END AS unexpected, coalesce(array_to_string(list_sort(list_distinct(found_rules)), ','), '') AS found FROM cases""")
def e6(spark, sf_dir):
    d = S.rule_set_diff(B.cases(spark, sf_dir))
    join = lambda c: F.array_join(c, ",")
    return d.select("case_id", join("expected_rule_hits").alias("hits"), join("expected_rule_misses").alias("misses"), join("unexpected_rules").alias("unexpected"), join("found_rule_set").alias("found"))


@query("e7_case_metrics", WITH + "SELECT case_id, finding_count::BIGINT AS finding_count, validation_step_count::BIGINT AS validation_step_count, 0::BIGINT AS policy_blocked_count, 2::BIGINT AS verification_count FROM cases")
def e7(spark, sf_dir):
    return S.case_metrics(B.cases(spark, sf_dir)).select("case_id", "finding_count", "validation_step_count", "policy_blocked_count", "verification_count")


@query("e8_suite_summary", WITH + SUMMARY + f"SELECT {', '.join(SUMMARY_COLUMNS)} FROM summary")
def e8(spark, sf_dir):
    return B.summary(spark, sf_dir).select(SUMMARY_COLUMNS)


@query("e9_weighted_avg", "SELECT l_suppkey, CASE WHEN sum(l_quantity) = 0 THEN 0.0 ELSE ((2 * sum((l_discount * 100)::BIGINT * l_quantity::BIGINT) + sum(l_quantity::BIGINT)) // (2 * sum(l_quantity::BIGINT)))::DOUBLE / 100.0 END AS avg_discount FROM lineitem GROUP BY 1")
def e9(spark, sf_dir):
    return B.table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(C.weighted_avg("l_discount", "l_quantity").alias("avg_discount"))


@query("e10_rates", f"SELECT p_partkey, {div('p_partkey % 7', 'p_partkey % 13')} AS ratio, CASE WHEN p_partkey % 5 = 0 THEN 1.0 ELSE {div('p_partkey % 3', 'p_partkey % 5')} END AS accepted, CASE WHEN p_partkey % 4 = 0 AND p_partkey % 6 = 0 THEN 1.0 ELSE {div('p_partkey % 3', 'p_partkey % 4')} END AS coverage FROM part")
def e10(spark, sf_dir):
    k = F.col("p_partkey")
    return B.table(spark, sf_dir, "part").select("p_partkey", C.safe_div(k % 7, k % 13).alias("ratio"), C.accepted_rate(k % 3, k % 5).alias("accepted"), C.coverage_rate(k % 3, k % 4, k % 6).alias("coverage"))


@query("e11_tag_counts", "SELECT lang AS suite, tag, count(*) AS n FROM (SELECT lang, unnest([source, lang, 'all']) AS tag FROM documents) GROUP BY 1, 2")
def e11(spark, sf_dir):
    d = B.table(spark, sf_dir, "documents").select(F.col("lang").alias("suite"), F.array("source", "lang", F.lit("all")).alias("tags"))
    return S.tag_counts(d)


@query("e11_sum_maps", "SELECT lang AS suite, name, sum(n)::BIGINT AS n FROM (SELECT lang, source AS name, n_chars AS n FROM documents UNION ALL SELECT lang, 'docs', 1 FROM documents) GROUP BY 1, 2")
def e11b(spark, sf_dir):
    d = B.table(spark, sf_dir, "documents").select(F.col("lang").alias("suite"), F.create_map(F.col("source"), F.col("n_chars").cast("long"), F.lit("docs"), F.lit(1).cast("long")).alias("counts"))
    return S.sum_maps(d, ["suite"], "counts")


@query("e12_advisory_case_count", WITH + "SELECT suite, sum(advisory)::BIGINT AS n FROM cases GROUP BY 1")
def e12(spark, sf_dir):
    return B.cases(spark, sf_dir).groupBy("suite").agg(S.advisory_case_count(None, ["cve", "advisory", "upstream_pr"]).alias("n"))


@query("e13_resume", "SELECT doc_id, CASE WHEN doc_id IN (SELECT doc_id FROM labels) THEN 'resumed' ELSE 'to-run' END AS status FROM documents")
def e13(spark, sf_dir):
    todo, done = S.resume(B.table(spark, sf_dir, "documents").select("doc_id"), B.table(spark, sf_dir, "labels").select("doc_id"), ["doc_id"])
    return todo.withColumn("status", F.lit("to-run")).unionByName(done)


@query("e15_map_rules", WITH + "SELECT case_id, case_id || ':scanner:' || seq AS finding_id, CASE WHEN rule_id = 'email' THEN 'mail-address' WHEN rule_id = 'phone' THEN 'telephone' ELSE rule_id END AS rule_id, rule_id AS scanner_rule_id, CASE WHEN severity = 'low' THEN 'info' ELSE severity END AS severity FROM findings")
def e15(spark, sf_dir):
    none = F.lit(None).cast("string").alias("case_id")
    maps = B.text_rules(spark).where(F.col("rule_id").isin("email", "phone")).select(none, F.col("rule_id").alias("name"), F.when(F.col("rule_id") == "email", "mail-address").otherwise("telephone").alias("canonical"))
    severities = B.text_rules(spark).where(F.col("severity") == "low").select(none, F.col("severity").alias("name"), F.lit("info").alias("canonical"))
    return S.map_rules(B.findings(spark, sf_dir).drop("finding_id"), maps, severities).select("case_id", "finding_id", "rule_id", "scanner_rule_id", "severity")


@query("e17_benchmark_matrix", WITH + SUMMARY + "SELECT suite AS label, CASE WHEN suite IN ('en', 'de') THEN 'measured' ELSE 'skipped' END AS status, CASE WHEN suite IN ('en', 'de') THEN primary_precision END AS primary_precision, CASE WHEN suite IN ('en', 'de') THEN finding_count END AS finding_count, CASE WHEN suite IN ('en', 'de') THEN negative_control_violation_count END AS negative_control_violations FROM summary")
def e17(spark, sf_dir):
    s = B.summary(spark, sf_dir).withColumns({"name": F.col("suite"), "kind": F.lit("suite"), "status": F.lit("measured")})
    none = F.lit(None).cast("string")
    systems = s.select(F.col("suite").alias("label"), "suite", none.alias("baseline"), F.col("suite").alias("negative_suite"), none.alias("negative_baseline"), F.when(~F.col("suite").isin("en", "de"), "skipped").alias("display_status"))
    return S.benchmark_matrix(systems, s.drop("suite")).select("label", "status", "primary_precision", "finding_count", "negative_control_violations")


@query("e18_resolve_claims", WITH + SUMMARY + "SELECT suite AS claim_id, suite || ' has ' || case_count || ' cases, x {' || suite || ':nothing}' AS text, suite || ':nothing: unknown metric' AS errors FROM summary")
def e18(spark, sf_dir):
    s = B.summary(spark, sf_dir)
    metrics = s.select(F.col("suite").alias("system"), F.lit("case_count").alias("metric"), F.col("case_count").cast("string").alias("value"))
    templates = s.select(F.col("suite").alias("claim_id"), F.concat("suite", F.lit(" has {"), "suite", F.lit(":case_count} cases, x {"), "suite", F.lit(":nothing}")).alias("template"))
    return S.resolve_claims(templates, metrics).select("claim_id", "text", F.array_join("errors", "; ").alias("errors"))


@query("e19_case_id_slug", "SELECT page_id, CASE WHEN s = '' THEN 'case' ELSE s END AS slug FROM (SELECT page_id, trim(regexp_replace(url, '[^A-Za-z0-9_.-]+', '-', 'g'), '-') AS s FROM pages)")
def e19(spark, sf_dir):
    return B.table(spark, sf_dir, "pages").select("page_id", C.case_id_slug("url").alias("slug"))


# ---- failures ----------------------------------------------------------------------------------------------

FAIL = """, misses AS (SELECT * FROM outcomes WHERE NOT hit), un AS (SELECT * FROM tagged WHERE role = 'unexpected'),
ff AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY case_id, file_path ORDER BY seq) AS n FROM un) WHERE n = 1), fr AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY case_id, rule_id ORDER BY seq) AS n FROM un) WHERE n = 1),
classified AS (SELECT m.case_id, m.rule_id AS expected_rule_id, CASE WHEN ff.finding_id IS NOT NULL AND ff.rule_id <> m.rule_id THEN 'semantic-rule-confusion' WHEN fr.finding_id IS NOT NULL THEN 'rule-location-mismatch' WHEN m.file_path IS NOT NULL THEN 'undetected-labeled-location' ELSE 'undetected-expected-finding' END AS category,
  CASE WHEN ff.finding_id IS NOT NULL AND ff.rule_id <> m.rule_id THEN ff.finding_id ELSE fr.finding_id END AS actual_finding_id FROM misses m LEFT JOIN ff ON ff.case_id = m.case_id AND ff.file_path = m.file_path LEFT JOIN fr ON fr.case_id = m.case_id AND fr.rule_id = m.rule_id),
failures AS (SELECT case_id, category FROM classified UNION ALL SELECT case_id, 'unexpected-finding' FROM un WHERE NOT EXISTS (SELECT 1 FROM classified c WHERE c.case_id = un.case_id AND c.actual_finding_id = un.finding_id) UNION ALL SELECT case_id, 'execution-error' FROM cases WHERE status = 'error') """


def _misses(spark, sf_dir):
    f, e = B.findings(spark, sf_dir), B.expected(spark, sf_dir)
    return S.expected_hits_misses(f, e, KEYS).where("not hit"), S.label_findings(f, e, KEYS).where("role = 'unexpected'")


@query("f1_classify_misses", WITH + FAIL + "SELECT case_id, expected_rule_id, category, actual_finding_id FROM classified")
def f1(spark, sf_dir):
    return X.classify_misses(*_misses(spark, sf_dir)).select("case_id", "expected_rule_id", "category", "actual_finding_id")


@query("f2_unexplained_findings", WITH + FAIL + "SELECT case_id, finding_id, 'unexpected-finding' AS category FROM un WHERE NOT EXISTS (SELECT 1 FROM classified c WHERE c.case_id = un.case_id AND c.actual_finding_id = un.finding_id)")
def f2(spark, sf_dir):
    m, u = _misses(spark, sf_dir)
    return X.unexplained_findings(u, X.classify_misses(m, u)).select("case_id", "finding_id", "category")


@query("f3_execution_errors", WITH + "SELECT case_id, 'execution-error' AS category, 'unknown evaluation error' AS error FROM cases WHERE status = 'error'")
def f3(spark, sf_dir):
    return X.execution_errors(B.cases(spark, sf_dir).withColumn("error", F.lit("")))


@query("f4_failure_summary", WITH + FAIL + "SELECT count(DISTINCT f.case_id) AS cases_with_failures, count(*) AS failure_count, count(*) FILTER (c.verification_passed = 2) AS verified_failure_count FROM failures f JOIN cases c ON c.case_id = f.case_id")
def f4(spark, sf_dir):
    return X.failure_summary(X.failures(*_misses(spark, sf_dir), B.cases(spark, sf_dir)))[0]


@query("f4_failure_taxonomy", WITH + FAIL + "SELECT category, count(*) AS n FROM failures GROUP BY 1")
def f4b(spark, sf_dir):
    return X.failure_summary(X.failures(*_misses(spark, sf_dir), B.cases(spark, sf_dir)))[1]


# ---- validation --------------------------------------------------------------------------------------------

CHECKS = ["unit tests for malicious input", "static taint analysis", "SQL injection regression test", "crypto policy check", "fuzz the parser", "integration test", "semgrep rule", "something else"]
TOOLS = [("pytest", "pytest -q", "unit-test"), ("semgrep", "semgrep scan", "static-analysis"), ("atheris", "python fuzz.py", "fuzzing"), ("db-check", "sqlmap", "sql-injection"), ("lint", "ruff check", "crypto-policy")]


@query("v2_check_matches_run", """SELECT e.event_id, CASE WHEN c LIKE '%semgrep%' THEN cap = 'semgrep' WHEN c LIKE '%unit%' THEN cap IN ('unit-test', 'regression-test') WHEN c LIKE '%regression%' THEN cap IN ('unit-test', 'regression-test') WHEN c LIKE '%sql%' THEN cap IN ('sql-injection', 'static-analysis') WHEN c LIKE '%taint%' THEN false WHEN c LIKE '%static%' THEN cap = 'static-analysis' WHEN c LIKE '%integration%' THEN cap IN ('integration-test', 'regression-test') WHEN c LIKE '%fuzz%' THEN cap = 'fuzzing' WHEN c LIKE '%crypto%' THEN cap IN ('crypto-policy', 'static-analysis') ELSE false END
OR CASE WHEN c LIKE '%unit%' OR c LIKE '%regression%' THEN name LIKE '%test%' OR cmd LIKE '%pytest%' WHEN c LIKE '%static%' OR c LIKE '%taint%' THEN name IN ('semgrep') OR cmd LIKE '%ruff%' WHEN c LIKE '%semgrep%' THEN name = 'semgrep' WHEN c LIKE '%fuzz%' THEN name = 'atheris' WHEN c LIKE '%crypto%' THEN name = 'semgrep' WHEN c LIKE '%sql%' THEN true ELSE (name || ' ' || cmd) LIKE '%' || c || '%' END AS matches
FROM (SELECT event_id, lower(list_extract(['unit tests for malicious input', 'static taint analysis', 'SQL injection regression test', 'crypto policy check', 'fuzz the parser', 'integration test', 'semgrep rule', 'something else'], (event_id % 8 + 1)::INT)) AS c, list_extract(['pytest', 'semgrep', 'atheris', 'db-check', 'lint'], (event_id % 5 + 1)::INT) AS name, list_extract(['pytest -q', 'semgrep scan', 'python fuzz.py', 'sqlmap', 'ruff check'], (event_id % 5 + 1)::INT) AS cmd, list_extract(['unit-test', 'static-analysis', 'fuzzing', 'sql-injection', 'crypto-policy'], (event_id % 5 + 1)::INT) AS cap FROM events) e""")
def v2(spark, sf_dir):
    pick = lambda values, n: F.element_at(F.array(*map(F.lit, values)), (F.col("event_id") % n + 1).cast("int"))
    name, command, cap = (pick([t[k] for t in TOOLS], 5) for k in range(3))
    return B.table(spark, sf_dir, "events").select("event_id", V.check_matches_run(pick(CHECKS, 8), name, command, F.array(cap)).alias("matches"))


@query("v3_tool_overlap", OVERLAPS + "SELECT a.review_id, a.l_orderkey, count(*) AS n FROM a JOIN b ON a.review_id = b.review_id WHERE a.lo <= b.hi AND b.lo <= a.hi GROUP BY 1, 2")
def v3(spark, sf_dir):
    x = B.table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("review_id"), "l_orderkey", "l_returnflag", F.lit("a/b.py").alias("file_path"), F.col("l_partkey").cast("long").alias("start_line"), (F.col("l_partkey") + F.col("l_quantity")).cast("long").alias("end_line"))
    tools = x.where("l_returnflag = 'A'").select("review_id", F.lit("./a/b.py").alias("file_path"), "start_line", "end_line")
    return V.tool_overlap(x.where("l_returnflag = 'R'"), tools).groupBy("review_id", "l_orderkey").agg(F.count(F.lit(1)).alias("n"))


@query("v4_marker_match", WITH + """, m AS (SELECT case_id, rule_id AS m_rule, file_path AS m_path, start_line AS m_start, finding_id AS m_id, seq % 3 AS k FROM findings)
SELECT f.case_id, f.finding_id, count(*) AS n FROM findings f JOIN m ON f.case_id = m.case_id AND CASE m.k WHEN 0 THEN f.finding_id = m.m_id WHEN 1 THEN f.rule_id = m.m_rule ELSE f.file_path = m.m_path AND f.start_line = m.m_start END GROUP BY 1, 2""")
def v4(spark, sf_dir):
    f = B.findings(spark, sf_dir)
    k = F.col("seq") % 3
    markers = f.select("case_id", F.when(k == 0, F.col("finding_id")).alias("finding_id"), F.when(k == 1, F.col("rule_id")).alias("rule_id"), F.when(k == 2, F.col("file_path")).alias("file_path"), F.when(k == 2, F.col("start_line")).alias("start_line"), F.when(k == 2, F.col("start_line")).alias("end_line"), F.lit("").alias("check"))
    return V.marker_match(f.withColumn("recommended_check", F.lit("scan")), markers, "case_id").groupBy("case_id", "finding_id").agg(F.count(F.lit(1)).alias("n"))


@query("v6_calibrate", "SELECT l_orderkey, l_linenumber, l_partkey, round(greatest(0, least(0.99, l_discount::DECIMAL(10,4) * 9 + CASE WHEN l_quantity % 5 = 0 THEN -0.04 ELSE CASE WHEN l_linenumber % 2 = 0 THEN 0.12 ELSE 0 END - CASE WHEN l_partkey % 3 = 0 THEN 0.08 ELSE 0 END - least(0.10, (l_quantity::INT % 4) * 0.04) END)), 2)::DOUBLE AS confidence FROM lineitem")
def v6(spark, sf_dir):
    q = F.col("l_quantity").cast("int")
    base = F.col("l_discount").cast("decimal(10,4)") * 9
    return B.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", V.calibrated(base, q % 5, F.col("l_linenumber") % 2 == 0, F.col("l_partkey") % 3 == 0, q % 4).alias("confidence"))


@query("v7_review_summary", WITH + "SELECT case_id, count(*) AS finding_count, round(sum(confidence::DECIMAL(8,4)) / count(*), 2) AS avg_confidence, count(*) FILTER (severity = 'medium') AS medium FROM findings GROUP BY 1")
def v7(spark, sf_dir):
    f = B.findings(spark, sf_dir).withColumn("confidence_notes", F.lit(""))
    none = lambda schema: f.sparkSession.createDataFrame([], schema)
    runs = none("case_id string, name string, required boolean, exit_code int, timed_out boolean, policy_status string, artifact_count int, policy_warnings array<string>")
    s = V.review_summary(f.select("case_id"), f, runs, none("case_id string, status string, tool_evidence array<string>"), none("case_id string"), "case_id")
    return s.select("case_id", "finding_count", "avg_confidence", F.coalesce(F.try_element_at("severity_counts", F.lit("medium")), F.lit(0)).alias("medium"))


@query("v8_policy_audit", "SELECT event_id, CASE WHEN event_type NOT IN ('click', 'view') OR event_id % 700 > 600 OR lower(event_type || ' x') LIKE '%error%' OR user_id % 2 = 1 THEN 'blocked' ELSE 'allowed' END AS policy_status FROM events")
def v8(spark, sf_dir):
    policy = spark.range(1).select(F.lit(True).alias("enabled"), F.array(F.lit("click"), F.lit("view")).alias("allowed_adapters"), F.array(F.lit("/usr/bin/tool0")).alias("allowed_executables"), F.array(F.lit("ERROR")).alias("blocked_command_patterns"), F.lit(600).alias("max_timeout_seconds"), F.lit(10).alias("max_output_bytes"), F.lit("minimal").alias("environment_mode"), F.lit("inherit").alias("network_access"))
    c = B.table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("adapter"), F.concat("event_type", F.lit(" x")).alias("command"), (F.col("event_id") % 700).alias("timeout_seconds"), F.array(F.concat(F.lit("tool"), (F.col("user_id") % 2).cast("string"))).alias("argv"))
    return V.policy_audit(c, policy).select("event_id", "policy_status")


# ---- audits ------------------------------------------------------------------------------------------------


@query("a1_duplicate_keys", "SELECT sha256(text) AS key, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1")
def a1(spark, sf_dir):
    return A.duplicate_keys(B.table(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("key")), "key")


@query("a3_label_status", WITH + "SELECT case_id, role || ':1' AS label_summary, role IN ('primary', 'supporting') AS has_positive_label, role = 'negative-control' AS has_negative_control, CASE WHEN role IN ('primary', 'supporting') THEN CASE WHEN file_path IS NULL THEN 1 ELSE 0 END + CASE WHEN severity IS NULL THEN 1 ELSE 0 END ELSE 0 END + CASE WHEN role = 'supporting' THEN 1 ELSE 0 END AS n_warnings FROM expected")
def a3(spark, sf_dir):
    e = B.expected(spark, sf_dir)
    return A.label_status(e.select("case_id").distinct(), e, ["case_id"]).select("case_id", "label_summary", "has_positive_label", "has_negative_control", F.size("label_warnings").alias("n_warnings"))


AUDIT = """, au AS (SELECT d.lang AS suite, d.doc_id::VARCHAR AS case_id, CASE WHEN d.doc_id % 3 = 0 THEN 2 WHEN d.doc_id % 3 = 1 THEN 1 ELSE 0 END AS src, e.role, e.file_path, e.severity,
  CASE WHEN d.doc_id % 3 = 2 THEN 1 ELSE 0 END AS errs, CASE WHEN d.doc_id % 3 = 0 THEN 'git-pair' WHEN d.doc_id % 3 = 1 THEN 'remote-diff' ELSE 'missing' END AS source_kind FROM documents d LEFT JOIN expected e ON e.case_id = d.doc_id::VARCHAR),
audit AS (SELECT suite, case_id, CASE WHEN errs > 0 THEN 'blocked' ELSE 'ready' END AS status, source_kind, errs AS n_errors,
  CASE WHEN source_kind = 'remote-diff' THEN 1 ELSE 0 END + CASE WHEN role IS NULL THEN 1 ELSE 0 END + CASE WHEN role IN ('primary', 'supporting') THEN CASE WHEN file_path IS NULL THEN 1 ELSE 0 END + CASE WHEN severity IS NULL THEN 1 ELSE 0 END + 2 ELSE 0 END + CASE WHEN role = 'supporting' THEN 1 ELSE 0 END + 2 + CASE WHEN role = 'negative-control' THEN 1 ELSE 0 END AS n_warnings, coalesce(role IN ('primary', 'supporting'), false) AS positive FROM au) """


def _audit(spark, sf_dir):
    d = B.table(spark, sf_dir, "documents")
    k = F.col("doc_id") % 3
    none = F.lit(None).cast("string")
    c = d.select(F.col("lang").alias("suite"), F.col("doc_id").cast("string").alias("case_id"), F.col("doc_id").alias("seq"), none.alias("diff"), F.when(k == 1, "https://x/y").alias("diff_url"), none.alias("repo"), F.when(k == 0, "https://r").alias("repo_url"), F.when(k == 0, "a").alias("base_ref"), F.when(k == 0, "b").alias("head_ref"), none.alias("config"), F.array(F.col("lang")).alias("tags"), F.create_map(F.lit("language"), F.col("lang")).alias("metadata"))
    return A.case_audit(c, B.expected(spark, sf_dir), spark.createDataFrame([], "path string"))


@query("a4_case_audit", WITH + AUDIT + "SELECT case_id, status, source_kind, n_errors, n_warnings FROM audit")
def a4(spark, sf_dir):
    return _audit(spark, sf_dir).select("case_id", "status", "source_kind", F.size("errors").alias("n_errors"), F.size("warnings").alias("n_warnings"))


@query("a5_audit_summary", WITH + AUDIT + "SELECT suite, count(*) AS case_count, count(*) FILTER (status = 'ready') AS ready_count, sum(n_errors)::BIGINT AS error_count, sum(n_warnings)::BIGINT AS warning_count, count(*) FILTER (positive) AS positive_case_count, CASE WHEN sum(n_errors) > 0 THEN 'blocked' ELSE 'ready-with-warnings' END AS status FROM audit GROUP BY 1")
def a5(spark, sf_dir):
    return A.audit_summary(_audit(spark, sf_dir)).select("suite", "case_count", "ready_count", "error_count", "warning_count", "positive_case_count", "status")


PROMOTE = f""", ev AS (SELECT case_id, status, finding_count, CASE WHEN validation_step_count > 0 THEN {div('validation_covered', 'validation_step_count')} END AS coverage, CASE WHEN finding_count > 0 THEN {div('tool_supported_findings', 'finding_count')} END AS evidence, verification_passed, validation_gap_findings, doc_id FROM cases) """


def _evaluation(spark, sf_dir):
    c = B.cases(spark, sf_dir)
    zero = {n: F.lit(0) for n in ("required_failure_count", "policy_blocked_count", "unexpected_count")}
    return A.evidence_metrics(c.withColumns(zero | {n: F.lit(1) for n in ("primary_findings", "primary_hits", "primary_expected", "expected_hits", "expected_total")}))


@query("a7_evaluation_blockers", WITH + PROMOTE + "SELECT case_id, CASE WHEN status <> 'completed' THEN 1 ELSE 0 END + CASE WHEN finding_count = 0 THEN 1 ELSE 0 END + CASE WHEN verification_passed < 2 THEN 1 ELSE 0 END + CASE WHEN validation_gap_findings > 0 THEN 1 ELSE 0 END + CASE WHEN coverage IS NULL OR coverage < 1 THEN 1 ELSE 0 END + CASE WHEN evidence IS NULL OR evidence < 1 THEN 1 ELSE 0 END + CASE WHEN finding_count = 0 OR finding_count > 2 THEN 1 ELSE 0 END AS n FROM ev")
def a7(spark, sf_dir):
    return _evaluation(spark, sf_dir).select("case_id", F.size(A.evaluation_blockers()).alias("n"))


@query("a8_evidence_metrics", WITH + PROMOTE + "SELECT case_id, coverage AS validation_coverage, evidence AS tool_evidence_rate FROM ev")
def a8(spark, sf_dir):
    return _evaluation(spark, sf_dir).select("case_id", "validation_coverage", "tool_evidence_rate")


@query("a6_plan_promotions", WITH + AUDIT + "SELECT case_id, CASE WHEN case_id::BIGINT % 9 = 0 THEN 'already-promoted' ELSE 'blocked' END AS status, CASE WHEN case_id::BIGINT % 9 = 0 THEN 0 ELSE n_errors + n_warnings + 2 + CASE WHEN NOT EXISTS (SELECT 1 FROM expected e WHERE e.case_id = audit.case_id AND e.role = 'primary') THEN 1 ELSE 0 END + CASE WHEN case_id::BIGINT % 6 = 0 THEN 0 ELSE 1 END END AS n FROM audit")
def a6(spark, sf_dir):
    d = B.table(spark, sf_dir, "documents")
    c = d.select(F.col("doc_id").cast("string").alias("case_id"), F.lit("").alias("config"), F.array(F.lit("candidate")).alias("tags"), F.when(F.col("doc_id") % 6 == 0, F.create_map(F.lit("cve"), F.lit("CVE-1"))).alias("metadata"))
    done = d.where("doc_id % 9 = 0").select(F.col("doc_id").cast("string").alias("case_id"))
    none = _evaluation(spark, sf_dir).where("false")
    p = A.plan_promotions(c, _audit(spark, sf_dir), none, done, B.expected(spark, sf_dir))
    return p.select("case_id", "status", F.size("blockers").alias("n"))


@query("a9_promote", "SELECT doc_id::VARCHAR AS case_id, 'promoted,' || lang AS tags FROM documents WHERE doc_id % 2 = 0")
def a9(spark, sf_dir):
    d = B.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("case_id"), F.array(F.lit("candidate"), F.col("lang")).alias("tags"), F.when(F.col("doc_id") % 2 == 0, "eligible").otherwise("blocked").alias("status"))
    return A.promote(d.drop("status"), d.drop("tags")).select("case_id", F.array_join("tags", ",").alias("tags"))


@query("a10_fingerprints", "SELECT case_id, fingerprint FROM (SELECT page_id::VARCHAR AS case_id, unnest(['case-id:' || page_id, 'diff-url:' || lower(rtrim(url, '/')), 'cve:cve-' || (page_id % 50)]) AS fingerprint FROM pages)")
def a10(spark, sf_dir):
    none = F.lit(None).cast("string")
    p = B.table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("case_id"), none.alias("repo"), none.alias("repo_url"), none.alias("base_ref"), none.alias("head_ref"), F.col("url").alias("diff_url"), F.create_map(F.lit("cve"), F.concat(F.lit(" CVE-"), (F.col("page_id") % 50).cast("string"))).alias("metadata"))
    return A.fingerprints(p)


PRINTS = "WITH l AS (SELECT DISTINCT doc_id, sha256(trim(lower(x))) AS f FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x FROM documents) WHERE trim(x) <> ''), r AS (SELECT DISTINCT item_id, sha256(trim(lower(x))) AS f FROM (SELECT item_id, unnest(string_split(text, chr(10))) AS x FROM benchmark) WHERE trim(x) <> '') "


@query("a11_partition_overlap", PRINTS + "SELECT doc_id, item_id, count(*) AS n FROM l JOIN r ON l.f = r.f GROUP BY 1, 2")
def a11(spark, sf_dir):
    def prints(name, key):
        x = B.table(spark, sf_dir, name).select(key, F.explode(F.split("text", "\n")).alias("x")).where("trim(x) <> ''")
        return x.select(key, F.sha2(F.trim(F.lower("x")), 256).alias("fingerprint"))

    return A.partition_overlap(prints("documents", "doc_id"), prints("benchmark", "item_id"), "doc_id", "item_id").select("doc_id", "item_id", F.size("reasons").cast("long").alias("n"))


# ---- gates -------------------------------------------------------------------------------------------------

GATED = [m for m in G.GATE if m in SUMMARY_COLUMNS]
LONG = ", lm AS (" + " UNION ALL ".join(f"SELECT suite, '{m}' AS metric, coalesce({m}, 0)::DOUBLE AS value FROM summary" for m in GATED) + "), th(metric, op, bound) AS (VALUES ('primary_precision', 'min', 0.2), ('accepted_finding_rate', 'min', 0.5), ('validation_gap_rate', 'max', 1.0), ('negative_control_violation_count', 'max', 0.0), ('error_count', 'max', 10.0)) "


def _thresholds(spark, sf_dir):
    rows = [("primary_precision", "min", 0.2), ("accepted_finding_rate", "min", 0.5), ("validation_gap_rate", "max", 1.0), ("negative_control_violation_count", "max", 0.0), ("error_count", "max", 10.0)]
    return B.table(spark, sf_dir, "documents").select(F.col("lang").alias("suite")).distinct().select("suite", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.lit(o).alias("op"), F.lit(b).alias("bound")) for m, o, b in rows])).alias("t")).select("suite", "t.metric", "t.op", "t.bound")


@query("g1_gate_metrics", WITH + SUMMARY + LONG + "SELECT suite, metric, value FROM lm")
def g1(spark, sf_dir):
    return G.gate_metrics(B.summary(spark, sf_dir).select(SUMMARY_COLUMNS))


FAILED = "(op = 'min' AND value < bound) OR (op = 'max' AND value > bound)"


@query("g2_gate", WITH + SUMMARY + LONG + f"SELECT suite, count(*) FILTER ({FAILED}) = 0 AS passed, count(*) FILTER ({FAILED}) AS n FROM th JOIN lm USING (metric) GROUP BY 1")
def g2(spark, sf_dir):
    return G.gate(G.gate_metrics(B.summary(spark, sf_dir)), _thresholds(spark, sf_dir)).select("suite", "passed", F.size("failures").cast("long").alias("n"))


@query("g3_release_matrix", WITH + SUMMARY + "SELECT count(*) AS suite_count, sum(case_count)::BIGINT AS total_cases, sum(finding_count)::BIGINT AS total_findings FROM summary")
def g3(spark, sf_dir):
    s = B.summary(spark, sf_dir)
    return G.release_matrix(s, G.gate(G.gate_metrics(s), _thresholds(spark, sf_dir)))[1].select("suite_count", "total_cases", "total_findings")


def _worse(spark, sf_dir):
    m = G.gate_metrics(B.summary(spark, sf_dir).select(SUMMARY_COLUMNS))
    return G.regressions(m.where("suite <> 'es'").withColumn("value", F.when(F.col("suite") == "en", F.col("value") / 2).otherwise(F.col("value") * 2)), m)


WORSE = """, worse AS (SELECT suite, metric, value AS baseline, CASE WHEN suite = 'en' THEN value / 2 ELSE value * 2 END AS current FROM lm WHERE suite <> 'es' AND value > 0 AND CASE WHEN suite = 'en' THEN metric IN ('validation_coverage_rate', 'accepted_finding_rate', 'primary_precision', 'primary_finding_recall', 'supporting_evidence_rate', 'tool_evidence_rate') ELSE metric IN ('error_count', 'validation_gap_rate', 'unexpected_finding_rate', 'negative_control_violation_count') END UNION ALL SELECT 'es', 'suite_presence', 1.0, 0.0 WHERE EXISTS (SELECT 1 FROM summary WHERE suite = 'es')) """


@query("g4_regressions", WITH + SUMMARY + LONG + WORSE + "SELECT suite, metric, baseline, current FROM worse")
def g4(spark, sf_dir):
    return _worse(spark, sf_dir)


@query("g5_portfolio_verdict", WITH + AUDIT + SUMMARY + LONG + WORSE + f", go AS (SELECT suite, count(*) FILTER ({FAILED}) AS n FROM th JOIN lm USING (metric) GROUP BY 1), ol AS (SELECT DISTINCT doc_id FROM documents WHERE text IN (SELECT text FROM benchmark)) SELECT 'partition-overlap' AS kind, doc_id::VARCHAR AS subject FROM ol UNION ALL SELECT 'case-audit', suite FROM (SELECT suite, sum(n_errors) AS e FROM audit GROUP BY 1) WHERE e > 0 UNION ALL SELECT 'gate', suite FROM go WHERE n > 0 UNION ALL SELECT 'regression', suite || ':' || metric FROM worse")
def g5(spark, sf_dir):
    overlap = B.table(spark, sf_dir, "documents").join(B.table(spark, sf_dir, "benchmark").select("text"), "text", "left_semi").select("doc_id").distinct()
    gates = G.gate(G.gate_metrics(B.summary(spark, sf_dir)), _thresholds(spark, sf_dir))
    return G.portfolio_verdict(overlap, A.audit_summary(_audit(spark, sf_dir)), gates, _worse(spark, sf_dir))


@query("g6_table_freshness", "SELECT doc_id, lang, CASE WHEN doc_id % 50 = 0 THEN 'changed' ELSE source END AS source, side FROM (SELECT doc_id, lang, source, 'actual' AS side FROM documents WHERE doc_id % 50 = 0) UNION ALL SELECT doc_id, lang, source, 'expected' FROM documents WHERE doc_id % 50 = 0")
def g6(spark, sf_dir):
    d = B.table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    return G.table_freshness(d, d.withColumn("source", F.when(F.col("doc_id") % 50 == 0, "changed").otherwise(F.col("source"))))


# ---- integrity ---------------------------------------------------------------------------------------------


def _index(spark, sf_dir):
    d = B.table(spark, sf_dir, "documents").select(F.col("source").alias("label"), F.col("lang").alias("kind"), F.col("doc_id").cast("string").alias("path"), F.encode("text", "utf-8").alias("content"))
    return I.artifact_index(d), d


@query("i1_artifact_index", "SELECT source AS label, lang AS kind, doc_id::VARCHAR AS path, strlen(text)::BIGINT AS bytes, sha256(text) AS sha256 FROM documents")
def i1(spark, sf_dir):
    return _index(spark, sf_dir)[0]


@query("i2_attest", "SELECT doc_id::VARCHAR AS path, doc_id % 10 NOT IN (0, 1) AS passed, CASE WHEN doc_id % 10 = 0 THEN 1 WHEN doc_id % 10 = 1 THEN 2 ELSE 0 END AS n FROM documents")
def i2(spark, sf_dir):
    index, d = _index(spark, sf_dir)
    k = F.col("path").cast("long") % 10
    now = I.artifact_index(d.where(k != 0).withColumn("content", F.when(k == 1, F.concat("content", F.encode(F.lit("x"), "utf-8"))).otherwise(F.col("content"))))
    return I.attest(index, now).select("path", "passed", F.size("failures").alias("n"))


@query("i3_top_findings", WITH + "SELECT suite, case_id, seq, total, least(5, total) AS shown FROM (SELECT *, row_number() OVER (PARTITION BY suite ORDER BY case_id, seq) AS n, count(*) OVER (PARTITION BY suite) AS total FROM findings) WHERE n <= 5")
def i3(spark, sf_dir):
    f = B.findings(spark, sf_dir).withColumn("s", F.col("seq")).withColumn("seq", F.struct("case_id", "s"))
    return longs(I.top_findings(f, "suite").select("suite", "case_id", F.col("s").alias("seq"), "total", "shown"), "seq", "shown")


@query("i4_order_findings", WITH + "SELECT finding_id, severity, confidence FROM findings ORDER BY CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 WHEN 'low' THEN 3 ELSE 99 END, confidence DESC, file_path, start_line")
def i4(spark, sf_dir):
    return I.order_findings(B.findings(spark, sf_dir)).select("finding_id", "severity", "confidence")


@query("i5_plan_upserts", "SELECT l.doc_id AS review_id, CASE WHEN d.doc_id IS NULL THEN 'create' ELSE 'update' END AS action, d.doc_id AS target_id FROM labels l LEFT JOIN documents d ON d.doc_id = l.doc_id AND contains(d.text, 'License')")
def i5(spark, sf_dir):
    d = B.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("review_id"), F.lit(0).alias("seq"), F.col("doc_id").alias("target_id"), F.col("text").alias("body"))
    return I.plan_upserts(B.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("review_id")), d, "License")


@query("entry_review_slice", WITH + SUMMARY + LONG + f"SELECT suite, finding_count, accepted_finding_rate, primary_precision, n = 0 AS passed FROM summary JOIN (SELECT suite, count(*) FILTER ({FAILED}) AS n FROM th JOIN lm USING (metric) GROUP BY 1) USING (suite)")
def review_slice(spark, sf_dir):
    """Documents to lines, rule hits, first of equal ones, labels, suite summary and gate: the flagship."""
    s = B.summary(spark, sf_dir)
    g = G.gate(G.gate_metrics(s), _thresholds(spark, sf_dir))
    return s.join(g, "suite").select("suite", "finding_count", "accepted_finding_rate", "primary_precision", "passed")


# ---- sources, dataflow, streams ----------------------------------------------------------------------------


@query("s3_json_path", "SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k FROM events")
def s3(spark, sf_dir):
    from reviewlake.sources.tool_output import get

    e = B.table(spark, sf_dir, "events").withColumn("doc", F.try_parse_json("props"))
    return e.select("event_id", get("doc", "$.k", "bigint").alias("k"))


def reports(spark, sf_dir, item, wrap):
    """review_id, tool_name, payload: scanners' reports for each user and type of event, with an item for each event; 1,000 ids share a report at most."""
    e = B.table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("review_id"), F.col("event_type").alias("tool_name"), F.floor(F.col("event_id") / 1000).alias("part"))
    items = e.agg(F.sort_array(F.collect_list(F.struct("event_id", item.alias("item")))).alias("l"))
    return items.select("review_id", "tool_name", F.to_json(wrap(F.transform("l", lambda x: x["item"]))).alias("payload"))


eid = lambda: F.col("event_id")
of = lambda n, c: F.concat(F.lit(c), (eid() % n).cast("string"))
only = lambda test, value: F.when(test, value)
begins = lambda: (eid() % 4).cast("int")
ends = lambda: (eid() % 4 + eid() % 3).cast("int")
SHOWN = ["review_id", "tool_name", "rule_id", "message", "file_path", "start_line", "end_line", "severity"]
shown = lambda f: longs(f.select(SHOWN), "start_line", "end_line")


def semgrep_reports(spark, sf_dir):
    item = F.struct(
        of(7, "r").alias("check_id"), only(eid() % 5 > 0, F.concat(of(5, "src\\a"), F.lit(".py"))).alias("path"), F.struct(begins().alias("line")).alias("start"), only(eid() % 2 == 0, F.struct(ends().alias("line"))).alias("end"),
        F.struct(F.concat(F.lit("m"), eid().cast("string")).alias("message"), only(eid() % 3 > 0, F.lit("WARNING")).alias("severity")).alias("extra"),
    )
    return reports(spark, sf_dir, item, lambda l: F.struct(l.alias("results")))  # noqa: E741


SEMGREP = "SELECT user_id AS review_id, event_type AS tool_name, 'r' || (event_id % 7) AS rule_id, 'm' || event_id AS message, 'src/a' || (event_id % 5) || '.py' AS file_path, event_id % 4 AS start_line, event_id % 4 + CASE WHEN event_id % 2 = 0 THEN event_id % 3 ELSE 0 END AS end_line, CASE WHEN event_id % 3 > 0 THEN 'warning' ELSE 'unknown' END AS severity FROM events WHERE event_id % 5 > 0 AND event_id % 4 > 0"


@query("s3_parse_semgrep", SEMGREP)
def s3_parse(spark, sf_dir):
    from reviewlake.sources.tool_output import parse_semgrep

    return shown(parse_semgrep(semgrep_reports(spark, sf_dir)))


def sarif_reports(spark, sf_dir):
    uri = F.when(eid() % 3 == 0, "file:///app/a.py").when(eid() % 3 == 1, "./app/b.py").otherwise("app\\c.py")
    region = F.struct(begins().alias("startLine"), only(eid() % 2 == 0, ends()).alias("endLine"))
    place = F.struct(F.struct(F.struct(uri.alias("uri")).alias("artifactLocation"), region.alias("region")).alias("physicalLocation"))
    text = F.concat(F.lit("m"), eid().cast("string"))
    item = F.struct(of(7, "r").alias("ruleId"), only(eid() % 3 > 0, F.lit("Note")).alias("level"), F.struct(only(eid() % 2 == 0, text).alias("text"), only(eid() % 2 == 1, text).alias("markdown")).alias("message"), F.array(place).alias("locations"))
    rule = lambda k, level: F.struct(F.lit(f"r{k}").alias("id"), F.struct(F.lit(level).alias("level")).alias("defaultConfiguration"))
    tool = F.struct(F.struct(F.array(*[rule(k, "error") for k in range(4)]).alias("rules")).alias("driver"), F.array(F.struct(F.array(rule(2, "Warning")).alias("rules"))).alias("extensions"))
    return reports(spark, sf_dir, item, lambda l: F.struct(F.array(F.struct(tool.alias("tool"), l.alias("results"))).alias("runs")))  # noqa: E741


SARIF = "SELECT user_id AS review_id, event_type AS tool_name, 'r' || (event_id % 7) AS rule_id, 'm' || event_id AS message, CASE event_id % 3 WHEN 0 THEN 'app/a.py' WHEN 1 THEN 'app/b.py' ELSE 'app/c.py' END AS file_path, event_id % 4 AS start_line, event_id % 4 + CASE WHEN event_id % 2 = 0 THEN event_id % 3 ELSE 0 END AS end_line, CASE WHEN event_id % 3 > 0 THEN 'note' WHEN event_id % 7 = 2 THEN 'warning' WHEN event_id % 7 < 4 THEN 'error' ELSE 'unknown' END AS severity FROM events WHERE event_id % 4 > 0"


@query("s4_parse_sarif", SARIF)
def s4_parse(spark, sf_dir):
    from reviewlake.sources.tool_output import parse_sarif

    return shown(parse_sarif(sarif_reports(spark, sf_dir)))


def bandit_reports(spark, sf_dir):
    item = F.struct(
        only(eid() % 2 == 0, of(7, "B")).alias("test_id"), of(7, "name").alias("test_name"), F.concat(F.lit("m"), eid().cast("string")).alias("issue_text"), only(eid() % 5 > 0, of(5, "src\\a")).alias("filename"),
        begins().alias("line_number"), only(eid() % 3 > 0, F.array(begins(), ends())).alias("line_range"), only(eid() % 3 > 0, F.lit("HIGH")).alias("issue_severity"),
    )
    return reports(spark, sf_dir, item, lambda l: F.struct(l.alias("results")))  # noqa: E741


BANDIT = "SELECT user_id AS review_id, event_type AS tool_name, CASE WHEN event_id % 2 = 0 THEN 'B' ELSE 'name' END || (event_id % 7) AS rule_id, 'm' || event_id AS message, 'src/a' || (event_id % 5) AS file_path, event_id % 4 AS start_line, event_id % 4 + event_id % 3 AS end_line, CASE WHEN event_id % 3 > 0 THEN 'high' ELSE 'unknown' END AS severity FROM events WHERE event_id % 5 > 0 AND event_id % 4 > 0"


@query("s5_parse_bandit", BANDIT)
def s5_parse(spark, sf_dir):
    from reviewlake.sources.tool_output import parse_bandit

    return shown(parse_bandit(bandit_reports(spark, sf_dir)))


def audit_reports(spark, sf_dir):
    vuln = lambda c, fixed: F.struct(F.concat(F.lit(c), eid().cast("string")).alias("id"), fixed.alias("fix_versions"))
    none = F.lit(None).cast("array<string>")
    first, second = vuln("V", only(eid() % 3 == 0, F.array(F.lit("1.2"), F.lit("2.0")))), vuln("W", none)
    item = F.struct(only(eid() % 5 > 0, of(5, "pkg")).alias("name"), only(eid() % 2 == 0, F.lit("0.1")).alias("version"), F.when(eid() % 4 == 0, F.array(first, second)).otherwise(F.array(first)).alias("vulns"))
    return reports(spark, sf_dir, item, lambda l: F.struct(l.alias("dependencies")))  # noqa: E741


AUDIT = "SELECT user_id AS review_id, event_type AS tool_name, v || event_id AS rule_id, 'Vulnerable dependency pkg' || (event_id % 5) || CASE WHEN event_id % 2 = 0 THEN '==0.1' ELSE '' END || CASE WHEN fixed THEN ' (fix: 1.2, 2.0)' ELSE '' END AS message, 'dependencies/pkg' || (event_id % 5) AS file_path, 1::BIGINT AS start_line, 1::BIGINT AS end_line, CASE WHEN fixed THEN 'high' ELSE 'medium' END AS severity FROM (SELECT *, 'V' AS v, event_id % 3 = 0 AS fixed FROM events UNION ALL SELECT *, 'W', false FROM events WHERE event_id % 4 = 0) WHERE event_id % 5 > 0"


@query("s6_parse_pip_audit", AUDIT)
def s6_parse(spark, sf_dir):
    from reviewlake.sources.tool_output import parse_pip_audit

    return shown(parse_pip_audit(audit_reports(spark, sf_dir)))


@query("s7_parse_tool_output", f"SELECT *, 'semgrep' AS adapter FROM ({SEMGREP}) WHERE tool_name = 'click' UNION ALL SELECT *, 'codeql' FROM ({SARIF}) WHERE tool_name = 'view' UNION ALL SELECT *, 'bandit' FROM ({BANDIT}) WHERE tool_name = 'purchase' UNION ALL SELECT *, 'pip-audit' FROM ({AUDIT}) WHERE tool_name = 'error'")
def s7_parse(spark, sf_dir):
    """Reports of four scanners in one table, each with the adapter that reads it; one that nobody reads gives nothing."""
    from reviewlake.sources.tool_output import parse_tool_output

    by = {"click": ("semgrep", semgrep_reports), "view": ("sarif", sarif_reports), "purchase": ("bandit-json", bandit_reports), "error": ("pip_audit", audit_reports)}
    runs = None
    for kind, (adapter, make) in by.items():
        one = make(spark, sf_dir).where(F.col("tool_name") == kind).withColumn("adapter", F.lit(adapter))
        runs = one if runs is None else runs.unionByName(one)
    runs = runs.unionByName(semgrep_reports(spark, sf_dir).withColumn("adapter", F.lit("unknown")))
    return longs(parse_tool_output(runs).select(*SHOWN, "adapter"), "start_line", "end_line")


@query("s9_evidence_markers", "SELECT event_id, 'validation' AS kind, event_type AS message, 'rule-' || (event_id % 7) AS rule_id, CASE WHEN event_id % 5 = 0 THEN NULL ELSE event_id % 5 END AS start_line FROM events WHERE event_id % 3 = 0")
def s9(spark, sf_dir):
    from reviewlake.sources.tool_output import extract_evidence_markers

    body = F.to_json(F.struct(F.col("event_type").alias("message"), F.concat(F.lit("rule-"), (F.col("event_id") % 7).cast("string")).alias("rule"), (F.col("event_id") % 5).alias("line")))
    line = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("log EVIDENCE: "), body)).when(F.col("event_id") % 3 == 1, "EVIDENCE: [1, 2").otherwise(body)
    logs = B.table(spark, sf_dir, "events").select(F.col("event_id").alias("review_id"), F.lit("t").alias("tool_name"), F.lit(1).alias("line_no"), line.alias("line"))
    return longs(extract_evidence_markers(logs).select(F.col("review_id").alias("event_id"), "kind", "message", "rule_id", "start_line"), "start_line")


@query("t4_as_of", "SELECT event_id, last_value(CASE WHEN event_type = 'click' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS def_id FROM events")
def t4(spark, sf_dir):
    e = B.table(spark, sf_dir, "events")
    return J.as_of(e, ["user_id"], ["ts", "event_id"], F.col("event_type") == "click", F.col("event_id"), "def_id").select("event_id", "def_id")


@query("t5_reachable", """WITH RECURSIVE e(src, dst) AS (SELECT 'c' || o_custkey, 'o' || o_orderkey FROM orders UNION SELECT 'o' || l_orderkey, 'p' || l_partkey FROM lineitem), r(node, origin) AS (SELECT 'c' || c_custkey, c_nationkey::VARCHAR FROM customer UNION SELECT e.dst, r.origin FROM r JOIN e ON e.src = r.node) SELECT node, origin FROM r""")
def t5(spark, sf_dir):
    from reviewlake.operators.reach import reachable

    t = lambda n: B.table(spark, sf_dir, n)
    tag = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    edges = t("orders").select(tag("c", "o_custkey").alias("src"), tag("o", "o_orderkey").alias("dst")).unionByName(t("lineitem").select(tag("o", "l_orderkey").alias("src"), tag("p", "l_partkey").alias("dst")))
    seeds = t("customer").select(tag("c", "c_custkey").alias("node"), F.col("c_nationkey").cast("string").alias("origin"))
    unit = F.lit(1).alias("unit")
    return reachable(seeds.select(unit, "*"), edges.select(unit, "*"), ["unit"], 8, ("origin",)).select("node", "origin")


SHAPES = ["(a+)+", "^[a-z]+$", "(?:.*,)*x", "a|b|c", "^abc$", r"\w*\w+", "(?:^|,)([^,]+)", "x.*.*y", "(a|aa)+$", "[0-9]{1,3}"]


def shape_sql(c: str) -> str:
    return "list_extract([" + ", ".join(map(quote, SHAPES)) + f"], ({c} % 10 + 1)::INT)"


ANCHORS = "(CASE WHEN {0} LIKE '^%' OR {0} LIKE '%(^%' OR {0} LIKE '%(?:^%' THEN 1 ELSE 0 END + CASE WHEN {0} LIKE '%$' THEN 1 ELSE 0 END + CASE WHEN {0} LIKE '%(?:^|%' THEN 1 ELSE 0 END)"
COMMA = "regexp_matches({0}, '\\((\\?:)?\\.\\*,\\)\\*')"
SCORE = "greatest(0, CASE WHEN {p} THEN 3 ELSE 0 END + length({0}) - length(replace(replace(replace({0}, '|', ''), '+', ''), '*', '')) + CASE WHEN {c} THEN 5 ELSE 0 END - {a})"


def score_sql(x: str) -> str:
    return SCORE.format(x, p=_prone(x), c=COMMA.format(x), a=ANCHORS.format(x))


def _prone(x: str) -> str:
    shapes = " OR ".join(f"regexp_matches({x}, {quote(s)})" for s in C.REDOS_SHAPES)
    return f"(({shapes}) AND NOT regexp_matches({x}, '^\\^?\\[[^\\]]+\\]\\{{\\d+(,\\d+)?\\}}\\$?$'))"


def _shape(c):
    return F.element_at(F.array(*map(F.lit, SHAPES)), (C.col(c) % 10 + 1).cast("int"))


@query("t11_is_redos_prone", f"SELECT event_id, {_prone('s')} AS prone FROM (SELECT event_id, {shape_sql('event_id')} AS s FROM events)")
def t11(spark, sf_dir):
    return B.table(spark, sf_dir, "events").select("event_id", C.is_redos_prone(_shape("event_id")).alias("prone"))


@query("t12_redos_risk_score", f"SELECT event_id, ({score_sql('s')})::BIGINT AS score FROM (SELECT event_id, {shape_sql('event_id')} AS s FROM events)")
def t12(spark, sf_dir):
    return longs(B.table(spark, sf_dir, "events").select("event_id", C.redos_risk_score(_shape("event_id")).alias("score")), "score")


HARDER = f"(o <> n AND (({_prone('o')} AND NOT {_prone('n')}) OR {score_sql('o')} > {score_sql('n')} OR ({COMMA.format('o')} AND NOT {COMMA.format('n')}) OR ({ANCHORS.format('n')} > {ANCHORS.format('o')} AND ({_prone('o')} OR {score_sql('o')} >= 2))))"


@query("t13_redos_hardening_delta", f"WITH n AS (SELECT DISTINCT user_id, {shape_sql('(event_id // 50)')} AS n FROM events), o AS (SELECT user_id, {shape_sql('(event_id // 20)')} AS o, min(event_id) AS k FROM events GROUP BY 1, 2), p AS (SELECT user_id, n, o, k FROM n JOIN o USING (user_id)), q AS (SELECT *, {score_sql('o')} - {score_sql('n')} AS d FROM p WHERE {HARDER}) SELECT user_id, n AS new_pattern, o AS old_pattern, d::BIGINT AS drop FROM (SELECT *, row_number() OVER (PARTITION BY user_id, n ORDER BY d DESC, k) AS r FROM q) WHERE r = 1")
def t13(spark, sf_dir):
    from reviewlake.operators.taint import redos_hardening_delta

    e = B.table(spark, sf_dir, "events")
    new = e.select("user_id", _shape(F.floor(F.col("event_id") / 50)).alias("new_pattern"))
    old = e.select("user_id", _shape(F.floor(F.col("event_id") / 20)).alias("old_pattern"), F.col("event_id").alias("old_seq"))
    return longs(redos_hardening_delta(old, new, ["user_id"]), "drop")


ATTACH = EVENTS + ", t AS (SELECT user_id, line AS window_id, greatest(1, line - 3) AS lo, line + 3 AS hi FROM e WHERE event_type = 'error'), m AS (SELECT user_id, event_id, line FROM e WHERE event_type = 'purchase') "


@query("t14_attach_to_window", ATTACH + "SELECT event_id, window_id FROM (SELECT m.event_id, t.window_id, row_number() OVER (PARTITION BY m.event_id ORDER BY CASE WHEN m.line BETWEEN lo AND hi THEN -1 ELSE least(abs(lo - m.line), abs(hi - m.line)) END, t.window_id) AS r FROM m JOIN t ON t.user_id = m.user_id) WHERE r = 1")
def t14(spark, sf_dir):
    from reviewlake.operators.taint import attach_to_window

    e = B.event_lines(spark, sf_dir)
    w = e.where("change_type = 'add'").select("review_id", F.col("seq").alias("window_id"), F.greatest(F.lit(1), F.col("new_line") - 3).alias("start_line"), (F.col("new_line") + 3).alias("end_line"), F.lit(True).alias("has_add"))
    m = e.where("content = 'purchase'").select("review_id", "event_id", F.col("new_line").alias("sink_line"))
    return longs(attach_to_window(m, w, ["review_id"], ["event_id"]).select("event_id", "window_id"), "window_id")


@query("t15_prefer_richer", "SELECT user_id, event_type AS rule_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY CASE WHEN event_id % 4 = 0 THEN 0 ELSE 1 END, event_id % 3 DESC, event_id % 5 DESC, event_id) AS r FROM events) WHERE r = 1")
def t15(spark, sf_dir):
    from reviewlake.operators.taint import prefer_richer

    e = B.table(spark, sf_dir, "events")
    m = e.select("user_id", F.col("event_type").alias("rule_id"), "event_id", F.when(F.col("event_id") % 4 == 0, "file").otherwise("window").alias("analysis_scope"), (F.col("event_id") % 3).alias("boost"), F.array_repeat(F.lit("s"), (F.col("event_id") % 5).cast("int")).alias("steps"), F.array(F.lit("x")).alias("sources"), F.col("event_id").alias("call_seq"))
    return prefer_richer(m, ["user_id"]).select("user_id", "rule_id", "event_id")


@query("x2_event_rates", "SELECT time_bucket(INTERVAL 5 MINUTE, ts, TIMESTAMP '1970-01-01') AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def x2(spark, sf_dir):
    from reviewlake.streaming.trace import event_rates

    return event_rates(B.table(spark, sf_dir, "events"), time="ts", kind="event_type")


@query("x3_dedupe_events", "SELECT DISTINCT user_id, event_type FROM events")
def x3(spark, sf_dir):
    from reviewlake.streaming.trace import dedupe_events

    return dedupe_events(B.table(spark, sf_dir, "events"), ["user_id", "event_type"], time="ts").select("user_id", "event_type")


@query("x4_tool_durations", "SELECT a.user_id, a.ts AS started, epoch_us(b.ts) - epoch_us(a.ts) AS micros FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts BETWEEN a.ts AND a.ts + INTERVAL 1 HOUR WHERE a.event_type = 'click' AND b.event_type = 'purchase'")
def x4(spark, sf_dir):
    from reviewlake.streaming.trace import tool_durations

    e = B.table(spark, sf_dir, "events")
    return tool_durations(e.where("event_type = 'click'"), e.where("event_type = 'purchase'"), ["user_id"], time="ts")


@query("x5_ratchet_totals", WITH + "SELECT suite, count(*) AS total, count(*) > 20 AS exceeded FROM findings GROUP BY 1")
def x5(spark, sf_dir):
    from reviewlake.streaming.trace import ratchet_totals

    return ratchet_totals(B.findings(spark, sf_dir), 20)


@query("s12_to_sarif", WITH + "SELECT case_id, count(*) AS n_results, count(DISTINCT rule_id) AS n_rules FROM findings GROUP BY 1")
def s12(spark, sf_dir):
    from reviewlake.sources.cases import to_sarif

    f = B.findings(spark, sf_dir).withColumns({"title": F.col("rule_id"), "risk": F.lit(""), "fix_guidance": F.lit("fix")})
    doc = to_sarif(f, "case_id").withColumn("d", F.parse_json("sarif"))
    size = lambda p: F.size(F.try_variant_get("d", p, "array<variant>")).cast("long")
    return doc.select("case_id", size("$.runs[0].results").alias("n_results"), size("$.runs[0].tool.driver.rules").alias("n_rules"))


#: Events of a user in one program.
SPAN = 1000


@query("t7_sink_matches", EVENTS + """, d AS (SELECT user_id, line, event_type, last_value(CASE WHEN event_type IN ('click', 'view') THEN event_type END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last FROM e)
SELECT user_id::VARCHAR AS unit, line AS sink_line, CASE WHEN last = 'click' THEN 0.10 ELSE 0.04 END::DOUBLE AS boost, CASE WHEN last = 'click' THEN 'input' ELSE '' END AS sources FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY line) AS r FROM d WHERE event_type = 'purchase') WHERE r = 1""")
def t7(spark, sf_dir):
    """A program for each user and SPAN of its events in order: clicks read input, views assign a constant, purchases evaluate.

    The last assignment before the span is its first line. The first match of a user's programs is the user's.
    """
    from reviewlake.operators import taint as T

    m = T.match_boost(T.sink_matches(T.code_facts(span_programs(B.event_lines(spark, sf_dir)))))
    at = F.substring_index("unit", ":", -1).cast("long")
    m = m.withColumns({"sink_line": at * SPAN + F.col("sink_line") - 1, "unit": F.substring_index("unit", ":", 1)})
    m = J.first_by(m, ["unit", "rule_id"], ["sink_line"])
    return longs(m.select("unit", "sink_line", "boost", F.array_join("sources", ",").alias("sources")), "sink_line")


def span_programs(e):
    """unit (user:span), source, changed: at most SPAN lines, after one with the last assignment before them."""
    code = F.when(F.col("content") == "click", "x = input()").when(F.col("content") == "view", "x = 'a'").when(F.col("content") == "purchase", "eval(x)").otherwise("pass")
    e = J.as_of(e.withColumn("code", code), ["review_id"], ["seq"], F.col("content").isin("click", "view"), F.col("code"), "before")
    return programs(e, F.coalesce("before", F.lit("pass")))


def programs(e, first):
    """unit (user:span), source, changed: the code of each span's events in order, after the first line as its first event has it."""
    unit = F.concat_ws(":", F.col("review_id").cast("string"), F.floor((F.col("seq") - 1) / SPAN).cast("string")).alias("unit")
    src = e.where("review_id is not null").withColumn("first", first).groupBy(unit).agg(F.sort_array(F.collect_list(F.struct("seq", "code", "first"))).alias("l"))
    source = F.array_join(F.concat(F.array(F.get("l", F.lit(0))["first"]), F.transform("l", lambda x: x["code"])), "\n")
    return src.select("unit", source.alias("source"), F.sequence(F.lit(1), F.size(F.split(source, "\n"))).alias("changed"))


def by_type(**code):
    """Code by the type of an event; others pass."""
    out = None
    for kind, text in code.items():
        text = F.lit(text) if isinstance(text, str) else text
        out = F.when(F.col("content") == kind, text) if out is None else out.when(F.col("content") == kind, text)
    return out.otherwise("pass")


def event_of(df, line="sink_line", lines_each=1):
    """user_id and line (of the user's events) of rows that stand in programs with a first line."""
    at = F.substring_index("unit", ":", -1).cast("long") * SPAN + F.floor((F.col(line) - 2) / lines_each) + 1
    return df.withColumns({"user_id": F.substring_index("unit", ":", 1), "line": at.cast("long")})


HELPERS = EVENTS + """, h AS (SELECT user_id::VARCHAR AS user_id, line, event_type, last_value(CASE WHEN event_type IN ('click', 'error', 'purchase') THEN event_type END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last FROM e) """


def helper_facts(spark, sf_dir):
    """A function for each event: clicks return formatted SQL, views what the function before returns, errors a constant; purchases execute what it returns."""
    from reviewlake.operators import taint as T

    e = B.event_lines(spark, sf_dir).withColumn("content", F.when(F.col("content").isin("click", "view", "error", "purchase"), F.col("content")).otherwise("view"))
    name = lambda k: F.concat(F.lit("f"), (F.col("seq") - k).cast("string"))
    define = lambda k, body: F.concat(F.lit("def "), name(k), F.lit("(v): "), body)
    sql, fixed = F.lit("return 'SELECT ' + v"), F.lit("return 'x'")
    before = lambda text: F.concat(F.lit(text), name(1), F.lit("(v)"))
    code = by_type(click=define(0, sql), view=define(0, before("return ")), error=define(0, fixed), purchase=define(0, F.concat(before("cur.execute("), F.lit(")"))))
    e = J.as_of(e.withColumn("code", code), ["review_id"], ["seq"], F.col("content") != "view", F.col("content"), "before")
    first = define(1, F.when(F.col("before") == "click", sql).when(F.col("before") == "error", fixed).otherwise("pass"))
    return T.code_facts(programs(e, first))


@query("t6_return_summaries", HELPERS + "SELECT user_id, line, event_type <> 'error' AS tainted, event_type = 'click' OR event_type <> 'error' AND coalesce(last, '') = 'click' AS sql FROM h WHERE event_type <> 'purchase'")
def t6(spark, sf_dir):
    from reviewlake.operators import taint as T
    from reviewlake.operators.reach import checkpointed

    facts = checkpointed(helper_facts(spark, sf_dir))
    flagged = T.flags(facts, checkpointed(T.def_use_edges(facts)))
    found = T.return_summaries(facts, flagged).withColumns({"user_id": F.substring_index("unit", ":", 1), "line": F.substr("func", F.lit(2)).cast("long")})
    own = F.floor((F.col("line") - 1) / SPAN) == F.substring_index("unit", ":", -1).cast("long")  # else a span's first line, the event before it
    return found.where(own & (F.col("line") > 0)).select("user_id", "line", "tainted", "sql")


@query("t6_helpers_execute", HELPERS + "SELECT user_id, line FROM h WHERE event_type = 'purchase' AND last = 'click'")
def t6_execute(spark, sf_dir):
    """Formatted SQL that a helper returns is executed by a caller any number of calls away."""
    from reviewlake.operators import taint as T

    return event_of(T.sink_matches(helper_facts(spark, sf_dir)).where("rule_id = 'py-sql-string-format'")).select("user_id", "line")


@query("t8_sql_format_exprs", EVENTS + "SELECT user_id::VARCHAR AS user_id, line, CASE event_type WHEN 'click' THEN 'f-string' WHEN 'view' THEN 'format' ELSE 'sum' END AS form FROM e WHERE event_type IN ('click', 'view', 'purchase')")
def t8(spark, sf_dir):
    """Each event executes a string of one form; in those of errors the verb is no part of the text."""
    from reviewlake.operators import taint as T

    code = by_type(click='    cur.execute(f"select {x}")', view="    cur.execute('{} update'.format(x))", error="    cur.execute('from %s' % f(x, 'select'))", purchase="    cur.execute('a' + x + ('delete %s' % x))")
    code = F.when(code == "pass", "    pass").otherwise(code)
    m = event_of(T.sink_matches(T.code_facts(programs(B.event_lines(spark, sf_dir).withColumn("code", code), F.lit("def g(x, cur):")))))
    kinds = B.event_lines(spark, sf_dir).select(F.col("review_id").cast("string").alias("user_id"), F.col("seq").cast("long").alias("line"), F.when(F.col("content") == "click", "f-string").when(F.col("content") == "view", "format").otherwise("sum").alias("form"))
    return m.where("rule_id = 'py-sql-string-format'").select("user_id", "line").join(kinds, ["user_id", "line"])


@query("t9_guard_dominates", EVENTS + f"SELECT user_id::VARCHAR AS user_id, line, guards > 0 AS hardened FROM (SELECT *, count(*) FILTER (event_type IN ('click', 'view')) OVER (PARTITION BY user_id, (line - 1) // 1000 ORDER BY line) AS guards FROM e) WHERE event_type = 'purchase'")
def t9(spark, sf_dir):
    """Normalisations after plain guards (clicks), nested guards under not and or (views), and conditions that only leave a loop (errors)."""
    from reviewlake.operators import taint as T

    block = lambda *lines: "\n".join([*("    " + x for x in lines), *["    pass"] * (5 - len(lines))])
    code = by_type(
        click=block("if len(x) > 9:", "    return x"), view=block("if not (len(x) < 3 or x):", "    if x:", "        pass", "    else:", "        raise ValueError"),
        error=block("if len(x) > 9:", "    for y in x:", "        break"), purchase=block("unicodedata.normalize('NFKC', x)"),
    )
    code = F.when(code == "pass", block()).otherwise(code)
    m = T.sink_matches(T.code_facts(programs(B.event_lines(spark, sf_dir).withColumn("code", code), F.lit("def g(x):"))))
    return event_of(m.where("rule_id = 'py-unicode-normalization-dos'"), lines_each=5).select("user_id", "line", (F.col("mode") == "adds-hardening").alias("hardened"))


@query("r6_accept_hits", EVENTS.replace("WITH ", "WITH RECURSIVE ", 1) + """, h AS (SELECT user_id, event_id, (line - 1) // 4 AS w, CASE WHEN event_type IN ('click', 'error') THEN 0 ELSE 1 END AS rx, line, CASE WHEN event_type IN ('click', 'view') THEN 'py-regex-redos' ELSE 'py-unicode-normalization-dos' END AS rule_id,
CASE event_type WHEN 'error' THEN 'complexity-dos' WHEN 'purchase' THEN '' ELSE 'redos' END AS family, (event_id % 7)::VARCHAR AS t FROM e), o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY w, rx, line) AS k FROM h),
r(user_id, k, w, seen, fams, event_id, fine) AS (SELECT DISTINCT user_id, 0::BIGINT, -1::BIGINT, []::VARCHAR[], []::VARCHAR[], NULL::BIGINT, false FROM o UNION ALL
SELECT user_id, k, w, CASE WHEN fine THEN list_append(seen, rule_id || t) ELSE seen END, CASE WHEN fine AND rx = 0 THEN list_append(fams, family) ELSE fams END, event_id, fine FROM (
SELECT *, NOT list_contains(seen, rule_id || t) AND NOT (rx = 1 AND CASE WHEN family = 'redos' THEN len(fams) > 0 ELSE list_contains(fams, 'complexity-dos') END) AS fine FROM (
SELECT o.user_id, o.k, o.w, r.seen, CASE WHEN o.w = r.w THEN r.fams ELSE [] END AS fams, o.event_id, o.rx, o.rule_id, o.family, o.t FROM r JOIN o ON o.user_id = r.user_id AND o.k = r.k + 1)))
SELECT user_id, event_id FROM r WHERE fine""")
def r6(spark, sf_dir):
    """Hits along each user's events, four to a window: clicks and errors are dataflow hits of two families, views and purchases regex hits."""
    e = B.event_lines(spark, sf_dir)
    of = F.col("content")
    rule = F.when(of.isin("click", "view"), "py-regex-redos").otherwise("py-unicode-normalization-dos")
    family = F.when(of == "error", "complexity-dos").when(of == "purchase", "").otherwise("redos")
    h = e.select("review_id", "file_path", "event_id", F.floor((F.col("new_line") - 1) / 4).alias("window_id"), F.when(of.isin("click", "error"), 0).otherwise(1).alias("is_regex"), F.col("new_line").alias("rule_ord"), rule.alias("rule_id"), family.alias("family"), (F.col("event_id") % 7).cast("string").alias("text_key"))
    return R.accept_hits(h).select(F.col("review_id").alias("user_id"), "event_id")


@query("t2_resolve_aliases", EVENTS + """, i AS (SELECT user_id, event_id % 4 AS m, 'pkg' || (event_id % 5) || '.mod' AS whole, row_number() OVER (PARTITION BY user_id, event_id % 4 ORDER BY line DESC) AS r FROM e WHERE event_type = 'click')
SELECT e.event_id, coalesce(whole, 'm' || (e.event_id % 4)) || '.f' || (e.event_id % 3) AS full_name FROM e LEFT JOIN i ON i.user_id = e.user_id AND i.m = e.event_id % 4 AND r = 1""")
def t2(spark, sf_dir):
    """Clicks import a module by a short name, of which a user's last counts; every event calls a function of one."""
    from reviewlake.operators import taint as T

    e = B.event_lines(spark, sf_dir).withColumnRenamed("review_id", "unit")
    imports = e.where("content = 'click'").select("unit", of(4, "m").alias("local"), F.concat(of(5, "pkg"), F.lit(".mod")).alias("full"), F.col("new_line").alias("seq"))
    return T.resolve_aliases(e.select("unit", "event_id", F.concat(of(4, "m"), of(3, ".f")).alias("name")), imports).select("event_id", "full_name")


@query("t10_regex_sinks", EVENTS + """, b AS (SELECT *, last_value(CASE event_type WHEN 'click' THEN '(a+)+' WHEN 'view' THEN 'abc' END IGNORE NULLS) OVER (PARTITION BY user_id, (line - 1) // 1000 ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS bound FROM e)
SELECT user_id::VARCHAR AS user_id, line, CASE event_type WHEN 'error' THEN 'x' ELSE bound END AS pattern FROM b WHERE event_type = 'error' OR event_type = 'purchase' AND bound IS NOT NULL""")
def t10(spark, sf_dir):
    """Clicks and views bind a pattern, purchases search by the name, errors match a literal."""
    from reviewlake.operators import taint as T
    from reviewlake.operators.reach import checkpointed

    code = by_type(click="p = '(a+)+'", view="p = 'abc'", purchase="re.search(p, x)", error="re.match('x', y)")
    facts = checkpointed(T.code_facts(programs(B.event_lines(spark, sf_dir).withColumn("code", code), F.lit("import re"))))
    calls = T.resolve_aliases(T.pick(facts, "call", call="node", scope="scope", call_seq="seq", name="name", at="line", changed="changed"), T.pick(facts, "import", local="name", full="text", seq="seq"))
    args = T.pick(facts, "arg", call="node", node="ref", arg="name", text="text", arg_changed="changed")
    per = args.groupBy("unit", "call").agg(F.collect_list(F.struct("arg", "text", "node", "arg_changed")).alias("args"))
    return event_of(T.regex_sinks(facts, calls.join(per, ["unit", "call"])), "at").select("user_id", "line", "pattern")


@query("t16_match_boost", "SELECT user_id AS unit, event_type AS rule_id, round(least(0.15, (event_id % 20) / 100.0 + CASE WHEN event_id % 4 = 0 THEN 0.02 ELSE 0 END), 2)::DOUBLE AS boost FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS r FROM events) WHERE r = 1")
def t16(spark, sf_dir):
    from reviewlake.operators.taint import match_boost

    e = B.table(spark, sf_dir, "events")
    m = e.select(F.col("user_id").alias("unit"), F.col("event_type").alias("rule_id"), ((eid() % 20) / 100).alias("boost"), F.when(eid() % 4 == 0, "file").otherwise("window").alias("analysis_scope"), eid().alias("call_seq"))
    return match_boost(m).select("unit", "rule_id", "boost")


@query("r3_strip_comments", r"""SELECT doc_id, count(*) AS n_lines, count(*) FILTER (code <> line) AS n_stripped, sum(length(code))::BIGINT AS n_chars FROM (SELECT doc_id, line, regexp_replace(line, '((?:[rbufRBUF]{0,2})(?:"(?:[^"\\\n]|\\.)*"|''(?:[^''\\\n]|\\.)*''))|#.*', '\1', 'g') AS code
FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)) GROUP BY 1""")
def r3(spark, sf_dir):
    lines = B.table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    code = R.strip_comments(F.col("line"), True)
    return lines.withColumn("code", code).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_lines"), F.count_if(F.col("code") != F.col("line")).alias("n_stripped"), F.sum(F.length("code").cast("long")).alias("n_chars"))


@query("a2_source_status", """SELECT doc_id AS case_id, CASE WHEN k = 0 THEN 'git-pair' WHEN k = 1 THEN 'diff-url-on-base' WHEN k = 2 THEN 'local-diff' WHEN k = 3 THEN 'remote-diff' ELSE 'missing' END AS source_kind,
(CASE WHEN k = 4 THEN 1 ELSE 0 END + CASE WHEN k = 2 AND doc_id % 7 > 2 THEN 1 ELSE 0 END + CASE WHEN k < 2 AND doc_id % 3 > 0 THEN 1 ELSE 0 END)::BIGINT AS n_errors, (CASE WHEN k = 3 THEN 1 ELSE 0 END)::BIGINT AS n_warnings FROM (SELECT doc_id, doc_id % 5 AS k FROM documents)""")
def a2(spark, sf_dir):
    k, of_id = F.col("doc_id") % 5, lambda c, n: F.concat(F.lit(c), (F.col("doc_id") % n).cast("string"))
    cases = B.table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("case_id"), F.when(k == 2, of_id("diffs/", 7)).alias("diff"), F.when(k < 2, of_id("repos/", 3)).alias("repo"), F.lit(None).cast("string").alias("repo_url"),
        F.when((k == 1) | (k == 3), F.lit("http://diff")).alias("diff_url"), F.when(k < 2, F.lit("base")).alias("base_ref"), F.when(k == 0, F.lit("head")).alias("head_ref"),
    )
    paths = B.table(spark, sf_dir, "documents").select(F.explode(F.array(*[F.lit(p) for p in ("diffs/0", "diffs/1", "diffs/2", "repos/0")])).alias("path"))
    return longs(A.source_status(cases, paths).select("case_id", "source_kind", F.size("source_errors").alias("n_errors"), F.size("source_warnings").alias("n_warnings")), "n_errors", "n_warnings")


@query("e14_case_errors", """SELECT d.doc_id AS case_id, CASE WHEN d.doc_id % 5 = 0 AND d.doc_id % 2 = 0 THEN 'no diff' WHEN l.doc_id IS NULL THEN 'review failed' END AS error, CASE WHEN d.doc_id % 5 = 0 AND d.doc_id % 2 = 0 OR l.doc_id IS NULL THEN 'error' ELSE 'completed' END AS status
FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON l.doc_id = d.doc_id""")
def e14(spark, sf_dir):
    i = F.col("doc_id")
    cases = B.table(spark, sf_dir, "documents").select(i.alias("case_id"), F.when(i % 5 != 0, F.lit("a diff")).otherwise(F.lit("")).alias("diff"), F.when(i % 2 != 0, F.lit("http://diff")).alias("diff_url"))
    return S.case_errors(cases, B.table(spark, sf_dir, "labels").select(i.alias("case_id"))).select("case_id", "error", "status")


CARRIED, COMBINED, INTERPOLATED = ": assignment carries taint", "string/binary combination preserves taint", "string interpolation incorporates tainted values"


@query("t17_taint_path", EVENTS.replace("WITH ", "WITH RECURSIVE ", 1) + f""", s AS (SELECT user_id, (line - 1) // 1000 AS span, (line - 1) % 1000 AS k, line, event_type FROM e),
p(user_id, span, k, lines, steps, last) AS (SELECT DISTINCT user_id, span, -1::BIGINT, '1', 'source call `input`', 1::BIGINT FROM s UNION ALL
SELECT s.user_id, s.span, s.k, CASE WHEN event_type = 'click' THEN (s.k + 2)::VARCHAR WHEN event_type IN ('view', 'error') THEN lines || '>' || (s.k + 2) ELSE lines END,
CASE event_type WHEN 'click' THEN 'source call `input`' WHEN 'view' THEN steps || '|L' || last || '{CARRIED}|{COMBINED}' WHEN 'error' THEN steps || '|L' || last || '{CARRIED}|{INTERPOLATED}' ELSE steps END,
CASE WHEN event_type IN ('click', 'view', 'error') THEN s.k + 2 ELSE last END FROM p JOIN s ON s.user_id = p.user_id AND s.span = p.span AND s.k = p.k + 1)
SELECT s.user_id::VARCHAR AS user_id, s.line, lines || '>' || (s.k + 2) AS lines, steps || '|L' || last || '{CARRIED}' AS steps FROM p JOIN s ON s.user_id = p.user_id AND s.span = p.span AND s.k = p.k + 1 WHERE event_type = 'purchase'""")
def t17(spark, sf_dir):
    """The whole way of taint to each purchase's eval: the lines that it passes, and what is said of them."""
    from reviewlake.operators import taint as T
    from reviewlake.operators.reach import checkpointed

    code = by_type(click="x = input()", view="x = x + 'a'", error="x = f'{x}!'", purchase="eval(x)")
    facts = checkpointed(T.code_facts(programs(B.event_lines(spark, sf_dir).withColumn("code", code), F.lit("x = input()"))))
    edges = checkpointed(T.def_use_edges(facts))
    sinks = T.pick(facts, "call", call="node", name="name", sink_line="line").where("name = 'eval'").join(T.pick(facts, "arg", call="node", end="ref"), ["unit", "call"])
    paths = T.taint_path(facts, edges, checkpointed(T.flags(facts, edges)), sinks.select("unit", "end")).join(sinks, ["unit", "end"])
    lines = F.array_compact(F.transform("path", lambda p: p["line"].cast("string")))
    return event_of(paths).select("user_id", "line", F.array_join(lines, ">").alias("lines"), F.array_join(F.flatten(F.transform("path", lambda p: p["text"])), "|").alias("steps"))


@query("review_with_dataflow", """SELECT event_id AS review_id, rule_id, severity, confidence::DOUBLE AS confidence, 'src/a' || (event_id % 3) || '.py' AS file_path, greatest(1, line - 6) AS start_line, line + 6 AS end_line, steps FROM (SELECT event_id, event_id % 50 + 1 AS line, event_type FROM events) e
JOIN (VALUES ('click', 'py-shell-true', 'high', 0.80, 'source call `input`|OS shell sink'), ('purchase', 'py-eval-exec', 'high', 0.76, 'dynamic code execution'), ('error', 'py-unsafe-yaml', 'medium', 0.86, 'Loader is not SafeLoader/CSafeLoader')) r(kind, rule_id, severity, confidence, steps) ON r.kind = e.event_type
UNION ALL SELECT event_id, 'py-shell-true', 'high', 0.80, 'src/a' || (event_id % 3) || '.py', event_id % 50 - 4, event_id % 50 + 8, 'source call `input`|OS shell sink' FROM events WHERE event_type = 'click' AND event_id % 50 >= 6""")
def review_with_dataflow(spark, sf_dir):
    """The review of a change for each event by all shipped rules and dataflow: clicks run a shell on input, purchases eval a name, errors load YAML.

    What no line matches by the rule's own pattern (os.system) is found anew in each window that starts elsewhere.
    """
    from reviewlake.operators.rules import shipped_rules
    from reviewlake.plans.review import review

    code = {"click": ["import os", "os.system(input())"], "purchase": ["", "eval(x)"], "error": ["import yaml", "yaml.load(f)"]}
    added = None
    for kind, lines in code.items():
        text = F.lit("\n".join(f"+{x}" for x in lines))
        added = F.when(F.col("event_type") == kind, text) if added is None else added.when(F.col("event_type") == kind, text)
    line = (eid() % 50 + 1).cast("string")
    head = F.concat(of(3, "+++ b/src/a"), F.lit(".py\n@@ -"), line, F.lit(",0 +"), line, F.lit(",2 @@\n"))
    diffs = B.table(spark, sf_dir, "events").select(eid().alias("review_id"), F.concat(head, added.otherwise("+x = 1\n+y = x")).alias("diff_text"))
    found = review(diffs, shipped_rules(spark))
    return longs(found.select("review_id", "rule_id", "severity", "confidence", "file_path", "start_line", "end_line", F.array_join("dataflow_steps", "|").alias("steps")), "start_line", "end_line")


@query("review_diffs", None)
def review_diffs(spark, sf_dir):
    """The review of a diff for each document by the text rules: lines, windows, masks, hits, first of equal ones, findings."""
    from reviewlake.plans.review import review

    d = review(doc_diffs(spark, sf_dir), B.text_rules(spark), semantic=False)
    return d.select("review_id", "finding_id", "rule_id", "severity", "confidence", "file_path", "start_line", "end_line")


@query("v1_validation_plan", WITH + """SELECT f.case_id, f.finding_id, c.check_no::BIGINT AS check_no, CASE WHEN c.check_no = 1 AND f.case_id::BIGINT % 2 = 0 AND EXISTS (SELECT 1 FROM findings g WHERE g.case_id = f.case_id AND g.rule_id = 'ipv4' AND g.file_path = f.file_path AND g.start_line = f.start_line) THEN 'covered' ELSE 'missing' END AS status,
CASE WHEN c.check_no = 1 AND f.case_id::BIGINT % 2 = 0 AND NOT EXISTS (SELECT 1 FROM findings g WHERE g.case_id = f.case_id AND g.rule_id = 'ipv4' AND g.file_path = f.file_path AND g.start_line = f.start_line) THEN 'semgrep' ELSE '' END AS candidates FROM findings f, (VALUES (0), (1)) c(check_no)""")
def v1(spark, sf_dir):
    f = B.findings(spark, sf_dir).withColumns({"title": F.col("rule_id"), "recommended_validation": F.array(F.lit("unit tests for malicious input"), F.lit("static taint analysis"))})
    runs = f.select("case_id").distinct().select("case_id", F.lit("semgrep").alias("name"), F.lit("semgrep scan").alias("command"), F.array(F.lit("static-analysis")).alias("capabilities"), F.lit("allowed").alias("policy_status"), (F.col("case_id").cast("long") % 2).cast("int").alias("exit_code"), F.lit(False).alias("timed_out"))
    tools = f.where("rule_id = 'ipv4'").select("case_id", F.lit("semgrep").alias("tool_name"), "rule_id", F.lit("seen").alias("message"), F.concat(F.lit("./"), "file_path").alias("file_path"), "start_line", "end_line", "severity")
    none = spark.createDataFrame([], "case_id string, tool_name string, kind string, message string, rule_id string, finding_id string, file_path string, start_line int, end_line int, check string, payload string, assertion string")
    p = V.validation_plan(f, runs, tools, none, "case_id")
    return longs(p.select("case_id", "finding_id", "check_no", "status", F.array_join("candidate_tools", ",").alias("candidates")), "check_no")


@query("e16_score_scanner", WITH + "SELECT c.suite, coalesce(sum(p.inside) FILTER (c.status = 'completed'), 0)::BIGINT AS finding_count, coalesce(sum(p.n), 0)::BIGINT AS raw_tool_finding_count, coalesce(sum(p.n - p.inside), 0)::BIGINT AS out_of_scope_finding_count, count(*) FILTER (c.status = 'error') AS scanner_error_count FROM cases c LEFT JOIN (SELECT case_id, count(*) AS n, count(*) FILTER (start_line <= 4) AS inside FROM findings GROUP BY 1) p ON p.case_id = c.case_id GROUP BY 1")
def e16(spark, sf_dir):
    c = B.cases(spark, sf_dir).select("suite", "case_id", "source", "status", "expected_rules")
    ranges = c.select("case_id", F.col("source").alias("file_path"), F.lit(1).alias("scope_start"), F.lit(4).alias("scope_end"))
    none = spark.createDataFrame([], "case_id string, name string, canonical string")
    s = S.score_scanner(c, B.findings(spark, sf_dir).drop("suite", "finding_id", "confidence"), B.expected(spark, sf_dir), ranges, none, none)
    return s.select("suite", "finding_count", "raw_tool_finding_count", "out_of_scope_finding_count", "scanner_error_count")
