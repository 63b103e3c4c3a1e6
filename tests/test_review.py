"""Golden rows: diffs, windows, rules, dataflow."""

import pytest
from pyspark.sql import functions as F

from reviewlake.functions import columns as C
from reviewlake.operators import lines as L
from reviewlake.operators import rules as R
from reviewlake.operators import taint as T
from reviewlake.plans.review import review


def diffs(spark, **texts):
    return spark.createDataFrame(list(texts.items()), "review_id string, diff_text string")


def diff(*lines, path="app.py", at=1):
    return "\n".join([f"+++ b/{path}", f"@@ -{at},9 +{at},9 @@", *lines])


def test_lines_keep_numbers_over_files_and_hunks(spark):
    text = "+++ b/a.py\n@@ -1,2 +1,3 @@\n x\n+y\n z\n@@ -10,1 +20,2 @@\n-old\n+new\n+++ b/b.py\n\n tail\n"
    rows = [tuple(r)[2:] for r in L.changed_lines(diffs(spark, r=text)).orderBy("seq").collect()]
    assert rows == [
        ("a.py", 1, 1, "x", "context"), ("a.py", None, 2, "y", "add"), ("a.py", 2, 3, "z", "context"), ("a.py", 10, None, "old", "delete"), ("a.py", None, 20, "new", "add"),
        ("b.py", 11, 21, "", "context"), ("b.py", 12, 22, "tail", "context"),
    ]


def test_deleted_file_keeps_the_last_name_and_odd_lines_drop(spark):
    text = diff("---x", "+++y", "+a")
    assert [r["content"] for r in L.changed_lines(diffs(spark, r=text)).collect()] == ["a"]
    assert L.changed_lines(diffs(spark, r="+a\n", q="")).count() == 0


def test_windows_are_cut_in_diff_order(spark):
    w = L.evidence_windows(L.changed_lines(diffs(spark, r=diff("-yaml.load(source)"))))
    assert w.count() == 1 and "yaml.load(source)" in w.select(C.snippet("lines").alias("s")).first()["s"]
    many = diff(*[f"+l{i}" for i in range(30)])
    w = {r["window_id"]: r for r in L.evidence_windows(L.changed_lines(diffs(spark, r=many))).collect()}
    assert (w[17]["start_line"], w[17]["end_line"], len(w[17]["lines"])) == (10, 22, 12)


REVIEWS = {
    "shell": diff("+    return subprocess.run(user_input, shell=True)"),
    "in-string": diff('+x = "subprocess.run(user_input, shell=True)"'),
    "in-block": diff('+x = """', "+subprocess.run(user_input, shell=True)", '+"""'),
    "one-line-blocks": diff('+x = """doc"""', "+subprocess.run(user_input, shell=True)", '+y = """doc"""'),
    "comment": diff("+x = 1  # eval(y)"),
    "redos": diff('+TOKEN = re.compile(r"(a+)+$")'),
    "eval": diff("+eval(user_input)", at=10),
    "harden": diff("-import re", "-def f(v):", r"-    return re.match('(a+)+', v)", "+import re", "+def f(v):", r"+    return re.match('^[a]{1,9}$', v)"),
    "text-file": diff("+eval(x)", path="notes.txt"),
}


@pytest.fixture(scope="module")
def reviewed(spark):
    rows = review(diffs(spark, **REVIEWS).repartition(3), R.shipped_rules(spark)).collect()
    return {k: {r["rule_id"]: r for r in rows if r["review_id"] == k} for k in REVIEWS}


def test_rules_see_code_but_not_strings(reviewed):
    assert "py-shell-true" in reviewed["shell"] and "py-shell-true" in reviewed["one-line-blocks"]
    assert not reviewed["in-string"] and not reviewed["in-block"] and not reviewed["comment"] and not reviewed["text-file"]
    assert "py-regex-redos" in reviewed["redos"]


def test_findings_carry_their_window_and_rule(reviewed):
    (found,) = reviewed["eval"].values()
    assert found["finding_id"] == "py-eval-exec@app.py:4-16" and 0.72 <= found["confidence"] <= 0.99


def test_hardening_supersedes_risk(reviewed):
    assert "py-regex-redos-hardening" in reviewed["harden"] and "py-regex-redos" not in reviewed["harden"]


def test_lines_in_strings_of_the_checkout_do_not_count(spark):
    lines = spark.createDataFrame([("r", "app.py", i, s) for i, s in enumerate(['S = """', 'TOKEN = re.compile(r"(a+)+$")', '"""'], 1)], "review_id string, file_path string, line_number int, content string")
    masked = R.mask_multiline_strings(lines, ["review_id", "file_path"]).where("masked").select("review_id", "file_path", "line_number")
    assert [r["line_number"] for r in masked.orderBy("line_number").collect()] == [1, 2, 3]
    found = review(diffs(spark, r=diff('+TOKEN = re.compile(r"(a+)+$")', at=2)), R.shipped_rules(spark), masked=masked, semantic=False)
    assert found.count() == 0


@pytest.mark.parametrize("pattern", [r"(a+)+", r"(a*)*", r"(a+)*", r"(?:a+)+", r"(a|aa)+", r"(?:.*,)*", r"(.*,)*", r"((\r\n|\r|\n)+) *$", r"a+b+", r"\w*\w+", r".*.*=.*", r"x.*.*y"])
def test_prone(spark, pattern):
    assert spark.range(1).select(C.is_redos_prone(F.lit(pattern)).alias("p")).first()["p"]


@pytest.mark.parametrize("pattern", [r"^[a-z0-9_-]{1,64}$", r"^[a-z]+$", "abc", "", ".*foo.*", "^.*=.*$", ".*?.*?"])
def test_not_prone(spark, pattern):
    assert not spark.range(1).select(C.is_redos_prone(F.lit(pattern)).alias("p")).first()["p"]


def test_hardening(spark):
    row = spark.range(1).select(C.redos_hardening(F.lit(r"(?:.*,)*[ \t]*([^ \t]+)[ \t]+"), F.lit(r"(?:^|,)([^ \t,]+)[ \t]+")).alias("h")).first()
    assert row["h"]


def test_hardening_delta_of_all_events_joins_patterns_only(spark):
    from pyspark.sql import Window

    from reviewlake.plans.queries import _shape

    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    new = e.where("event_type <> 'view'").select("user_id", _shape(F.floor(F.col("event_id") / 3)).alias("new_pattern"))
    old = e.where("event_type = 'view'").select("user_id", _shape(F.floor(F.col("event_id") / 7)).alias("old_pattern"), F.col("event_id").alias("old_seq"))
    got = T.redos_hardening_delta(old, new, ["user_id"])
    pairs = old.join(new, "user_id").where(C.redos_hardening("old_pattern", "new_pattern")).withColumn("drop", C.redos_risk_score("old_pattern") - C.redos_risk_score("new_pattern"))
    first = pairs.withColumn("r", F.row_number().over(Window.partitionBy("user_id", "new_pattern").orderBy(F.desc("drop"), "old_seq"))).where("r = 1")
    want = first.select("user_id", "new_pattern", "old_pattern", "drop").collect()
    assert want and sorted(map(tuple, got.collect())) == sorted(map(tuple, want))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.split("Join", 1)[1].count("Aggregate") == 2  # both sides


def test_reachability_goes_to_the_end(spark):
    from reviewlake.operators.reach import reachable

    edges = spark.createDataFrame([(1, k, k + 1) for k in range(70)] + [(1, 70, 68)], "unit int, src int, dst int").coalesce(1).cache()
    seeds = spark.createDataFrame([(1, 0)], "unit int, node int").coalesce(1)
    assert {r["node"] for r in reachable(seeds, edges, ["unit"]).collect()} == set(range(71))
    short = edges.where("src < 3")
    assert reachable(seeds, short, ["unit"], 3).count() == 4
    with pytest.raises(RuntimeError):
        reachable(seeds, short, ["unit"], 2)


def test_programs_are_bounded_and_know_the_assignment_before(spark, monkeypatch):
    import duckdb

    from reviewlake.plans import bindings, queries

    monkeypatch.setattr(queries, "SPAN", 3)
    sf = "/root/testdata/sf0.001"
    programs = [r["source"].split("\n") for r in queries.span_programs(bindings.event_lines(spark, sf)).collect()]
    assert max(map(len, programs)) == 4 and sum(map(len, programs)) - len(programs) == spark.read.parquet(f"{sf}/events.parquet").count()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{sf}/events.parquet'")
    want = con.execute(queries.SQL["t7_sink_matches"]).fetchall()
    assert sorted(map(tuple, queries.t7(spark, sf).collect())) == sorted(want)


SOURCES = {
    "call": "import subprocess as sp\ndef get(req):\n    return req.args\ndef run():\n    c = 'ls ' + get(x)\n    d = f'{c} -l'\n    sp.run(d, shell=True)\n",
    "killed": "import subprocess\ndef run(a):\n    a = 'ls'\n    subprocess.run(a, shell=True)\n",
    "many": "import yaml, hashlib\ndef f(cur, q):\n    s = 'SELECT * FROM t WHERE a=' + q\n    cur.execute(s)\n    yaml.load(q)\n    get(u, verify=False)\n    hashlib.md5(q)\n    eval(q)\n",
    "bound": "def f(cur, q):\n    cur.execute('SELECT ?', q)\n",
    "safe-yaml": "import yaml\ndef f(q):\n    yaml.load(q, Loader=yaml.SafeLoader)\n",
    "guarded": "import unicodedata\ndef f(v):\n    if len(v) > 10:\n        return v\n    return unicodedata.normalize('NFKC', v)\n",
    "unguarded": "import unicodedata\ndef f(v):\n    return unicodedata.normalize('NFKC', v)\n",
    "augmented": "import os\ndef f(a):\n    c = 'ls '\n    c += a\n    os.system(c)\n",
    "compile": "import re\nP = '(a+)+'\nQ = re.compile(P)\ndef f(v):\n    return re.search(P, v)\n",
}


@pytest.fixture(scope="module")
def sinks(spark):
    df = spark.createDataFrame([(k, s, list(range(1, s.count("\n") + 1))) for k, s in SOURCES.items()], "unit string, source string, changed array<int>")
    rows = T.match_boost(T.sink_matches(T.code_facts(df))).collect()
    return {k: {r["rule_id"]: r for r in rows if r["unit"] == k} for k in SOURCES}


def test_taint_reaches_sinks(sinks):
    assert sinks["call"]["py-shell-true"]["boost"] == 0.10 and sinks["call"]["py-shell-true"]["sink_line"] == 7
    assert sinks["killed"]["py-shell-true"]["boost"] == 0.02
    assert sinks["augmented"]["py-shell-true"]["boost"] == 0.10


def test_sinks_by_kind(sinks):
    assert set(sinks["many"]) == {"py-sql-string-format", "py-unsafe-yaml", "py-tls-verify-disabled", "weak-hash", "py-eval-exec"}
    assert not sinks["bound"] and not sinks["safe-yaml"]


def test_guards_and_patterns(sinks):
    assert sinks["guarded"]["py-unicode-normalization-dos"]["mode"] == "adds-hardening"
    bare = sinks["unguarded"]["py-unicode-normalization-dos"]
    assert bare["mode"] == "introduces-risk" and bare["boost"] == 0.10
    assert sinks["compile"]["py-regex-redos"]["sink_line"] == 5


def test_unreadable_source_gives_no_facts(spark):
    df = spark.createDataFrame([("u", "def (", [1]), ("v", None, [1]), ("w", "x = 1", [])], "unit string, source string, changed array<int>")
    assert T.code_facts(df).count() == 0


def test_lines_are_shuffled_once_for_windows(spark, capsys):
    """The text of a line isn't shuffled anew for each window that it stands in."""
    L.evidence_windows(L.changed_lines(diffs(spark, r=diff("+a", " b", "-c")))).explain()
    plan = capsys.readouterr().out
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan


def test_equal_windows_are_analysed_once_and_all_get_the_matches(spark, monkeypatch):
    asked, parse = [], T.code_facts
    monkeypatch.setattr(T, "code_facts", lambda sources, **how: asked.append(sources.count()) or parse(sources, **how))
    lines = ("+import os", "+os.system(input())", " pass")
    texts = {"a": diff(*lines), "b": diff(*lines, path="other.py", at=40), "c": diff("+import os", "-os.system(input())", " pass"), "d": diff(*lines, path="no.txt")}
    got = {(r["review_id"], r["file_path"], r["start_line"], r["rule_id"]) for r in review(diffs(spark, **texts), R.shipped_rules(spark)).collect()}
    assert asked == [3]  # both images of c, and the one that a and b share
    assert {g[:2] for g in got if g[3] == "py-shell-true"} == {("a", "app.py"), ("b", "other.py"), ("c", "app.py")}


def test_merging_tasks_grow_with_the_ranges(spark, monkeypatch):
    ranges = spark.range(90).select((F.col("id") % 30).alias("k"), (F.col("id") - F.col("id") % 30).alias("lo"), (F.col("id") - F.col("id") % 30 + 28 + F.col("id") % 2).alias("hi"))
    monkeypatch.setattr(L, "MERGED", 9)
    got = L.merge_ranges(ranges, ["k"], "lo", "hi")
    assert got.rdd.getNumPartitions() == 10
    assert sorted(map(tuple, got.collect())) == sorted(r for k in range(30) for r in ([(k, 0, 89)] if k % 2 else [(k, 0, 28), (k, 30, 58), (k, 60, 88)]))


def test_equal_ranges_may_stand_in_any_order(spark, capsys):
    """Both windows of merging read one sort, so equal ranges stand alike in both and none falls to the island before."""
    rows = [(k, lo, lo + 3 + (lo + k) % 4) for k in range(20) for lo in range(0, 300, 5) for _ in range(1 + lo % 3)]
    got = L.merge_ranges(spark.createDataFrame(rows, "k long, lo long, hi long").repartition(7), ["k"], "lo", "hi")
    want: list[tuple[int, int, int]] = []
    for k, lo, hi in sorted(rows):
        if want and want[-1][0] == k and lo <= want[-1][2] + 1:
            want[-1] = (k, want[-1][1], max(want[-1][2], hi))
        else:
            want.append((k, lo, hi))
    assert len(want) > 40 and sorted(map(tuple, got.collect())) == want
    got.explain()
    assert capsys.readouterr().out.count("+- Sort [") == 1
