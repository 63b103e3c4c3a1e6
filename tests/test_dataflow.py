"""Dataflow: closures in logarithmic rounds, flags through calls, guards and SQL by joins of facts, whole paths."""

import time

import pytest
from pyspark.sql import functions as F

from reviewlake.operators import reach
from reviewlake.operators import taint as T


def facts_of(spark, **sources):
    df = spark.createDataFrame([(k, s, list(range(1, s.count("\n") + 2))) for k, s in sources.items()], "unit string, source string, changed array<int>")
    return reach.checkpointed(T.code_facts(df))


def test_a_chain_of_500_edges_takes_few_rounds(spark):
    edges = spark.createDataFrame([(1, k, k + 1) for k in range(500)] + [(2, k, (k + 1) % 90) for k in range(90)], "unit int, src int, dst int")
    seeds = spark.createDataFrame([(1, 0, "a"), (2, 7, "b"), (2, 8, "c")], "unit int, node int, origin string")
    reach.reachable(seeds, edges.limit(1), ["unit"], carry=("origin",)).count()
    before = len(reach._written)
    began = time.time()
    got = reach.reachable(seeds, edges, ["unit"], carry=("origin",))
    levels = len(reach._written) - before
    rows = {tuple(r) for r in got.select("unit", "node", "origin").collect()}
    assert rows == {(1, k, "a") for k in range(501)} | {(2, k, o) for k in range(90) for o in "bc"}
    assert levels <= 11 and time.time() - began < 30  # ten rounds; some seconds on an idle machine
    assert got.count() == len(rows)  # nothing is in two levels


def test_dense_edges_are_doubled_no_more(spark, monkeypatch):
    layers = [(1, 10 * k + a, 10 * (k + 1) + b) for k in range(12) for a in range(6) for b in range(6)]
    edges = spark.createDataFrame(layers, "unit int, src int, dst int")
    seeds = spark.createDataFrame([(1, 0)], "unit int, node int")
    monkeypatch.setattr(reach, "DENSE", 0.1)
    assert reach.reachable(seeds, edges, ["unit"]).count() == 1 + 12 * 6


def test_what_is_written_can_be_dropped(spark):
    a = reach.checkpointed(spark.range(3))
    assert a.count() == 3 and reach.drop_written(spark, a) == 1


def test_a_cluster_needs_a_shared_folder(spark):
    class Conf:
        def get(self, *_):
            return None

    class Session:
        conf = Conf()

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(ValueError):
        reach.shared_folder(Session())


def test_pointer_paths_are_whole(spark):
    pointers = spark.createDataFrame([(1, k, k - 1) for k in range(1, 70)], "unit int, node int, parent int")
    ends = spark.createDataFrame([(1, 69), (1, 5), (1, 0), (2, 3)], "unit int, end int")
    got = {(r["unit"], r["end"], r["back"]): r["node"] for r in reach.pointer_paths(ends, pointers, ["unit"]).collect()}
    assert got == {(1, e, b): e - b for e in (69, 5, 0) for b in range(e + 1)} | {(2, 3, 0): 3}


def test_four_flags_rest_over_calls_in_any_order(spark):
    chain = "def c(q):\n    cur.execute(b(q))\ndef b(q):\n    return a(q)\ndef a(q):\n    return 'select %s' % q\ndef plain(q):\n    return 'x'\ndef loop(q):\n    return loop(q - 1)\n"
    facts = facts_of(spark, u=chain, v="def d(q):\n    cur.execute(a(q))\n")
    flagged = T.flags(facts, T.def_use_edges(facts))
    got = {r["func"]: (r["tainted"], r["sql"]) for r in T.return_summaries(facts, flagged).where("unit = 'u'").collect()}
    assert got == {"a": (True, True), "b": (True, True), "plain": (False, False), "loop": (True, False)}
    found = {(r["unit"], r["rule_id"]) for r in T.sink_matches(facts).collect()}
    assert found == {("u", "py-sql-string-format")}  # functions of another unit don't count


def test_changed_flags_come_from_changed_assignments(spark):
    source = "def f(q):\n    s = 'select ' + q\n    t = s\n    cur.execute(t)\n"
    df = spark.createDataFrame([("old", source, [9]), ("new", source, [2]), ("call", source, [4])], "unit string, source string, changed array<int>")
    assert {r["unit"] for r in T.sink_matches(T.code_facts(df)).collect()} == {"new", "call"}


SPELLED = {
    'f"select {x}"': True, 'f"choose {x}"': False, "'select %s' % x": True, "'%s' % x + ' update'": True, "'%s, %s' % ('select', x)": False, "'{} delete'.format(x)": True,
    "'{}'.format('select', x)": False, "g('select') + x": False, "'insert ' + (x + 'b')": True, "'insert ' * x": False, "f\"{'select'} {x}\"": True, "('select {}'.format(x)) + 'a'": True, "['select ' + x]": False, "'select ' + 'a'": False,
}


def test_sql_is_spelled_by_the_text_that_counts(spark):
    facts = facts_of(spark, **{f"u{k}": f"def h(x, cur):\n    cur.execute({source})\n" for k, source in enumerate(SPELLED)})
    got = {r["unit"] for r in T.sink_matches(facts).where("rule_id = 'py-sql-string-format'").collect()}
    assert got == {f"u{k}" for k, yes in enumerate(SPELLED.values()) if yes}


GUARDS = {
    "if len(x) > 9:\n        return": True, "if 3 < len(x) <= 9:\n        raise E()": True, "if not (len(x) < 9 or a):\n        return": True, "if len(x) == 9:\n        return": False, "if len(x) > 9:\n        log(x)": False,
    "if len(x) > 9:\n        log(x)\n    else:\n        return": False, "if len(x) > 9:\n        if a:\n            pass\n        elif b:\n            return": True, "if len(x) > 9:\n        for y in x:\n            break": False,
    "if len(x) > 9:\n        def k():\n            return 1": False, "if len(y) > 9:\n        return": False, "if check(len(x) > 9):\n        return": False, "if len(x, 1) > 9:\n        return": False, "if len(x) > 9:\n        with a:\n            return": False,
    "while len(x) > 9:\n        return": False,
}


def test_guards(spark):
    lines = ["import unicodedata", "def h(x, y, a, b):", "", "    unicodedata.normalize('NFKC', x)", ""]
    source = lambda at, guard: "\n".join([*lines[:at], f"    {guard}", *lines[at + 1 :]])
    facts = facts_of(spark, **{f"{name}{k}": source(at, guard) for k, guard in enumerate(GUARDS) for name, at in (("u", 2), ("late", 4))})
    got = {r["unit"]: r["mode"] for r in T.sink_matches(facts).where("rule_id = 'py-unicode-normalization-dos'").collect()}
    assert got == {f"u{k}": "adds-hardening" if yes else "introduces-risk" for k, yes in enumerate(GUARDS.values())} | {f"late{k}": "introduces-risk" for k in range(len(GUARDS))}


def test_steps_tell_the_whole_way(spark):
    source = "import os\ndef get(q):\n    return q\ndef f(a):\n    b = f'{a + 1}'\n    c = b\n    os.system(c)\n    os.system(get(1))\n    os.system(request.args.get('x') + '')\n"
    df = spark.createDataFrame([("u", source, [5, 7, 8, 9])], "unit string, source string, changed array<int>")
    got = {r["sink_line"]: r["steps"][:-1] for r in T.sink_matches(T.code_facts(df)).collect()}
    assert got[7] == ["parameter `a` treated as attacker-controlled", "string/binary combination preserves taint", "string interpolation incorporates tainted values", "L5: assignment carries taint"]
    assert got[8] == ["call `get()` returns tainted data"]
    assert got[9] == ["string/binary combination preserves taint"]


def test_facts_are_handed_on_before_a_batch_ends():
    """A worker that parses a batch of many units gives facts out as it goes, all of them and in order."""
    import pyarrow as pa

    class Given:
        def select(self, *_):
            return self

        def mapInArrow(self, run, _):
            return run

    code = "\n".join(f"x{k} = 'a' + y.format({k})" for k in range(100))
    units = [f"u{k}" for k in range(120)]
    given = pa.RecordBatch.from_pydict({"unit": units, "source": [code] * 120, "changed": [[1]] * 120})
    out = list(T.code_facts(Given())([given, given.slice(0, 0)]))
    each = len(T.facts_of("u", code, {1}, False))
    assert sum(b.num_rows for b in out) == 120 * each and max(b.num_rows for b in out) == T.HANDED_ON < 120 * each
    assert [u for b in out for u in b.column(0).to_pylist()] == [u for u in units for _ in range(each)]
