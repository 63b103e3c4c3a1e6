"""Dataflow over source code: one Arrow job turns files into flat facts, and joins over facts find tainted sinks.

A unit is a file, or a window's image before or after the change. Facts number expressions in the order in which they are
evaluated, the parts of an expression before it, so "the last assignment before" is an as-of join and "within" is an interval of
numbers. What an expression means (that it bounds a length, leaves a branch, spells SQL) is decided by joins of facts, not by the
walk. Taint is what sources reach along def-use, expression and call edges.
"""

from __future__ import annotations

import ast
import textwrap
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewlake.functions.columns import is_redos_prone, redos_hardening, redos_risk_score
from reviewlake.operators.joins import first_by, least_cover
from reviewlake.operators.reach import checkpointed, pointer_paths, reachable

FACT = "unit string, fact string, scope int, seq int, node int, ref int, last int, name string, text string, line int, changed boolean"

# Sources of taint, sinks, and the boosts of matches with and without taint.
SOURCE_CALLS = ["input", "builtins.input", "os.getenv", "os.environ.get", "os.environ.__getitem__"]
SOURCE_NAMES = ["sys.argv", "os.environ", "request.args", "request.GET", "request.POST", "request.form", "request.values", "request.json", "request.data", "request.cookies", "request.headers", "request.query_params"]
SOURCE_TAIL = r"\.(?:args|GET|POST|form|values|json|data|cookies|headers|query_params)$"
SUBPROCESS = ["call", "check_call", "check_output", "Popen", "run"]
OS_SHELL = ["os.system", "os.popen", "os.popen2", "os.popen3", "os.popen4"]
DYNAMIC = ["eval", "exec", "builtins.eval", "builtins.exec"]
REGEX = ["search", "match", "fullmatch", "findall", "finditer", "split", "sub", "subn", "compile"]
FORMS = ["NFC", "NFD", "NFKC", "NFKD"]
SQL_VERBS = "SELECT|INSERT|UPDATE|DELETE"
#: Comparisons that bound a length, and statements that leave a branch.
BOUNDS = ["Gt", "GtE", "Lt", "LtE"]
EXITS = (ast.Return, ast.Raise, ast.Continue, ast.Break)
#: Marks of what an expression has on the way from a part to itself: text put into a string, and two joined.
INTERPOLATED, COMBINED = "J", "B"


class Facts(ast.NodeVisitor):
    """One unit's facts. Children come before parents, values before the names they are given to."""

    def __init__(self, unit: str, changed: set[int]) -> None:
        self.unit, self.changed, self.rows, self.scope, self.scopes, self.n = unit, changed, [], 0, 1, 0
        self.function, self.around = "", [0]
        self.home = 0  # the innermost statement around that isn't an if
        self.leaves: dict[int, dict[int, str]] = {}  # by expression, the names and calls in it from which taint flows, with marks on their way
        self.sql: dict[int, set[int]] = {}  # and the parts that may make it SQL

    def put(self, fact: str, node: int | None = None, ref: int | None = None, name: str = "", text: str = "", at: ast.AST | None = None, last: int | None = None) -> None:
        self.n += 1
        first = getattr(at, "lineno", None)
        touched = first is not None and any(k in self.changed for k in range(first, (getattr(at, "end_lineno", None) or first) + 1))
        self.rows.append((self.unit, fact, self.scope, self.n, node, ref, last, name, text, first, touched))

    def fresh(self) -> int:
        self.n += 1
        return self.n

    def key(self, x: ast.AST) -> str:
        if isinstance(x, ast.Name):
            return x.id
        if isinstance(x, ast.Attribute):
            head = self.key(x.value)
            return f"{head}.{x.attr}" if head else ""
        return ""

    def call_name(self, x: ast.AST) -> str:
        if isinstance(x, ast.Attribute):
            head = self.call_name(x.value)
            return f"{head}.{x.attr}" if head else x.attr
        return x.id if isinstance(x, ast.Name) else ""

    def expr(self, x: ast.AST, spelled: int | None = None, asked: int | None = None) -> int:
        """Facts of an expression; its number.

        spelled: the string that it is a part of, if its own text goes into it. asked: the condition that it is a part of.
        """
        spelled, asked = spelled or self.fresh(), asked or self.fresh()
        begin = self.n
        parts = self.parts(x, spelled, asked)
        me = self.fresh()
        mark = {ast.JoinedStr: INTERPOLATED, ast.BinOp: COMBINED}.get(type(x), "")
        leaves = {leaf: way if way.endswith(mark) else way + mark for k in parts for leaf, way in self.leaves[k].items()}
        sql = set().union(*(self.sql[k] for k in parts)) if isinstance(x, ast.BinOp) else set()
        if key := self.key(x):
            self.put("use", me, name=key, at=x)
            sql.add(me)
        if key or isinstance(x, ast.Call):
            leaves[me] = ""
        self.leaves[me], self.sql[me] = leaves, sql
        if isinstance(x, ast.Constant) and isinstance(x.value, str):
            self.put("string", me, spelled, text=x.value)
        elif isinstance(x, ast.Compare):
            self.put("compare", me, asked, name=" ".join(type(o).__name__ for o in x.ops))
            for k in parts:
                self.put("operand", me, k)
        elif end := self.spells(x, parts, me):
            self.put("spelled", me, spelled, name=type(x).__name__, at=x, last=end)
            self.put("from", me, begin)
            self.anchor(me)
            sql.add(me)
        if isinstance(x, ast.Call):
            self.call(x, me)
            sql.add(me)
        return me

    def spells(self, x: ast.AST, parts: list[int], me: int) -> int | None:
        """The number up to which the text of an expression stands that is put together of strings: of a % only the left side."""
        if isinstance(x, ast.BinOp) and isinstance(x.op, (ast.Mod, ast.Add)):
            return parts[0] if isinstance(x.op, ast.Mod) else me
        if isinstance(x, ast.Call):
            return x._receiver if isinstance(x.func, ast.Attribute) and x.func.attr == "format" else None
        return me if isinstance(x, ast.JoinedStr) else None

    def anchor(self, node: int) -> None:
        """Edges into an expression that something asks about, straight from its names and calls: within it no join is needed."""
        for k, way in sorted(self.leaves[node].items()):
            if k != node:
                self.put("flow", node, k, text=way)
        for k in sorted(self.sql[node] - {node}):
            self.put("sqlflow", node, k)

    def parts(self, x: ast.AST, spelled: int, asked: int) -> list[int]:
        """The parts from which taint flows into an expression; the others are visited as well."""
        if isinstance(x, ast.Call):
            method = isinstance(x.func, ast.Attribute)
            text = method and x.func.attr == "format"
            x._receiver = self.expr(x.func.value, spelled if text else None) if method else None
            x._parts = [(str(i), self.expr(a), a) for i, a in enumerate(x.args)] + [(k.arg or "**", self.expr(k.value), k.value) for k in x.keywords]
            return [m[1] for m in x._parts] + ([x._receiver] if text or method and x.func.attr == "get" else [])
        if isinstance(x, (ast.JoinedStr, ast.FormattedValue)):
            return [self.expr(v, spelled) for v in (x.values if isinstance(x, ast.JoinedStr) else [x.value])]
        if isinstance(x, ast.BinOp):
            return [self.expr(x.left, spelled), self.expr(x.right, spelled)]
        if isinstance(x, (ast.BoolOp, ast.UnaryOp)):
            return [self.expr(v, None, asked) for v in (x.values if isinstance(x, ast.BoolOp) else [x.operand])]
        inside = [c for c in ast.iter_child_nodes(x) if isinstance(c, ast.expr)] + [c.iter for c in ast.iter_child_nodes(x) if isinstance(c, ast.comprehension)]
        found = [self.expr(c) for c in inside]
        return found if isinstance(x, (ast.Subscript, ast.Compare, ast.Attribute, ast.IfExp)) else []

    def call(self, x: ast.Call, me: int) -> None:
        self.put("call", me, name=self.call_name(x.func), text=x.func.id if isinstance(x.func, ast.Name) else "", at=x)
        for name, node, value in x._parts:
            text = f"s:{value.value}" if isinstance(value, ast.Constant) and isinstance(value.value, str) else repr(value.value) if isinstance(value, ast.Constant) else f"n:{self.key(value)}"
            self.anchor(node)
            self.put("arg", me, node, name, text, value)

    def visit_Import(self, x: ast.Import) -> None:
        for a in x.names:
            self.put("import", name=a.asname or a.name.split(".")[0], text=a.name)

    def visit_ImportFrom(self, x: ast.ImportFrom) -> None:
        for a in x.names if x.module else []:
            if a.name != "*":
                self.put("import", name=a.asname or a.name, text=f"{x.module}.{a.name}")

    def targets(self, t: ast.AST) -> Iterator[str]:
        if isinstance(t, (ast.Tuple, ast.List)):
            for e in t.elts:
                yield from self.targets(e)
        elif k := self.key(t):
            yield k

    def give(self, targets: list[ast.AST], value: ast.AST, node: int, at: ast.AST) -> None:
        self.anchor(node)
        for k in (k for t in targets for k in self.targets(t)):
            self.put("def", ref=node, name=k, text=type(at).__name__, at=at)
            if isinstance(value, ast.Constant) and isinstance(value.value, str) and isinstance(at, ast.Assign):
                self.put("const", name=k, text=value.value, at=at)

    def visit_Assign(self, x: ast.Assign) -> None:
        self.give(x.targets, x.value, self.expr(x.value), x)

    def visit_AnnAssign(self, x: ast.AnnAssign) -> None:
        if x.value is not None:
            self.give([x.target], x.value, self.expr(x.value), x)

    def visit_AugAssign(self, x: ast.AugAssign) -> None:
        value = self.expr(x.value)
        old = self.expr(x.target)
        both = self.fresh()
        self.leaves[both], self.sql[both] = self.leaves[value] | self.leaves[old], self.sql[value] | self.sql[old]
        self.give([x.target], x.value, both, x)

    def leave(self, x: ast.stmt) -> None:
        """A statement that leaves the branch it stands in."""
        if isinstance(x, ast.Return) and x.value is not None:
            node = self.expr(x.value)
            self.anchor(node)
            self.put("return", ref=node, name=self.function)
        else:
            self.generic_visit(x)
        self.put("exit", self.n, self.home)

    visit_Return = visit_Raise = visit_Continue = visit_Break = leave

    def visit_If(self, x: ast.If) -> None:
        asked = self.fresh()
        self.expr(x.test, None, asked)
        begin = self.n
        for s in x.body:
            self.visit(s)
        self.put("branch", asked, self.home, last=begin, at=x)  # its numbers lie between last and seq
        for s in x.orelse:
            self.visit(s)

    def function_body(self, x: ast.FunctionDef | ast.AsyncFunctionDef) -> None:
        outer = (self.scope, self.function, self.home)
        self.scopes += 1
        self.scope, self.function = self.scopes - 1, x.name
        self.around.append(self.scope)
        for k in self.around:
            self.put("scope", node=self.scope, ref=k, name=x.name)
        a = x.args
        for p in [*a.posonlyargs, *a.args, *a.kwonlyargs, *filter(None, (a.vararg, a.kwarg))]:
            self.put("param", name=p.arg)
        self.home = self.fresh()
        for s in x.body:
            self.visit(s)
        self.around.pop()
        self.scope, self.function, self.home = outer

    visit_FunctionDef = visit_AsyncFunctionDef = function_body

    def generic_visit(self, x: ast.AST) -> None:
        if isinstance(x, ast.expr):
            self.expr(x)
            return
        outer = self.home
        if isinstance(x, ast.stmt):
            self.home = self.fresh()
        super().generic_visit(x)
        self.home = outer


def facts_of(unit: str, source: str, changed: set[int], fragment: bool) -> list[tuple]:
    """Facts of one source; none where it can't be parsed. A fragment is dedented, then tried inside a function."""
    tries = [(source, 0)]
    if fragment:
        plain = textwrap.dedent(source)
        tries = [(plain, 0), ("def _fragment():\n" + textwrap.indent(plain, "    "), 1)]
    for text, shift in tries:
        try:
            tree = ast.parse(text)
        except (SyntaxError, ValueError, RecursionError):
            continue
        f = Facts(unit, {c + shift for c in changed})
        f.put("scope", node=0, ref=0)
        f.visit(tree)
        return f.rows
    return []


#: Facts after which a worker hands on what it has, and units that it takes at a time.
HANDED_ON, TAKEN = 20_000, 50


def code_facts(sources: DataFrame, fragment: bool = False) -> DataFrame:
    """Facts of every unit. sources: unit, source, changed (array of line numbers).

    Facts are handed on by HANDED_ON, units taken out of their batch by TAKEN: beside the batch a worker holds the facts of one unit and HANDED_ON more.
    """
    types = [pa.string(), pa.string(), *[pa.int32()] * 5, pa.string(), pa.string(), pa.int32(), pa.bool_()]
    schema = pa.schema([(c.split()[0], t) for c, t in zip(FACT.split(", "), types, strict=True)])
    packed = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for b in batches:
            for k in range(0, b.num_rows, TAKEN):
                for u, s, c in zip(*(x.to_pylist() for x in b.slice(k, TAKEN).columns), strict=True):
                    if s and s.strip() and c:
                        rows += facts_of(u, s, set(c), fragment)
                    while len(rows) >= HANDED_ON:
                        yield packed(rows[:HANDED_ON])
                        del rows[:HANDED_ON]
        if rows:
            yield packed(rows)

    return sources.select("unit", "source", "changed").mapInArrow(run, FACT)


def window_sources(windows: DataFrame, key: str = "review_id") -> DataFrame:
    """The images of windows of Python files: unit '<review>|<window>|add' of context and added lines, and '...|delete'."""
    out = []
    for kind in ("add", "delete"):
        own = F.filter("lines", _kept(kind))
        changed = F.array_compact(F.transform("_own", _numbered(kind)))
        w = windows.withColumn("_own", own).withColumn("changed", changed).where(F.size("changed") > 0)
        unit = F.concat_ws("|", F.col(key).cast("string"), F.col("window_id").cast("string"), F.lit(kind))
        out.append(w.select(key, "window_id", "file_path", unit.alias("unit"), F.array_join(F.transform("_own", lambda x: x["content"]), "\n").alias("source"), "changed", F.lit(kind).alias("image")))
    return out[0].unionByName(out[1])


def _kept(kind: str):
    return lambda x: x["change_type"].isin("context", kind)


def _numbered(kind: str):
    return lambda x, i: F.when(x["change_type"] == kind, i + 1)


def pick(facts: DataFrame, fact: str, **names: str) -> DataFrame:
    """One kind of facts, with columns named for what they mean."""
    return facts.where(F.col("fact") == fact).select("unit", *[F.col(c).alias(n) for n, c in names.items()])


def resolve_aliases(calls: DataFrame, imports: DataFrame, name: str = "name", out: str = "full_name") -> DataFrame:
    """calls with the dotted name whose head an import renames. imports: unit, local, full; a later import of a name wins."""
    last = first_by(imports, ["unit", "local"], [F.desc("seq")]).select("unit", F.col("local").alias("_head"), "full")
    c = calls.withColumn("_head", F.substring_index(F.col(name), ".", 1))
    tail = F.substr(F.col(name), F.length("_head") + 1)
    return c.join(last, ["unit", "_head"], "left").withColumn(out, F.when(F.col("full").isNotNull(), F.concat("full", tail)).otherwise(F.col(name))).drop("_head", "full")


def is_source_name(name: Column, full: Column) -> Column:
    return name.isin(SOURCE_NAMES) | full.isin(SOURCE_NAMES) | name.rlike(SOURCE_TAIL) | full.rlike(SOURCE_TAIL)


def scope_chain(facts: DataFrame) -> DataFrame:
    """unit, scope, ancestor: every scope with itself and those around it."""
    return pick(facts, "scope", scope="node", ancestor="ref")


def def_use_edges(facts: DataFrame) -> DataFrame:
    """unit, use (node), def_node, is_param, def_seq: for each use and scope around it the last definition before.

    An as-of join: uses and definitions of a name in a scope, in one order; a later definition hides an earlier one.
    """
    defs = pick(facts, "def", scope="scope", seq="seq", name="name", def_node="ref").withColumn("is_param", F.lit(False))
    params = pick(facts, "param", scope="scope", seq="seq", name="name").withColumns({"def_node": F.lit(None).cast("int"), "is_param": F.lit(True)})
    d = defs.unionByName(params).select("unit", "scope", "name", "seq", F.struct("def_node", "is_param", F.col("seq").alias("def_seq")).alias("d"), F.lit(None).cast("int").alias("use"))
    u = pick(facts, "use", own="scope", seq="seq", name="name", use="node").join(scope_chain(facts).withColumnRenamed("scope", "own"), ["unit", "own"])
    u = u.select("unit", F.col("ancestor").alias("scope"), "name", "seq", F.lit(None).cast("struct<def_node:int,is_param:boolean,def_seq:int>").alias("d"), "use")
    w = Window.partitionBy("unit", "scope", "name").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    seen = d.unionByName(u).withColumn("last", F.last("d", ignorenulls=True).over(w))
    return seen.where(F.col("use").isNotNull() & F.col("last").isNotNull()).select("unit", "use", "name", "last.*")


def taint_sources(facts: DataFrame, edges: DataFrame) -> DataFrame:
    """unit, node, origin: uses of parameters and of source names, and source calls."""
    imports = pick(facts, "import", local="name", full="text", seq="seq")
    uses = resolve_aliases(pick(facts, "use", node="node", name="name"), imports)
    calls = resolve_aliases(pick(facts, "call", node="node", name="name"), imports)
    named = uses.where(is_source_name(F.col("name"), F.col("full_name"))).select("unit", "node", F.col("name").alias("origin"))
    called = calls.where(F.col("full_name").isin(SOURCE_CALLS)).select("unit", "node", F.col("full_name").alias("origin"))
    params = edges.where("is_param").select("unit", F.col("use").alias("node"), F.col("name").alias("origin"))
    return named.unionByName(called).unionByName(params)


def returned_calls(facts: DataFrame) -> DataFrame:
    """unit, src, dst, func: from what a function of the unit returns to the calls of its name."""
    calls = pick(facts, "call", dst="node", func="text").where("func <> ''")
    return pick(facts, "return", func="name", src="ref").join(calls, ["unit", "func"])


def flow_edges(facts: DataFrame, edges: DataFrame) -> DataFrame:
    """unit, src, dst: from parts to expressions, and from assigned values to their uses."""
    return pick(facts, "flow", src="ref", dst="node").unionByName(edges.where("def_node is not null").select("unit", F.col("def_node").alias("src"), F.col("use").alias("dst")))


def sql_composites(facts: DataFrame) -> DataFrame:
    """unit, node: expressions put together of strings (by interpolation, %, + or format) with an SQL verb in the text that counts.

    The text is that of strings of the same whole, between the expression's first number and the last one that counts.
    """
    made = pick(facts, "spelled", node="node", whole="ref", upto="last").join(pick(facts, "from", node="node", begin="ref"), ["unit", "node"])
    verbs = pick(facts, "string", at="node", whole="ref", text="text").where(F.upper("text").rlike(SQL_VERBS)).select("unit", "whole", "at")
    return made.join(verbs, ["unit", "whole"]).where((F.col("at") > F.col("begin")) & (F.col("at") <= F.col("upto"))).select("unit", "node").distinct()


#: Flags of an expression: tainted, SQL made with taint, and both by way of an assignment on a changed line.
TAINTED, SQL, CHANGED, CHANGED_SQL = range(4)


def flags(facts: DataFrame, edges: DataFrame) -> DataFrame:
    """unit, node, flag: all flags of all expressions, to their fixpoint, over function calls within a unit too.

    It is one reachability over (expression, flag): values hand all flags to uses, also through returns, and the changed ones if the
    assignment changed; expressions take taint from their parts, SQL from parts that stay SQL; where SQL is put together, taint makes it SQL.
    """
    step = lambda df, *pairs: df.select("unit", F.explode(F.array(*[F.struct((F.col("src").cast("long") * 4 + a).alias("src"), (F.col("dst").cast("long") * 4 + b).alias("dst")) for a, b in pairs])).alias("e")).select("unit", "e.*")
    every = [(k, k) for k in range(4)]
    touched = pick(facts, "def", def_seq="seq", changed="changed").where("changed").select("unit", "def_seq")
    given = edges.where("def_node is not null").select("unit", "def_seq", F.col("def_node").alias("src"), F.col("use").alias("dst"))
    made = sql_composites(facts).select("unit", F.col("node").alias("src"), F.col("node").alias("dst"))
    moves = (
        step(pick(facts, "flow", src="ref", dst="node"), (TAINTED, TAINTED), (CHANGED, CHANGED)), step(pick(facts, "sqlflow", src="ref", dst="node"), (SQL, SQL), (CHANGED_SQL, CHANGED_SQL)),
        step(given, *every), step(given.join(touched, ["unit", "def_seq"], "left_semi"), (TAINTED, CHANGED), (SQL, CHANGED_SQL)),
        step(made, (TAINTED, SQL), (CHANGED, CHANGED_SQL)), step(returned_calls(facts), *every),
    )
    whole = moves[0]
    for m in moves[1:]:
        whole = whole.unionByName(m)
    seeds = taint_sources(facts, edges).select("unit", (F.col("node").cast("long") * 4 + TAINTED).alias("node"))
    return reachable(seeds, whole, ["unit"]).select("unit", F.floor(F.col("node") / 4).cast("int").alias("node"), (F.col("node") % 4).cast("int").alias("flag"))


def return_summaries(facts: DataFrame, flagged: DataFrame) -> DataFrame:
    """unit, func, tainted, sql, changed, changed_sql: the flags of what each function returns, joined over its returns."""
    r = pick(facts, "return", func="name", node="ref").join(flagged, ["unit", "node"], "left")
    bits = r.groupBy("unit", "func").agg(F.coalesce(F.bit_or(F.call_function("shiftleft", F.lit(1), F.col("flag"))), F.lit(0)).alias("bits"))
    return bits.select("unit", "func", *[(F.col("bits").bitwiseAND(1 << k) != 0).alias(n) for k, n in enumerate(("tainted", "sql", "changed", "changed_sql"))])


def origin_seeds(facts: DataFrame, edges: DataFrame, flagged: DataFrame) -> DataFrame:
    """unit, node, origin, step: sources of taint, and calls of functions of the unit that return it, as beginnings of explanations."""
    own = taint_sources(facts, edges)
    param = edges.where("is_param").select("unit", F.col("use").alias("node")).distinct().withColumn("_param", F.lit(True))
    call = pick(facts, "call", node="node").withColumn("_call", F.lit(True))
    own = own.join(param, ["unit", "node"], "left").join(call, ["unit", "node"], "left")
    tick = lambda before, c, after: F.concat(F.lit(f"{before}`"), c, F.lit(f"`{after}"))
    text = F.when(F.col("_param"), tick("parameter ", F.col("origin"), " treated as attacker-controlled")).when(F.col("_call"), tick("source call ", F.col("origin"), "")).otherwise("")
    back = returned_calls(facts).join(flagged.where(F.col("flag") == TAINTED).select("unit", F.col("node").alias("src")), ["unit", "src"], "left_semi")
    name = F.concat("func", F.lit("()"))
    returned = back.select("unit", F.col("dst").alias("node"), tick("return of ", name, "").alias("origin"), tick("call ", name, " returns tainted data").alias("step")).distinct()
    return own.select("unit", "node", "origin", text.alias("step")).unionByName(returned)


def propagate_taint(facts: DataFrame, edges: DataFrame | None = None, flagged: DataFrame | None = None) -> DataFrame:
    """unit, node, origin of every tainted expression. A call of a function that returns taint is an origin of its own."""
    edges = def_use_edges(facts) if edges is None else edges
    flagged = flags(facts, edges) if flagged is None else flagged
    return reachable(origin_seeds(facts, edges, flagged).select("unit", "node", "origin"), flow_edges(facts, edges), ["unit"], carry=("origin",))


def sql_format_exprs(facts: DataFrame, edges: DataFrame, flagged: DataFrame) -> DataFrame:
    """unit, node, changed: SQL put together with taint, and what it is assigned to, joined with or returned to; whether by a change."""
    sql = flagged.where(F.col("flag").isin(SQL, CHANGED_SQL))
    return sql.groupBy("unit", "node").agg(F.bool_or(F.col("flag") == CHANGED_SQL).alias("changed"))


def taint_path(facts: DataFrame, edges: DataFrame, flagged: DataFrame, ends: DataFrame) -> DataFrame:
    """unit, end, path: for each expression asked about the way that taint took to it, from its source on, as steps (node, line, text).

    ends: unit, end. Each tainted expression points at the least of the tainted ones that it takes taint from; sources, and calls that return taint,
    point nowhere. Numbers grow along the way, so pointers have no circles, and paths are read off by doubling them. text explains a step and may
    be empty: the source, interpolation or combination within an expression, an assignment on a changed line.
    """
    hot = flagged.where(F.col("flag") == TAINTED).select("unit", "node")
    seeds = origin_seeds(facts, edges, flagged).groupBy("unit", "node").agg(F.min("step").alias("step"))
    moves = pick(facts, "flow", src="ref", node="node", way="text").withColumn("def_seq", F.lit(None).cast("int"))
    moves = moves.unionByName(edges.where("def_node is not null").select("unit", F.col("def_node").alias("src"), F.col("use").alias("node"), F.lit("").alias("way"), "def_seq"))
    inner = moves.join(seeds.select("unit", "node"), ["unit", "node"], "left_anti").join(hot.withColumnRenamed("node", "src"), ["unit", "src"], "left_semi")
    parent = checkpointed(inner.groupBy("unit", "node").agg(F.min(F.struct("src", "way", "def_seq")).alias("p")).select("unit", "node", F.col("p.src").alias("parent"), "p.way", "p.def_seq"))
    back = pointer_paths(ends.join(hot.withColumnRenamed("node", "end"), ["unit", "end"], "left_semi"), parent, ["unit"])
    lines = pick(facts, "use", node="node", line="line").unionByName(pick(facts, "call", node="node", line="line")).groupBy("unit", "node").agg(F.min("line").alias("line"))
    given = pick(facts, "def", def_seq="seq", kind="text", changed="changed", def_line="line")
    b = back.join(seeds, ["unit", "node"], "left").join(parent, ["unit", "node"], "left").join(given, ["unit", "def_seq"], "left").join(lines, ["unit", "node"], "left")
    mixed = F.transform(F.filter(F.split("way", ""), lambda m: m != ""), lambda m: F.when(m == INTERPOLATED, F.lit("string interpolation incorporates tainted values")).otherwise(F.lit("string/binary combination preserves taint")))
    carried = F.when(F.col("changed") & (F.col("kind") == "Assign"), F.array(F.concat(F.lit("L"), F.col("def_line").cast("string"), F.lit(": assignment carries taint")))).otherwise(F.array().cast("array<string>"))
    text = F.when(F.col("step") == "", F.array().cast("array<string>")).when(F.col("step").isNotNull(), F.array("step")).otherwise(F.concat(F.coalesce(mixed, F.array().cast("array<string>")), carried))
    one = F.struct((-F.col("back")).alias("at"), "node", F.coalesce("line", "def_line").alias("line"), text.alias("text"))
    return b.groupBy("unit", "end").agg(F.sort_array(F.collect_list(one)).alias("path"))


def sink_matches(facts: DataFrame, scope: str = "window", previous: DataFrame | None = None) -> DataFrame:
    """unit, rule_id, sink_line, sink, sources, steps, boost, family, mode, call_seq: one row for each sink that a change touches.

    previous: unit, old_pattern (of the image before), for hardening of regular expressions.
    """
    facts = checkpointed(facts)  # many joins read them: without a cut the plan would hold the parsing once for each
    edges = checkpointed(def_use_edges(facts))
    flagged = flags(facts, edges)
    tainted = propagate_taint(facts, edges, flagged)
    moved = flagged.where(F.col("flag") == CHANGED).select("unit", "node", F.lit(True).alias("_moved"))
    sql = sql_format_exprs(facts, edges, flagged).select("unit", "node", F.lit(True).alias("_sql"), F.col("changed").alias("_sql_moved"))
    origins = tainted.groupBy("unit", "node").agg(F.array_sort(F.collect_set("origin")).alias("_origins"))
    imports = pick(facts, "import", local="name", full="text", seq="seq")
    calls = resolve_aliases(pick(facts, "call", call="node", scope="scope", call_seq="seq", name="name", line="line", changed="changed"), imports)
    args = pick(facts, "arg", call="node", node="ref", arg="name", text="text", arg_changed="changed")
    args = args.join(origins, ["unit", "node"], "left").join(moved, ["unit", "node"], "left").join(sql, ["unit", "node"], "left")
    one = F.struct("arg", "text", "node", "arg_changed", F.coalesce("_origins", F.array().cast("array<string>")).alias("origins"), F.coalesce("_moved", F.lit(False)).alias("moved"), F.coalesce("_sql", F.lit(False)).alias("sql"), F.coalesce("_sql_moved", F.lit(False)).alias("sql_moved"))
    per = args.groupBy("unit", "call").agg(F.collect_list(one).alias("args"))
    c = calls.join(per, ["unit", "call"], "left")
    kw = lambda k, v: F.coalesce(F.exists("args", lambda a: (a["arg"] == k) & (a["text"] == v)), F.lit(False))
    arg0 = F.get(F.filter("args", lambda a: a["arg"] == "0"), 0)
    flow = F.filter("args", lambda a: a["arg"].isin("0", "**", "args", "cmd", "command"))
    c = c.withColumns({"origins": F.coalesce(F.array_distinct(F.flatten(F.transform(flow, lambda a: a["origins"]))), F.array().cast("array<string>")), "moved0": F.coalesce(arg0["moved"], F.lit(False)), "sql0": F.coalesce(arg0["sql"], F.lit(False)), "sql_moved0": F.coalesce(arg0["sql_moved"], F.lit(False)), "end": F.get(F.filter(flow, lambda a: F.size(a["origins"]) > 0), 0)["node"]})
    c = checkpointed(c)
    full, hot = F.col("full_name"), F.size("origins") > 0
    shell = kw("shell", "True") & F.startswith(full, F.lit("subprocess.")) & F.substring_index(full, ".", -1).isin(SUBPROCESS)
    safe = F.coalesce(F.exists("args", lambda a: (a["arg"].isin("Loader") | (a["arg"] != "0")) & a["text"].rlike(r"^n:.*(?:SafeLoader)$")), F.lit(False))
    execute = full.rlike(r"\.(?:execute|executemany|executescript|raw)$")
    touched = F.col("changed") | F.col("moved0")
    two = lambda a, b: F.when(hot, a).otherwise(b)
    hits = [
        ("py-shell-true", shell & touched, F.concat(full, F.lit("(..., shell=True)")), two(0.10, 0.02), "shell=True on the command"),
        ("py-shell-true", full.isin(OS_SHELL) & touched, F.concat(full, F.lit("(...)")), two(0.10, 0.04), "OS shell sink"),
        ("py-eval-exec", full.isin(DYNAMIC) & touched, F.concat(full, F.lit("(...)")), two(0.10, 0.04), "dynamic code execution"),
        ("py-unsafe-yaml", (full == "yaml.load") & ~safe & touched, F.lit("yaml.load without SafeLoader"), F.lit(0.08), "Loader is not SafeLoader/CSafeLoader"),
        ("py-tls-verify-disabled", kw("verify", "False") & F.col("changed"), F.concat(full, F.lit("(..., verify=False)")), F.lit(0.06), "TLS certificate verification explicitly disabled"),
        ("weak-hash", F.lower(full).isin("hashlib.md5", "hashlib.sha1") & F.col("changed"), full, F.lit(0.05), "Weak hash constructor"),
        ("py-sql-string-format", execute & F.col("sql0") & (F.col("changed") | F.col("sql_moved0")), F.concat(full, F.lit("(<formatted SQL>)")), F.lit(0.12), "formatted/tainted SQL reaches DB execute"),
    ]
    row = lambda r, t, s, b, why: F.when(t, F.struct(F.lit(r).alias("rule_id"), s.alias("sink"), b.alias("boost"), F.lit(why).alias("why"), F.lit("").alias("family"), F.lit("").alias("mode")))
    plain = c.select("unit", "call_seq", F.col("line").alias("sink_line"), "origins", "end", F.explode(F.array_compact(F.array(*[row(*h) for h in hits]))).alias("h")).select("unit", "call_seq", "sink_line", "origins", "end", "h.*")
    out = checkpointed(plain.unionByName(_guarded(facts, c)).unionByName(_regex(facts, c, previous)))
    ways = taint_path(facts, edges, flagged, out.where("end is not null").select("unit", "end").distinct())
    out = out.join(ways, ["unit", "end"], "left")
    told = F.flatten(F.transform("path", lambda p: p["text"]))
    steps = F.array_distinct(F.concat(F.coalesce(told, F.array().cast("array<string>")), F.array("why")))
    return out.select("unit", "rule_id", "sink_line", "sink", F.col("origins").alias("sources"), steps.alias("steps"), "boost", F.lit(scope).alias("analysis_scope"), "family", "mode", "call_seq")


def _hot_node() -> Column:
    return F.when(F.size("subject.origins") > 0, F.col("subject.node"))


def length_guards(facts: DataFrame) -> DataFrame:
    """unit, scope, key, line, changed: conditions on len(key) by <, <=, > or >= whose branch can leave the way that goes on after it.

    A comparison is asked by a condition through and, or and not alone. A statement leaves a branch if it stands between the branch's first
    and last number and in the same innermost statement that isn't an if: the next one after a branch's beginning tells, in one sort.
    """
    branch = pick(facts, "branch", scope="scope", asked="node", home="ref", at="last", end="seq", line="line", changed="changed")
    leaves = pick(facts, "exit", home="ref", at="seq").withColumn("leaves", F.col("at"))
    both = branch.unionByName(leaves, allowMissingColumns=True)
    ahead = Window.partitionBy("unit", "home").orderBy("at").rowsBetween(1, Window.unboundedFollowing)
    left = both.withColumn("next", F.min("leaves").over(ahead)).where(F.col("asked").isNotNull() & (F.col("next") < F.col("end")))
    lone = pick(facts, "arg", call="node", arg="name", text="text").where(F.col("arg").rlike(r"^\d+$")).groupBy("unit", "call").agg(F.count(F.lit(1)).alias("n"), F.max("text").alias("text"))
    lone = lone.where("n = 1 AND text LIKE 'n:_%'").select("unit", "call", F.substr("text", F.lit(3)).alias("key"))
    sized = pick(facts, "call", call="node", func="text").where("func = 'len'").join(lone, ["unit", "call"])
    bound = pick(facts, "compare", compare="node", asked="ref", ops="name").where(F.arrays_overlap(F.split("ops", " "), F.array(*map(F.lit, BOUNDS))))
    asked = bound.join(pick(facts, "operand", compare="node", call="ref"), ["unit", "compare"]).join(sized, ["unit", "call"]).select("unit", "asked", "key").distinct()
    return left.join(asked, ["unit", "asked"]).select("unit", "scope", "key", "line", "changed")


def _guarded(facts: DataFrame, calls: DataFrame) -> DataFrame:
    """Unicode normalisation, hardened where a length guard on the same name stands on an earlier line."""
    n = calls.where((F.col("full_name") == "unicodedata.normalize") | (F.endswith("full_name", F.lit(".normalize")) & F.contains("full_name", F.lit("unicodedata"))))
    form = F.get(F.filter("args", lambda a: a["arg"].isin("0", "form") & F.startswith(a["text"], F.lit("s:"))), 0)["text"]
    subject = F.get(F.filter("args", lambda a: a["arg"].isin("1", "unistr", "string")), 0)
    n = n.withColumns({"form": F.substr(form, F.lit(3)), "subject": subject}).where(F.col("subject").isNotNull() & ~F.startswith("subject.text", F.lit("s:")) & (F.col("form").isNull() | F.col("form").isin(FORMS)))
    n = n.withColumn("key", F.when(F.startswith("subject.text", F.lit("n:")), F.substr("subject.text", F.lit(3))))
    guards = length_guards(facts).groupBy("unit", "scope", "key").agg(F.min("line").alias("guard_line"), F.bool_or("changed").alias("guard_changed"))
    n = n.join(guards, ["unit", "scope", "key"], "left").withColumn("guard_changed", F.coalesce("guard_changed", F.lit(False)))
    first = F.coalesce(F.col("guard_line") < F.col("line"), F.lit(False))
    n = n.where(F.col("changed") | F.col("guard_changed") | F.col("subject.moved"))
    hot = F.size("subject.origins") > 0
    boost = F.when(first & F.col("guard_changed"), 0.12).when(first, 0.08).when(hot, 0.10).otherwise(0.06)
    why = F.when(first, "length guard can exit before normalize").otherwise("expensive Unicode normalize on non-constant input without a preceding length guard")
    return n.select(
        "unit", "call_seq", F.col("line").alias("sink_line"), F.array_distinct(F.array_compact(F.concat("subject.origins", F.array("key")))).alias("origins"), F.lit("py-unicode-normalization-dos").alias("rule_id"),
        F.concat(F.lit('unicodedata.normalize("'), F.coalesce("form", F.lit("?")), F.lit('", ...)')).alias("sink"), boost.alias("boost"), why.alias("why"), F.lit("complexity-dos").alias("family"), _hot_node().alias("end"), F.when(first, "adds-hardening").otherwise("introduces-risk").alias("mode"),
    )


def regex_sinks(facts: DataFrame, calls: DataFrame) -> DataFrame:
    """calls of re.* with pattern: a literal, or the constant last bound to the name before the call; and whether that binding changed."""
    r = calls.where(F.startswith("full_name", F.lit("re.")) & F.substring_index("full_name", ".", -1).isin(REGEX))
    p = F.get(F.filter("args", lambda a: a["arg"].isin("0", "pattern")), 0)
    method = F.substring_index("full_name", ".", -1)
    at = F.when(method == "compile", None).when(method.isin("sub", "subn"), "2").otherwise("1")
    subject = F.get(F.filter("args", lambda a: (a["arg"] == at) | ((a["arg"] == "string") & (method != "compile"))), 0)
    r = r.withColumns({"p": p, "subject": subject}).where("p is not null").withColumn("name0", F.when(F.startswith("p.text", F.lit("n:")), F.substr("p.text", F.lit(3))))
    consts = pick(facts, "const", ancestor="scope", name0="name", c_seq="seq", const="text", c_changed="changed")
    around = r.where("name0 is not null").select("unit", "call", "scope", "call_seq", "name0").join(scope_chain(facts), ["unit", "scope"]).join(consts, ["unit", "ancestor", "name0"]).where("c_seq < call_seq")
    bound = around.groupBy("unit", "call").agg(F.max_by("const", F.struct("ancestor", "c_seq")).alias("bound"), F.bool_or("c_changed").alias("bound_changed"))
    r = r.join(bound, ["unit", "call"], "left").withColumn("bound_changed", F.coalesce("bound_changed", F.lit(False)))
    return r.withColumn("pattern", F.when(F.startswith("p.text", F.lit("s:")), F.substr("p.text", F.lit(3))).otherwise(F.col("bound"))).where("pattern is not null")


def _regex(facts: DataFrame, calls: DataFrame, previous: DataFrame | None) -> DataFrame:
    """Hardened or risky regular expressions. compile has no subject, so it gives no risk match: only the rule reports it."""
    r = regex_sinks(facts, calls)
    hot = F.coalesce(F.size("subject.origins") > 0, F.lit(False))
    if previous is not None:
        pairs = r.select("unit", "call", "pattern").join(previous.distinct(), "unit").where(redos_hardening("old_pattern", "pattern"))
        best = pairs.groupBy("unit", "call").agg(F.max(redos_risk_score("old_pattern") - redos_risk_score("pattern")).alias("drop"))
        r = r.join(best, ["unit", "call"], "left")
    else:
        r = r.withColumn("drop", F.lit(None).cast("int"))
    moved = F.coalesce(F.col("subject.moved"), F.lit(False))
    touched = F.col("changed") | F.coalesce(F.col("p.arg_changed"), F.lit(False)) | F.col("bound_changed") | moved
    hard = F.col("drop").isNotNull()
    risk = ~hard & is_redos_prone("pattern") & touched & F.col("subject").isNotNull()
    return r.where(hard | risk).select(
        "unit", "call_seq", F.col("line").alias("sink_line"), F.coalesce("subject.origins", F.array().cast("array<string>")).alias("origins"), F.when(hard, "py-regex-redos-hardening").otherwise("py-regex-redos").alias("rule_id"),
        F.concat("full_name", F.when(hard, "(<hardened pattern>)").otherwise("(<redos-prone pattern>)")).alias("sink"), F.when(hard, F.when(hot, 0.12).otherwise(0.09)).otherwise(F.when(hot, 0.12).otherwise(0.05)).alias("boost"),
        F.when(hard, "regex pattern risk reduced versus pre-image").otherwise("catastrophic-backtracking regex shape detected").alias("why"), F.lit("redos").alias("family"), _hot_node().alias("end"), F.when(hard, "adds-hardening").otherwise("introduces-risk").alias("mode"),
    )


def match_boost(matches: DataFrame) -> DataFrame:
    """One match for each rule of a unit, the first in order of evaluation; file scope adds 0.02 and 0.15 is the most."""
    more = F.col("boost") + F.when(F.col("analysis_scope") == "file", 0.02).otherwise(0.0)
    return first_by(matches, ["unit", "rule_id"], ["call_seq"]).withColumn("boost", F.round(F.least(F.lit(0.15), more), 2))


def redos_hardening_delta(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """keys, new_pattern, old_pattern: for each new pattern the old one that it hardens with the greatest fall of risk; the first on a tie.

    old: keys, old_pattern, old_seq. new: keys, new_pattern. Both are reduced to their different patterns before they meet.
    """
    old = old.groupBy(*keys, "old_pattern").agg(F.min(F.struct("old_seq"))["old_seq"].alias("old_seq"))
    p = old.join(new.select(*keys, "new_pattern").distinct(), keys).where(redos_hardening("old_pattern", "new_pattern")).withColumn("drop", redos_risk_score("old_pattern") - redos_risk_score("new_pattern"))
    return first_by(p, [*keys, "new_pattern"], [F.desc("drop"), "old_seq"]).select(*keys, "new_pattern", "old_pattern", "drop")


def attach_to_window(matches: DataFrame, windows: DataFrame, keys: list[str], match_id: list[str]) -> DataFrame:
    """matches with window_id: the first window that holds the sink line, else that of the nearest edge; without a line the first with an addition.

    windows: keys, window_id, start_line, end_line, has_add. Matches without windows go. The last end before a line and the first start after it
    come from one sort of edges and lines, the least window that holds it from dyadic cells: a match doesn't meet every window.
    """
    own = [*keys, *match_id]
    one = matches.dropDuplicates(own)
    edge = lambda kind, at, order: windows.select(*keys, F.col(at).alias("_at"), F.lit(kind).alias("_kind"), order.alias("_order"), F.struct(F.col(at).alias("at"), "window_id").alias("_edge"))
    ends, starts = edge(0, "end_line", -F.col("window_id")), edge(2, "start_line", F.col("window_id"))
    asked = one.where("sink_line IS NOT NULL").select(*own, F.col("sink_line").alias("_at"), F.lit(1).alias("_kind"))
    w = Window.partitionBy(*keys).orderBy("_at", "_kind", "_order")
    last = F.last(F.when(F.col("_kind") == 0, F.col("_edge")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    first = F.first(F.when(F.col("_kind") == 2, F.col("_edge")), ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    near = asked.unionByName(ends, allowMissingColumns=True).unionByName(starts, allowMissingColumns=True).withColumns({"_last": last, "_first": first}).where("_kind = 1")
    away = lambda e, d: F.when(F.col(e).isNotNull(), F.struct(d.alias("away"), F.col(e)["window_id"].alias("window_id")))
    near = near.select(*own, F.col("_at").alias("sink_line"), F.least(away("_last", F.col("_at") - F.col("_last")["at"]), away("_first", F.col("_first")["at"] - F.col("_at")))["window_id"].alias("_near"))
    cover = least_cover(asked.select(*keys, F.col("_at").alias("sink_line")), windows, keys, "sink_line", "start_line", "end_line", "window_id").withColumnRenamed("window_id", "_cover")
    found = near.join(cover, [*keys, "sink_line"], "left").select(*own, F.coalesce("_cover", "_near").alias("window_id"))
    whole = windows.groupBy(*keys).agg(F.min(F.struct(~F.col("has_add"), "window_id"))["window_id"].alias("window_id"))
    lost = one.where("sink_line IS NULL").select(own).join(whole, keys)
    return one.join(found.unionByName(lost).where("window_id IS NOT NULL"), own)


def prefer_richer(matches: DataFrame, keys: list[str]) -> DataFrame:
    """Of each rule of a window the match of file scope, largest boost, most steps, most sources; the first on a tie."""
    rank = [F.desc(F.col("analysis_scope") == "file"), F.desc("boost"), F.desc(F.size("steps")), F.desc(F.size("sources")), F.col("call_seq")]
    return first_by(matches, [*keys, "rule_id"], rank)
