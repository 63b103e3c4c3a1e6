"""The whole review of a table of diffs: lines, windows, rule hits and dataflow, findings, evidence, confidence."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reviewlake.operators import lines as L
from reviewlake.operators import rules as R
from reviewlake.operators import taint as T
from reviewlake.operators import validation as V
from reviewlake.operators.reach import checkpointed

Analyzer = Callable[[DataFrame], DataFrame]


def semantic_hits(windows: DataFrame, rules: DataFrame, analyzers: list[Analyzer] | None = None, key: str = "review_id") -> DataFrame:
    """Sink matches of windows' images: one a window and rule, that of the image after before that of the image before; hardening supersedes risk.

    windows' columns, rule_id, boost, steps and what else a match has. What is found depends on the texts of a window's lines and how they changed
    alone, so windows of equal lines are analysed once, whatever review and file they are of; each gets the matches.
    analyzers: more functions from facts to matches (of register_rule_pack). Matches of rules that aren't active go.
    """
    spelled = lambda x: F.coalesce(F.concat_ws(":", x["change_type"], F.length(x["content"]).cast("string"), x["content"]), F.lit(""))
    python = windows.where(F.lower("file_path").rlike(r"\.pyi?$")).withColumn("same", F.sha2(F.array_join(F.transform("lines", spelled), "\n").cast("binary"), 256))
    code = F.transform("lines", lambda x: F.struct(x["content"].alias("content"), x["change_type"].alias("change_type")))
    each = checkpointed(python.select("same", code.alias("lines")).distinct())
    sources = T.window_sources(each.withColumns({"window_id": F.lit(0), "file_path": F.lit("")}), "same")
    facts = checkpointed(T.code_facts(sources, fragment=True))
    meta = sources.select("same", "unit", "image")
    patterns = _patterns(facts).join(meta.where("image = 'delete'"), "unit")
    old = patterns.select("same", F.col("pattern").alias("old_pattern"))
    previous = old.join(meta.where("image = 'add'"), "same").select("unit", "old_pattern")
    found = T.sink_matches(facts, "window", previous)
    for extra in analyzers or []:
        found = found.unionByName(extra(facts).select(found.columns))
    found = checkpointed(T.match_boost(found)).join(meta, "unit").join(rules.select("rule_id").distinct(), "rule_id", "left_semi")
    order = F.when(F.col("image") == "add", 0).otherwise(1)
    one = T.first_by(found.withColumn("_image", order), ["same", "rule_id"], ["_image", "call_seq"]).drop("_image", "unit")
    one = checkpointed(R.supersede(one, "py-regex-redos-hardening", "py-regex-redos", ["same"]))
    return python.join(one, "same").drop("same")


def _patterns(facts: DataFrame) -> DataFrame:
    imports = T.pick(facts, "import", local="name", full="text", seq="seq")
    calls = T.resolve_aliases(T.pick(facts, "call", call="node", scope="scope", call_seq="seq", name="name", line="line", changed="changed"), imports)
    args = T.pick(facts, "arg", call="node", node="ref", arg="name", text="text", arg_changed="changed")
    per = args.groupBy("unit", "call").agg(F.collect_list(F.struct("arg", "text", "node", "arg_changed")).alias("args"))
    return T.regex_sinks(facts, calls.join(per, ["unit", "call"])).select("unit", "pattern")


def review(diffs: DataFrame, rules: DataFrame, masked: DataFrame | None = None, min_confidence: float = R.MIN_CONFIDENCE, analyzers: list[Analyzer] | None = None, key: str = "review_id", semantic: bool = True) -> DataFrame:
    """Findings of every diff. masked: lines of the checkout that lie in multi-line strings (key, file_path, line_number)."""
    windows = L.evidence_windows(L.changed_lines(diffs), key)
    windows = checkpointed(windows) if semantic else windows  # else one pass reads them, and lines stand in many windows
    regex = R.rule_scan(R.scan_texts(windows, key, masked), rules, min_confidence).drop("text_kept", "text_code").withColumn("is_regex", F.lit(1))
    extra = {"boost": "double", "hit_mode": "string", "steps": "array<string>", "scope": "string"}
    if semantic:
        s = semantic_hits(windows, rules, analyzers, key)
        order = rules.select("rule_id", F.col("ord").alias("rule_ord"), (F.col("confidence")).alias("_c"))
        s = s.join(order, "rule_id").where(F.col("_c") + F.col("boost") >= min_confidence)
        s = s.select(key, "window_id", "file_path", "start_line", "end_line", "lines", "rule_ord", "rule_id", "family", F.lit(0).alias("is_regex"), "boost", F.col("mode").alias("hit_mode"), "steps", F.col("analysis_scope").alias("scope"))
        hits = regex.withColumns({c: F.lit(None).cast(t) for c, t in extra.items()}).select(s.columns).unionByName(s)
    else:
        hits = regex.withColumns({c: F.lit(None).cast(t) for c, t in extra.items()})
    hits = R.accept_hits(checkpointed(hits.withColumn("text_key", R.text_key(rules))), key)
    hits = R.supersede(hits, "py-regex-redos-hardening", "py-regex-redos", [key, "file_path"])
    order = Window.partitionBy(key).orderBy("window_id", "is_regex", "rule_ord")
    return R.build_findings(hits, rules, key).withColumn("seq", F.row_number().over(order) - 1)


def validated(findings: DataFrame, runs: DataFrame, tool_findings: DataFrame, markers: DataFrame, key: str = "review_id") -> tuple[DataFrame, DataFrame]:
    """Findings with final confidence, and the validation steps behind it."""
    steps = V.validation_plan(findings, runs, tool_findings, markers, key)
    return V.calibrate(findings, steps, runs, key), steps


def register_rule_pack(packs: list[DataFrame], analyzers: list[Analyzer], pack: DataFrame, analyzer: Analyzer | None = None) -> tuple[list[DataFrame], list[Analyzer]]:
    """Rule packs and analyzers with one more of each; of a repeated rule id the first pack's counts."""
    return [*packs, pack], [*analyzers, *([analyzer] if analyzer else [])]
