"""Scanner reports as rows: each parser takes (review_id, tool_name, payload) and gives tool findings. Bad JSON gives none."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewlake.functions.columns import filled

FINDING = ["review_id", "tool_name", "adapter", "rule_id", "message", "file_path", "start_line", "end_line", "severity", "metadata", "seq"]
INT = "int"


def get(v: str, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(F.col(v), path, kind)


def first_of(v: str, *paths: str) -> Column:
    """The first filled value of several spellings."""
    return F.coalesce(*[filled(get(v, p)) for p in paths])


def each(df: DataFrame, v: str, path: str, out: str, position: str) -> DataFrame:
    """One row for each element of the array at a path of a variant."""
    items = F.try_variant_get(F.col(v), path, "array<variant>")
    return df.select("*", F.posexplode(items).alias(position, out))


def parsed(runs: DataFrame, payload: str) -> DataFrame:
    return runs.select("review_id", "tool_name", F.xxhash64(payload).alias("report"), F.try_parse_json(F.col(payload)).alias("doc"))


def numbered(found: DataFrame, *places: str) -> DataFrame:
    """Findings with seq, from 0 in each review and tool, by report and then by place in it: two reports of a review share no number."""
    order = Window.partitionBy("review_id", "tool_name").orderBy("report", *places)
    return found.withColumn("seq", F.row_number().over(order) - 1).select(FINDING)


def slashes(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def parse_semgrep(runs: DataFrame, payload: str = "payload") -> DataFrame:
    r = each(parsed(runs, payload), "doc", "$.results", "r", "place")
    start = F.coalesce(get("r", "$.start.line", INT), F.lit(0))
    found = r.where(filled(get("r", "$.path")).isNotNull() & (start > 0)).select(
        "review_id", "tool_name", F.lit("semgrep").alias("adapter"), F.coalesce(get("r", "$.check_id"), F.lit("")).alias("rule_id"), F.coalesce(get("r", "$.extra.message"), F.lit("")).alias("message"),
        slashes(get("r", "$.path")).alias("file_path"), start.alias("start_line"), F.coalesce(get("r", "$.end.line", INT), start).alias("end_line"),
        F.lower(F.coalesce(get("r", "$.extra.severity"), F.lit("unknown"))).alias("severity"), F.to_json(F.try_variant_get("r", "$.extra.metadata", "variant")).alias("metadata"), "report", "place",
    )
    return numbered(found, "place")


def parse_sarif(runs: DataFrame, payload: str = "payload", adapter: str = "codeql") -> DataFrame:
    """First location only. Rules of the driver and of extensions; a later one of the same id wins."""
    r = each(parsed(runs, payload), "doc", "$.runs", "run", "run_no")
    results = each(r, "run", "$.results", "r", "place")
    driver = each(r, "run", "$.tool.driver.rules", "rule", "n").withColumn("part", F.lit(-1)).select("review_id", "tool_name", "report", "run_no", "part", "n", "rule")
    extensions = each(each(r, "run", "$.tool.extensions", "ext", "part"), "ext", "$.rules", "rule", "n").select("review_id", "tool_name", "report", "run_no", "part", "n", "rule")
    keys = ["review_id", "tool_name", "report", "run_no", "rule_id"]  # rules are those of their own report
    rules = driver.unionByName(extensions).withColumn("rule_id", filled(get("rule", "$.id"))).where("rule_id is not null")
    rules = rules.select(*keys, "part", "n", get("rule", "$.defaultConfiguration.level").alias("_level"), F.to_json(F.try_variant_get("rule", "$.properties", "variant")).alias("metadata"))
    rules = rules.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("part"), F.desc("n")))).where("_k = 1").drop("_k", "part", "n")
    place = "$.locations[0].physicalLocation"
    start = F.coalesce(get("r", f"{place}.region.startLine", INT), F.lit(0))
    uri = slashes(get("r", f"{place}.artifactLocation.uri"))
    path = F.when(F.startswith(uri, F.lit("file:///")), F.substr(uri, F.lit(9))).when(F.startswith(uri, F.lit("file://")), F.substr(uri, F.lit(8))).otherwise(F.ltrim(uri, F.lit("./")))
    found = results.where(filled(uri).isNotNull() & (start > 0)).select(
        "review_id", "tool_name", "report", "run_no", F.lit(adapter).alias("adapter"), F.coalesce(get("r", "$.ruleId"), F.lit("")).alias("rule_id"), F.coalesce(first_of("r", "$.message.text", "$.message.markdown"), F.lit("")).alias("message"),
        path.alias("file_path"), start.alias("start_line"), F.coalesce(get("r", f"{place}.region.endLine", INT), start).alias("end_line"), filled(get("r", "$.level")).alias("_own"), "place",
    )
    out = found.join(rules, keys, "left").withColumn("severity", F.lower(F.coalesce("_own", filled("_level"), F.lit("unknown"))))
    return numbered(out, "run_no", "place")


def parse_bandit(runs: DataFrame, payload: str = "payload") -> DataFrame:
    r = each(parsed(runs, payload), "doc", "$.results", "r", "place")
    start = F.coalesce(get("r", "$.line_number", INT), F.lit(0))
    lines = F.try_variant_get("r", "$.line_range", "array<int>")
    found = r.where(first_of("r", "$.filename", "$.path").isNotNull() & (start > 0)).select(
        "review_id", "tool_name", F.lit("bandit").alias("adapter"), F.coalesce(first_of("r", "$.test_id", "$.test_name"), F.lit("")).alias("rule_id"),
        F.coalesce(first_of("r", "$.issue_text", "$.message"), F.lit("")).alias("message"), slashes(first_of("r", "$.filename", "$.path")).alias("file_path"), start.alias("start_line"),
        F.coalesce(F.try_element_at(lines, F.lit(-1)), start).alias("end_line"), F.lower(F.coalesce(first_of("r", "$.issue_severity", "$.severity"), F.lit("unknown"))).alias("severity"),
        F.to_json(F.struct(get("r", "$.test_name").alias("test_name"), get("r", "$.issue_confidence").alias("issue_confidence"), get("r", "$.more_info").alias("more_info"))).alias("metadata"), "report", "place",
    )
    return numbered(found, "place")


def parse_pip_audit(runs: DataFrame, payload: str = "payload") -> DataFrame:
    """One row for each dependency and vulnerability, at line 1 of dependencies/<name>."""
    d = parsed(runs, payload)
    lists = [F.try_variant_get("doc", p, "array<variant>") for p in ("$", "$.dependencies", "$.packages", "$.results")]
    d = d.select("review_id", "tool_name", "report", F.posexplode(F.coalesce(*lists)).alias("dep_no", "dep"))
    d = d.withColumns({"name": F.trim(first_of("dep", "$.name", "$.package")), "version": F.trim(first_of("dep", "$.version", "$.installed_version"))}).where(filled("name").isNotNull())
    full = lambda p: F.try_variant_get("dep", p, "array<variant>")
    vulns = F.when(F.size(full("$.vulns")) > 0, full("$.vulns")).otherwise(full("$.vulnerabilities"))
    v = d.select("review_id", "tool_name", "report", "dep_no", "name", "version", F.posexplode(vulns).alias("vuln_no", "v"))
    names = lambda p: F.try_variant_get("v", p, "array<string>")
    fixes = F.when(F.size(names("$.fix_versions")) > 0, names("$.fix_versions")).otherwise(names("$.fixed_versions"))
    label = F.concat("name", F.coalesce(F.concat(F.lit("=="), filled("version")), F.lit("")))
    message = F.coalesce(first_of("v", "$.description", "$.summary"), F.concat(F.lit("Vulnerable dependency "), label))
    fixed = F.coalesce(F.size(fixes) > 0, F.lit(False))
    found = v.select(
        "review_id", "tool_name", F.lit("pip-audit").alias("adapter"), F.coalesce(first_of("v", "$.id", "$.advisory", "$.aliases[0]"), F.lit("unknown")).alias("rule_id"),
        F.when(fixed, F.concat(message, F.lit(" (fix: "), F.array_join(fixes, ", "), F.lit(")"))).otherwise(message).alias("message"), F.concat(F.lit("dependencies/"), "name").alias("file_path"),
        F.lit(1).alias("start_line"), F.lit(1).alias("end_line"), F.when(fixed, "high").otherwise("medium").alias("severity"),
        F.to_json(F.struct(F.col("name").alias("package"), "version", names("$.aliases").alias("aliases"), fixes.alias("fix_versions"))).alias("metadata"), "report", "dep_no", "vuln_no",
    )
    return numbered(found, "dep_no", "vuln_no")


Parser = Callable[[DataFrame], DataFrame]
PARSERS: dict[str, Parser] = {
    "semgrep": parse_semgrep, "codeql": parse_sarif, "sarif": parse_sarif, "bandit": parse_bandit, "bandit-json": parse_bandit,
    "pip-audit": parse_pip_audit, "pip_audit": parse_pip_audit, "pip-audit-json": parse_pip_audit,
}


def register_parser(parsers: dict[str, Parser], adapter: str, parser: Parser) -> dict[str, Parser]:
    """parsers with one more; a later registration replaces an earlier one."""
    return parsers | {adapter: parser}


def parse_tool_output(runs: DataFrame, parsers: dict[str, Parser] | None = None) -> DataFrame:
    """Findings of all runs by their adapter; unknown adapters give none. runs: review_id, tool_name, adapter, payload."""
    parsers = PARSERS if parsers is None else parsers
    by: dict[Parser, list[str]] = {}
    for adapter, parser in parsers.items():
        by.setdefault(parser, []).append(adapter)
    return reduce(DataFrame.unionByName, [p(runs.where(F.col("adapter").isin(names))) for p, names in by.items()])


def extract_evidence_markers(lines: DataFrame, prefix: str = "EVIDENCE:") -> DataFrame:
    """Marker objects after the prefix in log lines; bad JSON and other values than objects go. lines: review_id, tool_name, line_no, line."""
    raw = F.trim(F.substr("line", F.locate(prefix, F.col("line")) + len(prefix)))
    m = lines.where(F.contains("line", F.lit(prefix))).withColumn("doc", F.try_parse_json(raw)).where(F.startswith(raw, F.lit("{")) & F.col("doc").isNotNull())
    number = lambda *p: F.coalesce(*[F.nullif(get("doc", x, INT), F.lit(0)) for x in p])
    word = lambda *p: F.coalesce(first_of("doc", *p), F.lit(""))
    return m.select(
        "review_id", "tool_name", "line_no", F.coalesce(first_of("doc", "$.kind"), F.lit("validation")).alias("kind"), word("$.message").alias("message"), word("$.rule_id", "$.rule").alias("rule_id"),
        word("$.finding_id").alias("finding_id"), word("$.file_path", "$.file").alias("file_path"), number("$.start_line", "$.line").alias("start_line"), number("$.end_line", "$.line").alias("end_line"),
        word("$.check").alias("check"), word("$.payload").alias("payload"), word("$.assertion").alias("assertion"),
    )
