"""Diffs, labelled cases, scanner manifests and event logs as tables, and reports as files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlake.functions.columns import filled, sarif_level
from reviewlake.operators.joins import first_by
from reviewlake.sources.tool_output import first_of, get

# Top-level keys that belong to a case's metadata, roles, and keys of a frozen manifest.
METADATA = ["project", "package", "language", "ecosystem", "cve", "cwe", "advisory", "upstream_pr", "vulnerability_class"]
ROLES = ["primary", "supporting", "benign", "negative-control"]
FROZEN = ["label", "adapter", "tool_name", "rule_map", "severity_map", "notes", "source", "cases"]
SECURITY = {"critical": "9.0", "high": "8.0", "medium": "5.0", "low": "3.0", "info": "1.0"}


def read_diffs(spark: SparkSession, path: str) -> DataFrame:
    """review_id (the file's name), subject, diff_text, source of each diff file."""
    t = spark.read.text(path, wholetext=True).withColumn("_path", F.col("_metadata.file_path"))
    name = F.regexp_replace(F.element_at(F.split("_path", "/"), -1), r"\.(?:diff|patch)$", "")
    return t.select(name.alias("review_id"), name.alias("subject"), F.col("value").alias("diff_text"), F.create_map(F.lit("diff_path"), F.col("_path")).alias("source"))


def read_cases(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """cases, expected and bad_records of JSON manifests: a list, or an object with "cases". The suite is the file's name."""
    t = spark.read.text(path, wholetext=True).select(F.regexp_replace(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1), r"\.json$", "").alias("suite"), F.try_parse_json("value").alias("doc"))
    return cases_of(t)


def cases_of(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The same from suite, doc (variant). Rejects don't stop the run: they are rows of bad_records with a reason."""
    items = F.coalesce(F.try_variant_get("doc", "$", "array<variant>"), F.try_variant_get("doc", "$.cases", "array<variant>"))
    each = docs.select("suite", F.posexplode(items).alias("pos", "c"))
    each = each.withColumns({"seq": F.col("pos") + 1, "case_id": F.coalesce(first_of("c", "$.id", "$.case_id"), F.concat(F.lit("case-"), (F.col("pos") + 1).cast("string")))})
    meta = F.coalesce(F.try_variant_get("c", "$.metadata", "map<string,string>"), F.create_map().cast("map<string,string>"))
    top = F.map_from_entries(F.array_compact(F.array(*[F.when(get("c", f"$.{k}").isNotNull(), F.struct(F.lit(k), get("c", f"$.{k}"))) for k in METADATA])))
    kept = F.map_filter(meta, lambda k, v: ~F.array_contains(F.map_keys(top), k))
    findings = F.try_variant_get("c", "$.expected_findings", "array<variant>")
    e = each.select("suite", "case_id", F.posexplode(findings).alias("exp_idx", "f"))
    plain = F.schema_of_variant("f") == "STRING"
    role = F.when(plain, "primary").otherwise(F.coalesce(first_of("f", "$.role"), F.lit("primary")))
    rule = F.when(plain, F.try_variant_get("f", "$", "string")).otherwise(first_of("f", "$.rule_id"))
    e = e.select(
        "suite", "case_id", "exp_idx", rule.alias("rule_id"), first_of("f", "$.file_path").alias("file_path"), get("f", "$.start_line", "int").alias("start_line"), get("f", "$.end_line", "int").alias("end_line"),
        first_of("f", "$.severity").alias("severity"), role.alias("role"), F.coalesce(get("f", "$.notes"), F.lit("")).alias("notes"),
    )
    good = filled("rule_id").isNotNull() & F.col("role").isin(ROLES)
    wanted = e.where(good & (F.col("role") != "negative-control")).groupBy("suite", "case_id").agg(F.sort_array(F.collect_list(F.struct("exp_idx", "rule_id"))).alias("_w"))
    own = F.try_variant_get("c", "$.expected_rules", "array<string>")
    strings = lambda p: F.coalesce(F.try_variant_get("c", p, "array<string>"), F.array().cast("array<string>"))
    cases = each.join(wanted, ["suite", "case_id"], "left").select(
        "suite", "case_id", "seq", first_of("c", "$.diff").alias("diff"), first_of("c", "$.diff_url", "$.patch_url").alias("diff_url"), first_of("c", "$.repo").alias("repo"), first_of("c", "$.repo_url").alias("repo_url"),
        first_of("c", "$.base_ref").alias("base_ref"), first_of("c", "$.head_ref").alias("head_ref"), first_of("c", "$.config").alias("config"),
        F.when(F.size(own) > 0, own).otherwise(F.coalesce(F.array_distinct(F.transform("_w", lambda x: x["rule_id"])), F.array().cast("array<string>"))).alias("expected_rules"),
        strings("$.tags").alias("tags"), F.map_concat(kept, top).alias("metadata"),
    )
    why = F.when(filled("rule_id").isNull(), "expected finding is missing rule_id").otherwise("expected finding role must be one of: primary, supporting, benign, negative-control")
    bad = e.where(~F.coalesce(good, F.lit(False))).select("suite", "case_id", "exp_idx", why.alias("reason"))
    unread = docs.where(items.isNull()).select("suite", F.lit(None).cast("string").alias("case_id"), F.lit(None).cast("int").alias("exp_idx"), F.lit("cases must be a JSON list or an object with a cases list").alias("reason"))
    return cases, e.where(good), bad.unionByName(unread)


def read_scanner_manifest(docs: DataFrame, artifacts: DataFrame) -> DataFrame:
    """case_id, adapter, tool_name, status, payload, skip_reason, error of each captured case. docs: doc (variant). artifacts: path, text.

    The payload comes from the artifact, "payload", the adapter's own key, or bare results or runs, in that order.
    """
    c = docs.select(F.coalesce(get("doc", "$.adapter"), F.lit("")).alias("_adapter"), F.coalesce(get("doc", "$.tool_name"), get("doc", "$.adapter")).alias("_tool"), F.explode(F.try_variant_get("doc", "$.cases", "array<variant>")).alias("c"))
    c = c.withColumns({"adapter": F.coalesce(first_of("c", "$.adapter"), "_adapter"), "path": first_of("c", "$.artifact")}).join(artifacts.select("path", F.col("text").alias("_artifact")), "path", "left")
    part = lambda p: F.to_json(F.try_variant_get("c", p, "variant"))
    semgrep, sarif = F.col("adapter") == "semgrep", F.col("adapter").isin("codeql", "sarif")
    wrap = lambda k: F.concat(F.lit(f'{{"{k}":'), part(f"$.{k}"), F.lit("}"))
    payload = F.coalesce("_artifact", part("$.payload"), F.when(semgrep, part("$.semgrep")), F.when(sarif, part("$.sarif")), F.when(semgrep, wrap("results")), F.when(sarif, wrap("runs")), F.lit(""))
    status = F.coalesce(first_of("c", "$.status"), F.lit("completed"))
    done = status == "completed"
    return c.select(
        first_of("c", "$.id", "$.case_id").alias("case_id"), "adapter", F.coalesce(first_of("c", "$.tool_name"), "_tool").alias("tool_name"), status.alias("status"), F.when(done, payload).otherwise("").alias("payload"),
        F.when(status == "skipped", F.coalesce(first_of("c", "$.skip_reason"), F.lit("scanner execution skipped"))).alias("skip_reason"), F.when(status == "error", F.coalesce(first_of("c", "$.error"), F.lit("scanner execution failed"))).alias("error"),
        first_of("c", "$.diff").alias("diff"), "path",
    )


def freeze_scanner_results(manifest: DataFrame, diffs: DataFrame) -> DataFrame:
    """case_id, frozen: JSON of each case with the diff's text and, for completed cases only, the payload inside. manifest: of read_scanner_manifest; diffs: case_id, diff_text."""
    m = manifest.drop("diff").join(diffs.select("case_id", F.col("diff_text").alias("diff")), "case_id", "left")
    row = F.struct(F.col("case_id").alias("id"), "adapter", "tool_name", "status", "diff", F.when(F.col("status") == "completed", F.col("payload")).alias("payload"), "skip_reason", "error")
    return m.select("case_id", F.to_json(row).alias("frozen"))


TRACE = "kind string, message string, payload string, timestamp timestamp"


def read_trace(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    """Events of JSON-line logs; the review is the folder that a log lies in."""
    reader = (spark.readStream if streaming else spark.read).schema(TRACE)
    t = reader.json(path)
    return t.select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2).alias("review_id"), *[c.split()[0] for c in TRACE.split(", ")])


def to_sarif(findings: DataFrame, key: str = "review_id", tool: str = "change-review") -> DataFrame:
    """key, sarif: one SARIF 2.1.0 document for each review. Of a rule the first finding describes it."""
    level = sarif_level("severity")
    rule = F.struct(
        F.col("rule_id").alias("id"), F.col("rule_id").alias("name"), F.struct(F.col("title").alias("text")).alias("shortDescription"), F.struct(F.coalesce(filled("risk"), "title").alias("text")).alias("fullDescription"),
        F.struct(F.coalesce(filled("fix_guidance"), filled("risk"), "title").alias("text")).alias("help"), F.struct(level.alias("level")).alias("defaultConfiguration"),
    )
    rules = first_by(findings.withColumn("_rule", rule), [key, "rule_id"], ["seq"]).groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("seq", "_rule"))), lambda x: x["_rule"]).alias("rules"))
    said = F.concat_ws(" ", "title", F.concat(F.lit("Fix: "), filled("fix_guidance")))
    place = F.struct(F.struct(
        F.struct(F.replace("file_path", F.lit("\\"), F.lit("/")).alias("uri")).alias("artifactLocation"),
        F.struct(F.greatest(F.lit(1), "start_line").alias("startLine"), F.greatest("start_line", "end_line").alias("endLine")).alias("region"),
    ).alias("physicalLocation"))
    result = F.struct(
        F.col("rule_id").alias("ruleId"), level.alias("level"), F.struct(said.alias("text")).alias("message"), F.array(place).alias("locations"),
        F.struct(F.col("finding_id").alias("findingId")).alias("partialFingerprints"), F.struct("confidence", "severity").alias("properties"),
    )
    results = findings.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("seq", result.alias("r")))), lambda x: x["r"]).alias("results"))
    run = F.struct(F.struct(F.struct(F.lit(tool).alias("name"), F.col("rules")).alias("driver")).alias("tool"), "results")
    doc = F.struct(F.lit("https://json.schemastore.org/sarif-2.1.0.json").alias("$schema"), F.lit("2.1.0").alias("version"), F.array(run).alias("runs"))
    return results.join(rules, key).select(key, F.to_json(doc, {"ignoreNullFields": "false"}).alias("sarif"))


def write_report_tables(tables: dict[str, DataFrame], path: str, partition: str = "suite") -> None:
    """Each table as Parquet under its name, in a folder for each suite where it has one."""
    for name, df in tables.items():
        w = df.write.mode("overwrite")
        (w.partitionBy(partition) if partition in df.columns else w).parquet(f"{path}/{name}")
