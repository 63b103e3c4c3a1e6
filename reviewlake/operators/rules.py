"""Rule scan over changed text: packs, masks, hits, first-wins and findings."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reviewlake.functions.columns import clamp_confidence, is_python_path
from reviewlake.operators.joins import first_by

RULE = "rule_id string, pack_id string, ord int, title string, severity string, pattern string, risk string, fix_guidance string, recommended_validation array<string>, confidence double, false_positive_notes string, scan_mode string, family string, mode string"
MIN_CONFIDENCE = 0.35

# The shipped rules. Their wording and patterns decide results, so they stand as they are.
RULES = [
    dict(rule_id="py-eval-exec", title="Dynamic code execution introduced", severity="high", confidence=0.72, pattern=r"\b(eval|exec)\s*\(",
         risk="Untrusted input reaching eval or exec can become arbitrary code execution.",
         fix_guidance="Replace dynamic execution with an explicit parser, allowlist, or data model.",
         recommended_validation=["unit tests for malicious input", "static taint analysis"],
         false_positive_notes="May be benign for constant-only expressions, but still requires review."),
    dict(rule_id="py-shell-true", title="Shell execution path introduced", severity="high", confidence=0.70, pattern=r"\bsubprocess\.[a-zA-Z_]+\([^)]*shell\s*=\s*True",
         risk="String commands with shell=True can allow command injection.",
         fix_guidance="Pass an argument list with shell=False and validate user-controlled fragments.",
         recommended_validation=["unit tests for shell metacharacters", "static command-injection rules"],
         false_positive_notes="Lower risk if every command fragment is constant and not user controlled."),
    dict(rule_id="py-sql-string-format", title="SQL query string formatting introduced", severity="high", confidence=0.64, scan_mode="python-text",
         pattern=r"""(?i)(SELECT|INSERT|UPDATE|DELETE).*(f["']|\.format\(|["']\s*%\s*[\w(])""",
         risk="Formatted SQL strings can allow injection when variables include attacker input.",
         fix_guidance="Use parameterized queries from the database driver.",
         recommended_validation=["SQL injection regression test", "static query construction scan"],
         false_positive_notes="Parameterized %s/%(name)s placeholders are safe; the semantic layer confirms taint."),
    dict(rule_id="py-unsafe-yaml", title="Unsafe YAML loading path changed", severity="medium", confidence=0.78, pattern=r"\byaml\.load\s*\((?![^)]*(SafeLoader|CSafeLoader))",
         risk="yaml.load can construct arbitrary Python objects with unsafe loaders.",
         fix_guidance="Use yaml.safe_load or an explicit SafeLoader.", recommended_validation=["unit test with object-construction payload"],
         false_positive_notes="SafeLoader may be provided in another argument; verify the call signature."),
    dict(rule_id="py-yaml-safe-loader", title="YAML safe loader enforcement changed", severity="medium", confidence=0.68,
         pattern=r"\b(yaml\.safe_load\s*\(|yaml\.load\s*\([^)]*(SafeLoader|CSafeLoader)|safe_load\s*=\s*load|def\s+danger_load\s*\()",
         risk="YAML parsing behavior changed around object construction and deserialization.",
         fix_guidance="Confirm only safe loaders parse untrusted YAML inputs.", recommended_validation=["unit test with object-construction payload"],
         false_positive_notes="A safe loader is a hardening signal; verify the call is on the vulnerable path."),
    dict(rule_id="py-tls-verify-disabled", title="TLS certificate verification disabled", severity="medium", confidence=0.74, pattern=r"\bverify\s*=\s*False\b",
         risk="Disabling certificate verification exposes requests to man-in-the-middle attacks.",
         fix_guidance="Keep verification enabled and configure trusted certificates explicitly.",
         recommended_validation=["integration test against expected certificate chain"],
         false_positive_notes="May be acceptable in test-only code if isolated from production paths."),
    dict(rule_id="weak-hash", title="Weak hash primitive introduced", severity="medium", confidence=0.58, pattern=r"(?i)\b(hashlib\.)?(md5|sha1)\s*\(",
         risk="MD5 and SHA-1 are unsuitable for collision-resistant security decisions.",
         fix_guidance="Use SHA-256 or a purpose-built password hashing/KDF primitive.",
         recommended_validation=["crypto policy check", "unit tests for migration compatibility"],
         false_positive_notes="May be acceptable for non-security checksums with clear labeling."),
    dict(rule_id="py-unicode-normalization-dos", title="Unicode normalization complexity DoS path changed", severity="medium", confidence=0.66,
         scan_mode="python-text", family="complexity-dos", mode="either",
         pattern=r"""unicodedata\.normalize\s*\(\s*["']NFK[CD]["']|normalize\s*\(\s*["']NFK[CD]["']""",
         risk="Unicode normalization (especially NFKC) on attacker-controlled strings can cause CPU denial of service without prior length or validity bounds.",
         fix_guidance="Reject or truncate overlong inputs before calling unicodedata.normalize, and keep expensive normalization off invalid values.",
         recommended_validation=["Unicode normalization complexity regression test"],
         false_positive_notes="Normalization on trusted constants is safe; hardening guards should dominate the normalize call on the same function path."),
    dict(rule_id="py-regex-redos-hardening", title="Regular expression DoS hardening changed", severity="medium", confidence=0.63,
         scan_mode="python-text", family="redos", mode="adds-hardening",
         pattern=r"re\.(search|match|compile|fullmatch|findall|sub)\s*\([^,\n]*(\(\s*[^)]*\|[^)]*\)\s*\+|\(\?:?\.\*,\)\*|\*\s*\$)",
         risk="Ambiguous repetition or alternation in regular expressions can cause ReDoS.",
         fix_guidance="Prefer linear-time regex structure, simpler alternatives, or bounded parsing.",
         recommended_validation=["ReDoS regression test with adversarial input"],
         false_positive_notes="Regex hardening is context-sensitive; confirm the changed expression is on attacker-controlled input. Length bounds alone are not ReDoS signals."),
    dict(rule_id="py-regex-redos", title="Regular expression DoS risk introduced", severity="medium", confidence=0.68,
         scan_mode="python-text", family="redos", mode="introduces-risk",
         pattern=r"""re\.(search|match|compile|fullmatch|findall|sub)\s*\(\s*[rbu]*["'][^"']*(\([^)]*[+*][^)]*\)[+*]|\(\?:?\.\*,\)\*)""",
         risk="Nested quantifiers or other catastrophic-backtracking shapes can deny service when applied to attacker-controlled input.",
         fix_guidance="Rewrite the expression to linear-time form, bound input length before matching, or use an atomic/possessive engine where available.",
         recommended_validation=["ReDoS regression test with adversarial input"],
         false_positive_notes="Shape heuristics can over-approximate; confirm the subject is untrusted and that the pattern is reachable in production paths."),
]
MODE_TITLES = {
    ("py-unicode-normalization-dos", "adds-hardening"): "Unicode normalization complexity DoS hardening changed",
    ("py-unicode-normalization-dos", "introduces-risk"): "Unicode normalization complexity DoS path introduced",
    ("py-regex-redos-hardening", "adds-hardening"): "Regular expression DoS hardening changed",
    ("py-regex-redos", "introduces-risk"): "Regular expression DoS risk introduced",
}


def pack(spark: SparkSession, rules: list[dict], pack_id: str) -> DataFrame:
    """Rule rows of one pack, in their order."""
    fields = [f.split()[0] for f in RULE.split(", ")]
    base = {"scan_mode": "python-code", "family": "", "mode": ""}
    return spark.createDataFrame([tuple((base | r | {"pack_id": pack_id, "ord": i}).get(f) for f in fields) for i, r in enumerate(rules)], RULE)


def rule_table(packs: list[DataFrame]) -> DataFrame:
    """All packs' rules; of a repeated rule id the first pack's counts. pack_ord and ord give their order."""
    numbered = [p.withColumn("pack_ord", F.lit(i)) for i, p in enumerate(packs)]
    return first_by(reduce(DataFrame.unionByName, numbered), ["rule_id"], ["pack_ord", "ord"])


def shipped_rules(spark: SparkSession) -> DataFrame:
    return rule_table([pack(spark, RULES, "builtin")])


STRING = r"""(?:[rbufRBUF]{0,2})(?:"(?:[^"\\\n]|\\.)*+"|'(?:[^'\\\n]|\\.)*+')"""


def strip_comments(line: Column, keep_strings: bool) -> Column:
    """A line without its comment; string literals become "" unless kept. f-strings are kept: their text is code."""
    kept = F.regexp_replace(line, rf"({STRING})|#.*", "$1")
    literal = F.regexp_replace(kept, rf"(?<![A-Za-z0-9_])([fF][rR]?(?:\"(?:[^\"\\\n]|\\.)*+\"|'(?:[^'\\\n]|\\.)*+'))|{STRING}", "$1\x01")
    blanked = F.replace(F.regexp_replace(literal, r"(?<=[\"'])\x01", ""), F.lit("\x01"), F.lit('""'))
    return kept if keep_strings else blanked


def mask_multiline_strings(lines: DataFrame, keys: list[str], order: str = "line_number", content: str = "content") -> DataFrame:
    """lines with masked: whether a line lies in a triple-quoted string that spans lines.

    Delimiters of both kinds are counted per line; a line is inside where the count before or through it is odd.
    A last opener that never closes masks to the end only where code stands before it on its line.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    out = lines
    flags = []
    for k, quote in enumerate(('"""', "'''")):
        n = F.regexp_count(F.col(content), F.lit(quote))
        out = out.withColumn(f"_n{k}", n).withColumn(f"_to{k}", F.sum(f"_n{k}").over(w)).withColumn(f"_all{k}", F.sum(f"_n{k}").over(Window.partitionBy(*keys)))
        before = F.trim(F.substring_index(F.col(content), quote, 1))
        opener = (F.col(f"_to{k}") % 2 == 1) & (F.col(f"_to{k}") == F.col(f"_all{k}")) & (F.col(f"_n{k}") % 2 == 1)
        out = out.withColumn(f"_end{k}", F.max(F.when(opener, (before != "") & ~F.startswith(before, F.lit("#")))).over(Window.partitionBy(*keys)))
        open_after, open_before = F.col(f"_to{k}") % 2 == 1, (F.col(f"_to{k}") - F.col(f"_n{k}")) % 2 == 1
        closes = (F.col(f"_to{k}") < F.col(f"_all{k}")) | (F.col(f"_all{k}") % 2 == 0)
        flags.append((open_after | open_before) & (closes | (open_before & (F.col(f"_n{k}") > 0)) | F.coalesce(F.col(f"_end{k}"), F.lit(False))))
    return out.withColumn("masked", reduce(lambda a, b: a | b, flags)).drop(*[f"_{n}{k}" for n in ("n", "to", "all", "end") for k in (0, 1)])


def scan_texts(windows: DataFrame, key: str = "review_id", masked: DataFrame | None = None) -> DataFrame:
    """windows of Python files with text_kept and text_code: their changed lines, added before deleted, without comments, and without strings.

    masked: key, file_path, line_number of checkout lines inside multi-line strings; added lines there don't count.
    """
    w = windows.where(is_python_path("file_path"))
    if masked is not None:
        spans = masked.groupBy(key, "file_path").agg(F.collect_set("line_number").alias("_masked"))
        w = w.join(spans, [key, "file_path"], "left")
        added = F.filter("lines", lambda x: (x["change_type"] == "add") & ~F.coalesce(F.array_contains("_masked", x["new_line"]), F.lit(False)))
        w = w.withColumn("_added", added).drop("_masked")
    else:
        w = w.withColumn("_added", F.filter("lines", lambda x: x["change_type"] == "add"))
    changed = F.concat("_added", F.filter("lines", lambda x: x["change_type"] == "delete"))
    w = w.withColumn("_changed", F.transform(changed, lambda x: x["content"])).drop("_added")
    spans_out = _outside_triple("_changed")
    return w.withColumns({
        "text_kept": F.array_join(F.transform("_changed", lambda c: strip_comments(c, True)), "\n"),
        "text_code": F.array_join(F.transform(spans_out, lambda c: strip_comments(c, False)), "\n"),
    }).drop("_changed")


def _outside_triple(lines: str) -> Column:
    """The lines with those blanked that a triple-quoted string spans, closed or, with code before an opener that nothing closes, to the end."""
    joined = F.array_join(F.col(lines), "\n")
    closed = r"(?md)^(?:(?:(?!{0})[^\n])*+{0}(?:(?!{0})[^\n])*+{0})*+(?:(?!{0})[^\n])*+{0}(?:(?!{0})[^\n])*+\n(?:(?!{0})[\s\S])*+{0}[^\n]*"  # an odd number of delimiters opens
    open_end = r"(?md)^(?![^\S\n]*(?:#|{0}))[^\n]*?{0}(?:(?!{0})[\s\S])*+\z"
    for quote in ('"""', "'''"):
        masked = F.regexp_replace(F.regexp_replace(joined, closed.format(quote), ""), open_end.format(quote), "")
        joined = F.when(F.contains(joined, F.lit(quote)), masked).otherwise(joined)
    return F.split(joined, "\n", -1)


def rule_scan(texts: DataFrame, rules: DataFrame, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """One row for each text and rule whose pattern is found: the texts' columns, rule_id, rule_ord. texts: text_kept, text_code.

    The rules are few and fixed for a run, so each pattern is a literal, compiled once, and one pass over the
    texts asks for all; there is no join of texts with rules.
    """
    rows = rules.where(F.col("confidence") >= min_confidence).orderBy("pack_ord", "ord").collect()
    hit = [
        F.when(F.col("text_kept" if r["scan_mode"] == "python-text" else "text_code").rlike(r["pattern"]), F.struct(F.lit(i).alias("rule_ord"), F.lit(r["rule_id"]).alias("rule_id"), F.lit(r["family"]).alias("family")))
        for i, r in enumerate(rows)
    ]
    if not hit:
        return texts.where("false").withColumns({"rule_ord": F.lit(0), "rule_id": F.lit(""), "family": F.lit("")})
    return texts.withColumn("_hit", F.explode(F.array_compact(F.array(*hit)))).select(*texts.columns, "_hit.rule_ord", "_hit.rule_id", "_hit.family")


def text_key(rules: DataFrame) -> Column:
    """What tells hits of a rule apart in a file: the changed lines that match it alone, or the window's start."""
    rows = rules.select("rule_id", "pattern").collect()
    changed = F.filter("lines", lambda x: x["change_type"] != "context")
    one = lambda x: F.concat(x["change_type"], F.lit(":"), F.coalesce(x["new_line"], x["old_line"], F.lit(0)).cast("string"), F.lit(":"), F.trim(x["content"]))
    of = lambda p: F.array_join(F.transform(F.filter(changed, lambda x: x["content"].rlike(p)), one), "|")
    key = reduce(lambda a, r: F.when(F.col("rule_id") == r["rule_id"], of(r["pattern"])).otherwise(a), rows, F.lit(""))
    return F.when(key == "", F.concat(F.lit("window:"), F.col("start_line").cast("string"))).otherwise(key)


def dedupe_findings(hits: DataFrame, key_col: str = "text_key", key: str = "review_id", order: tuple[str, ...] = ("window_id", "is_regex", "rule_ord")) -> DataFrame:
    """The first hit of each review, rule, file and text key. It implies the first of each line range."""
    return first_by(hits, [key, "rule_id", "file_path", key_col], list(order))


def needless(rule_id: str, family: str | None, families: set[str]) -> bool:
    """Whether accepted dataflow hits of a window, by their families, make a regex hit needless."""
    if family == "redos":
        return bool(families & {"redos", "complexity-dos"})
    return rule_id == "py-unicode-normalization-dos" and "complexity-dos" in families


def accept_hits(hits: DataFrame, key: str = "review_id") -> DataFrame:
    """The hits that count: along a file's windows, dataflow before regexes and by rule within, the first of each rule and text key.

    A regex hit goes where a hit accepted before it in the same window makes it needless; one that was a repetition itself, and so wasn't
    accepted, makes nothing needless. What is accepted decides what comes after, so a file's hits stream in order through one task, which
    keeps the keys seen in the file. hits: key, file_path, window_id, is_regex, rule_ord (these identify one), rule_id, family, text_key.
    """
    place = [key, "file_path", "window_id", "is_regex", "rule_ord"]
    narrow = hits.select(*[F.col(c) for c in place], "rule_id", "family", F.md5(F.coalesce("text_key", F.lit("")).cast("binary")).alias("text_key"))
    narrow = narrow.withColumn("_file", F.struct(key, "file_path")).withColumn("_file", F.sha2(F.to_json("_file"), 256))
    kinds = {f.name: f.dataType.simpleString() for f in narrow.schema}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        file = window = None
        seen: set[tuple] = set()
        families: set[str] = set()
        for b in batches:
            kept = []
            for f, w, regex, rule, family, text in zip(b["_file"], b["window_id"], b["is_regex"], b["rule_id"], b["family"], b["text_key"], strict=True):
                if f != file:
                    file, window, seen = f, None, set()
                if w != window:
                    window, families = w, set()
                fine = (rule, text) not in seen and not (regex and needless(rule, family, families))
                kept.append(fine)
                if fine:
                    seen.add((rule, text))
                    if not regex and family:
                        families.add(family)
            yield b.loc[kept, place]

    ordered = narrow.repartition("_file").sortWithinPartitions("_file", "window_id", "is_regex", "rule_ord")
    accepted = ordered.mapInPandas(run, ", ".join(f"`{c}` {kinds[c]}" for c in place))
    return hits.join(accepted, place, "left_semi")


def supersede(findings: DataFrame, winner: str, loser: str, keys: list[str], rule_col: str = "rule_id") -> DataFrame:
    """findings without those of `loser` where, equal in keys, one of `winner` stands."""
    won = findings.where(F.col(rule_col) == winner).select(*keys).distinct().withColumn("_loser", F.lit(loser))
    return findings.join(won, [*[findings[k] == won[k] for k in keys], findings[rule_col] == won["_loser"]], "left_anti")


def min_confidence(df: DataFrame, least: float, column: str = "confidence") -> DataFrame:
    return df.where(F.col(column) >= least)


def build_findings(hits: DataFrame, rules: DataFrame, key: str = "review_id") -> DataFrame:
    """Findings with their rule's texts. hits may have boost, hit_mode, hit_family, steps and scope of a semantic match."""
    for name, kind in (("boost", "double"), ("hit_mode", "string"), ("hit_family", "string"), ("scope", "string"), ("steps", "array<string>")):
        if name not in hits.columns:
            hits = hits.withColumn(name, F.lit(None).cast(kind))
    meta = rules.select("rule_id", "title", "severity", "risk", "fix_guidance", "recommended_validation", "false_positive_notes", F.col("confidence").alias("rule_confidence"))
    f = hits.drop("title", "severity", "confidence").join(meta, "rule_id")
    confidence = F.col("rule_confidence") + F.coalesce("boost", F.lit(0.0))
    confidence = clamp_confidence(confidence)
    confidence = F.when(F.col("hit_mode") == "introduces-risk", clamp_confidence(confidence + 0.02)).otherwise(confidence)
    title = reduce(lambda a, m: F.when((F.col("rule_id") == m[0]) & (F.col("hit_mode") == m[1]), MODE_TITLES[m]).otherwise(a), MODE_TITLES, F.col("title"))
    finding_id = F.concat("rule_id", F.lit("@"), "file_path", F.lit(":"), F.col("start_line").cast("string"), F.lit("-"), F.col("end_line").cast("string"))
    return f.withColumns({"finding_id": finding_id, "title": title, "confidence": confidence, "mode": F.coalesce("hit_mode", F.lit("")), "analysis_scope": F.coalesce("scope", F.lit("")), "dataflow_steps": F.coalesce("steps", F.array().cast("array<string>"))}).drop("rule_confidence", "boost", "hit_mode", "hit_family", "scope", "steps")
