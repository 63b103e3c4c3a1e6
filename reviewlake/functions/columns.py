"""Column expressions that the operators share. All are JVM-side and code-generated where Spark allows it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Separators of lines.
LINE_BREAKS = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"
# Catastrophic shapes of regular expressions.
REDOS_SHAPES = [
    r"\((?:\?:)?[^)]*[+*][^)]*\)[+*]",
    r"\((?:\?:)?[^)]*[+*][^)]*\)\{\s*\d*\s*,",
    r"\((?:\?:)?\.\*,\)\*",
    r"\((?:\?:)?\.\+,\)\+",
    r"\((?:\?:)?[^)]*\|[^)]*\)[+*]",
    r"\((?:\?:)?[^)]*\|[^)]*\)\{\s*\d*\s*,",
    r"(?:\w|[.]|\\[wdsWDS])\+(?:\w|[.]|\\[wdsWDS])\+",
    r"(?:\w|[.]|\\[wdsWDS])\*(?:\w|[.]|\\[wdsWDS])\+",
    r"\.[*+]\.[*+]",
]
# Severities in their order, and their levels in SARIF.
SEVERITIES = ["critical", "high", "medium", "low", "info"]
SARIF_LEVELS = {"critical": "error", "high": "error", "medium": "warning", "low": "note", "info": "note"}


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def split_lines(text: Column | str) -> Column:
    """Lines of a text, cut at every line boundary; an empty tail is no line. Null gives null."""
    parts = F.split(col(text), LINE_BREAKS, -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def effective_line(new_line: Column | str, old_line: Column | str) -> Column:
    return F.coalesce(col(new_line), col(old_line))


def normalize_path(path: Column | str) -> Column:
    """Forward slashes, without any leading run of '.' and '/' characters."""
    return F.ltrim(F.replace(col(path), F.lit("\\"), F.lit("/")), F.lit("./"))


def paths_overlap(a: Column | str, b: Column | str) -> Column:
    """Equal, or one is the other's tail after a slash."""
    a, b = normalize_path(a), normalize_path(b)
    return (a == b) | F.endswith(a, F.concat(F.lit("/"), b)) | F.endswith(b, F.concat(F.lit("/"), a))


def line_range_overlap(lo1: Column | str, hi1: Column | str, lo2: Column | str, hi2: Column | str) -> Column:
    return (col(lo1) <= col(hi2)) & (col(lo2) <= col(hi1))


def is_python_path(path: Column | str) -> Column:
    return F.lower(col(path)).rlike(r"\.pyi?$")


def case_id_slug(case_id: Column | str) -> Column:
    """Other characters than letters, digits, '_', '.' and '-' as dashes; none at the ends; 'case' if nothing is left."""
    slug = F.trim(F.regexp_replace(col(case_id), "[^A-Za-z0-9_.-]+", "-"), F.lit("-"))
    return F.when(slug == "", "case").otherwise(slug)


def filled(c: Column | str) -> Column:
    """Null for an empty string."""
    return F.nullif(col(c), F.lit(""))


def safe_div(n: Column | str, d: Column | str, places: int = 4) -> Column:
    """n / d of whole numbers, rounded half up in whole-number arithmetic; 0.0 where d is 0."""
    n, d = F.coalesce(col(n), F.lit(0)).cast("long"), F.coalesce(col(d), F.lit(0)).cast("long")
    ten = 10**places
    whole = F.floor((n * (2 * ten) + d) / (2 * d)).cast("double")
    return F.when(d == 0, F.lit(0.0)).otherwise(whole / F.lit(float(ten)))


def accepted_rate(accepted: Column | str, findings: Column | str) -> Column:
    return F.when(F.coalesce(col(findings), F.lit(0)) == 0, F.lit(1.0)).otherwise(safe_div(accepted, findings))


def coverage_rate(covered: Column | str, steps: Column | str, findings: Column | str) -> Column:
    none = (F.coalesce(col(steps), F.lit(0)) == 0) & (F.coalesce(col(findings), F.lit(0)) == 0)
    return F.when(none, F.lit(1.0)).otherwise(safe_div(covered, steps))


def weighted_avg(value: Column | str, weight: Column | str, places: int = 2) -> Column:
    """Aggregate: sum of value times weight over sum of weight, in decimals; 0.0 without weight."""
    v, w = col(value).cast("decimal(12,6)"), F.coalesce(col(weight), F.lit(0)).cast("decimal(14,0)")
    return F.when(F.coalesce(F.sum(w), F.lit(0)) == 0, F.lit(0.0)).otherwise(F.round(F.sum(v * w) / F.sum(w), places).cast("double"))


def clamp_confidence(value: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(0.99), F.round(value.cast("decimal(12,6)"), 2).cast("double")))


def severity_rank(severity: Column | str) -> Column:
    return reduce(lambda a, s: F.when(col(severity) == s[1], s[0]).otherwise(a), enumerate(SEVERITIES), F.lit(99))


def sarif_level(severity: Column | str) -> Column:
    return reduce(lambda a, s: F.when(col(severity) == s, SARIF_LEVELS[s]).otherwise(a), SARIF_LEVELS, F.lit("warning"))


def snippet(lines: Column | str) -> Column:
    """Rendered lines of an evidence window: '+7: code'."""
    mark = lambda x: F.when(x["change_type"] == "add", "+").when(x["change_type"] == "delete", "-").otherwise(" ")
    number = lambda x: F.coalesce(x["new_line"], x["old_line"], F.lit(0)).cast("string")
    return F.array_join(F.transform(col(lines), lambda x: F.concat(mark(x), number(x), F.lit(": "), x["content"])), "\n")


def context_snippet(lines: Column | str) -> Column:
    mark = lambda x: F.when(x["role"] == "changed", ">").otherwise(" ")
    return F.array_join(F.transform(col(lines), lambda x: F.concat(mark(x), x["line_number"].cast("string"), F.lit(": "), x["content"])), "\n")


def comma_star_group(pattern: Column | str) -> Column:
    return col(pattern).rlike(r"\((?:\?:)?\.\*,\)\*")


def anchor_strength(pattern: Column | str) -> Column:
    """One for an anchored start, one for an anchored end, one for a start-or-comma group."""
    one = lambda c: F.when(c, 1).otherwise(0)
    return one(col(pattern).rlike(r"^\^|^\\A|\((?:\?:)?\^")) + one(col(pattern).rlike(r"(?:\$|\\[Zz])\z")) + one(col(pattern).rlike(r"\(\?:\^\|"))


def is_redos_prone(pattern: Column | str) -> Column:
    """Whether a regular expression has a catastrophic shape; inline flags are dropped first, and a single bounded class is exempt."""
    p = F.regexp_replace(col(pattern), r"\(\?[xis]\)", "")
    shape = reduce(lambda a, s: a | p.rlike(s), REDOS_SHAPES, F.lit(False))
    bounded = p.rlike(r"^\^?\[[^\]]+\]\{\d+(?:,\d+)?\}\$?\z")
    return F.coalesce((p != "") & ~bounded & shape, F.lit(False))


def redos_risk_score(pattern: Column | str) -> Column:
    """3 if prone, one for each of | + *, 5 for a comma-star group, less the strength of anchors; not below 0."""
    p = F.coalesce(col(pattern), F.lit(""))
    comma = F.when(comma_star_group(p), 5).otherwise(0)
    score = F.when(is_redos_prone(p), 3).otherwise(0) + F.regexp_count(p, F.lit("[|+*]")) + comma - anchor_strength(p)
    return F.greatest(score, F.lit(0))


def redos_hardening(old: Column | str, new: Column | str) -> Column:
    """Whether a new pattern hardens an old one: no longer prone, a lower score, no comma-star group, or better anchored where it mattered."""
    old, new = col(old), col(new)
    calmer = is_redos_prone(old) & ~is_redos_prone(new)
    lower = redos_risk_score(old) > redos_risk_score(new)
    no_group = comma_star_group(old) & ~comma_star_group(new)
    anchored = (anchor_strength(new) > anchor_strength(old)) & (is_redos_prone(old) | (redos_risk_score(old) >= 2))
    return F.coalesce((old != "") & (new != "") & (old != new) & (calmer | lower | no_group | anchored), F.lit(False))
