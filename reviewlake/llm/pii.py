"""Personal data and secrets: high-recall generators, boosted trees, calibrated thresholds. DataFrame functions only.

Every generator is a pattern whose matches, with their places and surroundings, are found inside the row. Base
kinds that pass their format check are always redacted. Overlapping candidates of the other generators become
small integers (shape of the string, what stands around it); Spark counts the whole corpus by these feature
vectors and by what a seed rule says of them, trees are boosted on that table of counts, and each generator
gets the lowest threshold that keeps its precision on the other fold. The model is a CASE expression.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewlake.llm.common import stage

# Runs are taken possessively, and a run is entered at its start only: linear time on any text.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
KEYWORD = r"(?i)(?:password|passwd|pwd|passphrase|secret|token|api[_-]?key|access[_-]?key|bearer)"
KEY = r"(?<![A-Za-z0-9_+/=-])(?=[A-Za-z_+/-]*+[0-9])[A-Za-z0-9_+/-]{8,}+={0,2}+"
ASSIGNED = KEYWORD + r"[\"']?+[\x20\t]{0,3}+[:=][\x20\t]{0,3}+[\"']?+[^\s\"']{4,}+"
NUMBER = r"(?<![0-9A-Za-z.+(-])[0-9](?:[\x20().-]{0,2}+[0-9]){6,}+"
OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"

BASE = {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE}
#: Generators of candidates and the kind of span each of them adds.
MORE = {"key": (KEY, "secret"), "assigned": (ASSIGNED, "secret"), "number": (NUMBER, "number")}
SPAN = "array<struct<kind:string,start:int,end:int,value:string,before:string,after:string>>"
FEATURES = ["generator", "length", "digits", "upper", "lower", "hexadecimal", "groups", "keyword", "mark_before", "mark_after"]


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value worked out once."""
    return F.get(F.transform(F.array(value), use), 0)


def running(values: Column, join: Callable[[Column, Column], Column]) -> Column:
    """Running sums or maxima (0 at first) of an array of ints, in about n * sqrt(n) steps: along blocks, then over the blocks' last ones."""
    none = F.array().cast("array<int>")

    def along(items: Column, last: Callable[[Column], Column]) -> Column:
        grown = lambda a, x: F.concat(a, F.array(join(F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(0)), last(x)).cast("int")))
        return F.aggregate(items, none, grown)

    def whole(v: Column, size: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / size).cast("int")), lambda k: along(F.slice(v, k * size + 1, size), lambda x: x))
        before = lambda ends, k: F.when(k == 0, 0).otherwise(F.get(ends, k - 1))
        return let(blocks, lambda bs: let(along(bs, lambda x: F.element_at(x, -1)), lambda ends: F.flatten(F.transform(bs, lambda x, k: F.transform(x, lambda y: join(before(ends, k), y).cast("int"))))))

    return let(values, lambda v: F.when(F.size(v) > 0, let(F.ceil(F.sqrt(F.size(v))).cast("int"), lambda size: whole(v, size))).otherwise(none))


def matches(text: Column, kind: str, pattern: str) -> Column:
    """All leftmost non-overlapping matches with code point offsets, end exclusive, and up to 24 characters before, 8 after.

    The text is never entered by an offset, which would cost a walk from its start: places are sums of the pieces' lengths.
    """

    def spans(apart: Column, found: Column, ends: Column) -> Column:
        def span(m: Column, k: Column) -> Column:
            after = F.concat(F.left(F.get(apart, k + 1), F.lit(8)), F.left(F.coalesce(F.get(found, k + 1), F.lit("")), F.lit(8)))
            return F.struct(
                F.lit(kind).alias("kind"), (F.get(ends, k) - F.length(m)).alias("start"), F.get(ends, k).alias("end"), m.alias("value"),
                F.right(F.get(apart, k), F.lit(24)).alias("before"), F.left(after, F.lit(8)).alias("after"),
            )

        return F.transform(found, span)

    lengths = lambda apart, found: F.transform(found, lambda m, k: F.length(F.get(apart, k)) + F.length(m))
    ends = lambda apart, found: let(running(lengths(apart, found), lambda a, b: a + b), lambda e: spans(apart, found, e))
    return let(F.split(text, pattern, -1), lambda apart: let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda found: ends(apart, found)))


def reach(spans: Column, before: Callable[[Column], Column], base: Column) -> Column:
    """For each span the furthest end (0: none) of the base spans that start before the place before(span); one sort and one running maximum."""
    event = lambda place, kind, end, k: F.struct(place.cast("int").alias("place"), F.lit(kind).alias("kind"), k.cast("int").alias("k"), end.cast("int").alias("end"))
    asked = F.transform(spans, lambda s, k: event(before(s), 0, F.lit(0), k))
    both = F.array_sort(F.concat(asked, F.transform(base, lambda b, k: event(b["start"], 1, b["end"], k))))

    def answer(events: Column, most: Column) -> Column:
        found = F.transform(events, lambda e, i: F.struct(e["kind"].alias("kind"), e["k"].alias("k"), F.get(most, i).alias("most")))
        return F.transform(F.array_sort(F.filter(found, lambda e: e["kind"] == 0)), lambda e: e["most"])

    runs = lambda events: let(running(F.transform(events, lambda e: e["end"]), F.greatest), lambda most: answer(events, most))
    return F.when((F.size(spans) > 0) & (F.size(base) > 0), let(both, runs)).otherwise(F.transform(spans, lambda _: F.lit(0)))


def passes(kind: str, value: Column) -> Column:
    """The format check of a base kind."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        return value.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$")
    if kind == "card":
        return F.length(digits).between(13, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def check(kind: str) -> Callable[[Column], Column]:
    return lambda s: passes(kind, s["value"])


def base_spans(text: Column) -> Column:
    """Spans of the base kinds, by kind in their order, then by place."""
    hints = {"email": F.contains(text, F.lit("@")), "phone": F.contains(text, F.lit("+"))}
    none = F.array().cast(SPAN)
    found = [
        F.when(hints.get(k, text.rlike("[0-9]")), F.filter(matches(text, k, p), check(k))).otherwise(none) for k, p in BASE.items()
    ]
    return F.concat(*found)


def candidates(text: Column) -> Column:
    """Overlapping spans of all other generators."""
    none = F.array().cast(SPAN)
    return F.concat(*[F.when(text.rlike("[0-9]") | text.rlike(KEYWORD), matches(text, g, p)).otherwise(none) for g, (p, _) in MORE.items()])


def features(s: Column) -> dict[str, Column]:
    """Small integers from a candidate's shape and surroundings, in FEATURES' order."""
    value, size = s["value"], F.greatest(F.length(s["value"]), F.lit(1))
    part = lambda p: F.floor(4 * F.length(F.regexp_replace(value, p, "")) / size).cast("int")
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    code = reduce(lambda a, g: F.when(s["kind"] == g[1], g[0]).otherwise(a), enumerate(MORE), F.lit(-1))
    return {
        "generator": code,
        "length": F.least(F.floor(size / 4), F.lit(12)).cast("int"),
        "digits": part("[^0-9]"),
        "upper": part("[^A-Z]"),
        "lower": part("[^a-z]"),
        "hexadecimal": flag(value.rlike("^[0-9a-fA-F]+$")),
        "groups": F.least(F.length(F.regexp_replace(value, "[^ ().=:-]", "")), F.lit(4)),
        "keyword": flag(s["before"].rlike(KEYWORD + r"[^A-Za-z0-9]{0,6}$") | value.rlike(KEYWORD)),
        "mark_before": F.when(s["before"].rlike(r"[=:]\s*$"), 3).when(s["before"].rlike("[\"']$"), 2).when(s["before"].rlike(r"(^|\s)$"), 1).otherwise(0),
        "mark_after": F.when(s["after"].rlike("^[\"']"), 2).when(s["after"].rlike(r"^(\s|$)"), 1).otherwise(0),
    }


def seeded(s: Column, inside: Column) -> Column:
    """What a seed rule says of a candidate: a known key format, or a value given to a secret's name. Numbers: those inside a base span."""
    key = s["value"].rlike(r"^(?:AKIA|ASIA)[0-9A-Z]{16}$|^(?:ghp|gho|ghs|glpat|xox[abp]|sk|pk)[_-][A-Za-z0-9_-]{16,}$|^[0-9a-f]{40}$|^[0-9a-f]{64}$")
    named = s["before"].rlike(KEYWORD + "[^A-Za-z0-9]{1,6}$") & s["value"].rlike("[0-9]")
    given = s["value"].rlike("[:=].*[0-9]") & (F.length(s["value"]) >= 16)
    return F.when(s["kind"] == "key", key | named).when(s["kind"] == "assigned", given).otherwise(inside)


@dataclass
class Boosted:
    """Trees as (feature, bound, left, right) with numbers at the leaves, and a threshold by generator (none: nothing is added)."""

    base: float = 0.0
    trees: list = field(default_factory=list)
    thresholds: dict[int, float] = field(default_factory=dict)

    def margin(self, x: np.ndarray) -> np.ndarray:
        def value(t, rows: np.ndarray) -> np.ndarray:
            if not isinstance(t, tuple):
                return np.full(len(rows), t)
            left = rows[:, t[0]] <= t[1]
            return np.where(left, value(t[2], rows), value(t[3], rows))

        return self.base + sum((value(t, x) for t in self.trees), np.zeros(len(x)))

    def column(self, f: Column) -> Column:
        """Whether the candidate with the struct of features f is redacted."""

        def value(t) -> Column:
            return F.when(f[FEATURES[t[0]]] <= t[1], value(t[2])).otherwise(value(t[3])) if isinstance(t, tuple) else F.lit(float(t))

        score = reduce(lambda a, b: a + b, map(value, self.trees), F.lit(self.base))
        least = reduce(lambda a, g: F.when(f["generator"] == g, F.lit(self.thresholds[g])).otherwise(a), self.thresholds, F.lit(float("inf")))
        return score >= least


def boost(x: np.ndarray, good: np.ndarray, bad: np.ndarray, rounds: int = 25, depth: int = 3, rate: float = 0.4) -> Boosted:
    """Newton boosting of the logistic loss on weighted feature vectors."""
    total = good + bad
    out = Boosted(float(np.log((good.sum() + 0.5) / (bad.sum() + 0.5))))
    margin = np.full(len(x), out.base)

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, left: int):
        gain = lambda a, b: a * a / (b + 1.0)
        best = (1e-6, None)
        if left and len(rows) > 1:
            for k in range(x.shape[1]):
                for t in np.unique(x[rows, k])[:-1]:
                    m = x[rows, k] <= t
                    a, b = g[rows][m].sum(), h[rows][m].sum()
                    won = gain(a, b) + gain(g[rows].sum() - a, h[rows].sum() - b) - gain(g[rows].sum(), h[rows].sum())
                    if won > best[0]:
                        best = (won, (k, int(t), m))
        if best[1] is None:
            return float(rate * g[rows].sum() / (h[rows].sum() + 1.0))
        k, t, m = best[1]
        return (k, t, grow(rows[m], g, h, left - 1), grow(rows[~m], g, h, left - 1))

    for _ in range(rounds if len(x) else 0):
        p = 1 / (1 + np.exp(-margin))
        tree = grow(np.arange(len(x)), good - total * p, total * p * (1 - p), depth)
        if not isinstance(tree, tuple):
            break
        out.trees.append(tree)
        margin = out.margin(x)
    return out


def calibrate(model: Boosted, x: np.ndarray, good: np.ndarray, bad: np.ndarray, precision: float) -> None:
    """For each generator the lowest threshold with the asked precision on held-back counts, midway to the next score; without one it adds nothing."""
    score = model.margin(x) if len(x) else np.empty(0)
    for g in range(len(MORE)):
        rows = np.flatnonzero(x[:, 0] == g) if len(x) else []
        rows = sorted(rows, key=lambda r: -score[r])
        p = n = 0.0
        for i, r in enumerate(rows):
            p, n = p + good[r], n + bad[r]
            below = score[rows[i + 1]] if i + 1 < len(rows) else score[r] - 2
            if below < score[r] and p and p / (p + n) >= precision:
                model.thresholds[g] = float(score[r] + below) / 2


def annotate(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """row (the whole row), text (null as empty), base (spans) and more (candidates: span s, features f, inside and touches a base span)."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("base", base_spans(F.col("text"))).withColumn("found", candidates(F.col("text")))

    def one(s: Column, inside: Column, touches: Column) -> Column:
        f = F.struct(*[c.cast("int").alias(n) for n, c in features(s).items()])
        return F.struct(s.alias("s"), f.alias("f"), inside.alias("inside"), touches.alias("touches"))

    # let, not columns: a column that is used once is put into the lambda by the optimizer and worked out for each element
    ends = lambda before: reach(F.col("found"), before, F.col("base"))
    joined = lambda held, met: F.transform("found", lambda s, k: one(s, F.get(held, k) >= s["end"], F.get(met, k) > s["start"]))
    more = let(ends(lambda s: s["start"] + 1), lambda held: let(ends(lambda s: s["end"]), lambda met: joined(held, met)))
    base = F.transform("base", lambda b: F.struct(b["kind"], b["start"], b["end"]).cast("struct<kind:string,start:int,end:int>"))
    return rows.select("row", "text", base.alias("base"), more.alias("more"))


def learn(found: DataFrame, precision: float = 0.95) -> Boosted:
    """Boost on the counts of one half of the texts, calibrate on the other. What is collected has a row for each feature vector."""
    one = found.select(F.pmod(F.xxhash64("text"), F.lit(2)).alias("fold"), F.explode("more").alias("c"))
    cells = one.groupBy("fold", "c.f").agg(F.count_if(seeded(F.col("c.s"), F.col("c.inside"))).alias("good"), F.count(F.lit(1)).alias("n"))
    rows = sorted(cells.select("fold", "f.*", "good", "n").collect())
    table = np.array(rows, float).reshape(-1, len(FEATURES) + 3)
    fold, x, good, bad = table[:, 0], table[:, 1:-2].astype(int), table[:, -2], table[:, -1] - table[:, -2]
    model = boost(x[fold == 0], good[fold == 0], bad[fold == 0])
    calibrate(model, x[fold == 1], good[fold == 1], bad[fold == 1], precision)
    return model


def selected(model: Boosted) -> Column:
    """Base spans, then the chosen candidates, as (kind, start, end) by kind and place.

    A number that touches a base span adds nothing; a secret does unless it lies inside one (a key may hold the digits of a card).
    """
    adds = lambda c: F.when(c["s"]["kind"] == "number", ~c["touches"]).otherwise(~c["inside"])
    kept = F.filter("more", lambda c: adds(c) & model.column(c["f"]))
    as_kind = lambda c: reduce(lambda a, g: F.when(c["s"]["kind"] == g, MORE[g][1]).otherwise(a), MORE, F.lit(""))
    more = F.transform(kept, lambda c: F.struct(as_kind(c).alias("kind"), c["s"]["start"].alias("start"), c["s"]["end"].alias("end")))
    return F.concat("base", F.array_distinct(F.array_sort(more)))


def digest(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_secret, n_number, n_spans for every row.

    Null text counts as empty; repeated rows give repeated results; other columns of docs, whatever their names, don't matter; an
    empty table gives no rows.
    """
    found = stage(annotate(docs.select("doc_id", "text")).select(F.col("row.doc_id").alias("doc_id"), F.xxhash64("text").alias("text"), "base", "more"), "pii")
    found = found.withColumn("chosen", selected(learn(found)))
    count = lambda of, k: F.size(F.filter(of, lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    added = [count("chosen", k) for k in dict.fromkeys(kind for _, kind in MORE.values())]
    base = [count("base", k) for k in BASE]
    return found.select("doc_id", *base, F.sha2(digest(F.col("base")), 256).alias("base_sha256"), digest(F.col("chosen")).alias("spans"), *added, F.size("chosen").cast("long").alias("n_spans"))


#: Characters of a block of text that is entered by an offset.
PIECE = 1024


def without(text: Column, spans: Column) -> Column:
    """text with its spans (kind, start, end) replaced by their kinds in brackets; of overlapping spans what the first ones leave is replaced too."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))

    def piece(blocks: Column, first: Column, last: Column) -> Column:
        a, b = F.floor(first / PIECE).cast("int"), F.floor(last / PIECE).cast("int")
        head, tail = F.coalesce(F.get(blocks, a), F.lit("")), F.coalesce(F.get(blocks, b), F.lit(""))
        middle = F.array_join(F.slice(blocks, a + 2, F.greatest(b - a - 1, F.lit(0))), "")
        across = F.concat(F.substr(head, first % PIECE + 1, F.lit(PIECE)), middle, F.left(tail, last % PIECE))
        return F.when(a == b, F.substr(head, first % PIECE + 1, last - first)).otherwise(across)

    def put(blocks: Column, marks: Column, most: Column) -> Column:
        at = lambda k: F.when(k == 0, 0).otherwise(F.get(most, k - 1))
        parts = F.transform(marks, lambda s, k: F.when(s["end"] > at(k), F.concat(piece(blocks, at(k), F.greatest(at(k), s["start"])), F.lit("["), F.upper(s["kind"]), F.lit("]"))).otherwise(""))
        rest = piece(blocks, F.element_at(most, -1), F.length(text))
        return F.concat(F.array_join(parts, ""), rest)

    blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))
    marked = lambda b: let(ordered, lambda marks: let(running(F.transform(marks, lambda s: s["end"]), F.greatest), lambda most: put(b, marks, most)))
    return let(blocks, marked)


def redact(docs: DataFrame) -> DataFrame:
    """docs with each span of text replaced by its kind in brackets, and n_chars, if there, counted anew.

    Null and empty texts stay as they are, so do all other columns, whatever their names; repeated rows are redacted alike; an
    empty table gives none. Texts are annotated once: spans are staged with their rows.
    """
    found = stage(annotate(docs), "pii")
    found = found.withColumn("chosen", selected(learn(found)))
    hit = F.size("chosen") > 0
    row = F.col("row").withField("text", F.when(hit, without(F.col("text"), F.col("chosen"))).otherwise(F.col("row.text")))
    if "n_chars" in docs.columns:
        counted = F.length(row["text"]).cast(docs.schema["n_chars"].dataType)
        row = row.withField("n_chars", F.when(hit, counted).otherwise(F.col("row.n_chars")))
    return found.select(row.alias("row")).select("row.*")
