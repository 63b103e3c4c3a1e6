"""A learned decision list over text statistics (sequential covering, grow then prune).

fit() takes labelled rows in the driver: at most `bound` rows, taken in hash order, which is the one
bounded sample here. Each rule is a conjunction of thresholds; the list becomes one nested CASE WHEN.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewlake.llm import doc_stats
from reviewlake.llm.common import small_batches, stage

#: Labelled rows that the list is fitted on, at most.
BOUND = 20_000
COUNTS = doc_stats.COUNTS


@dataclass(frozen=True)
class Rule:
    """Conditions (feature, '<=' or '>=', threshold) that must all hold, and the class they give."""

    conditions: tuple[tuple[str, str, float], ...]
    label: int
    precision: float

    def column(self, columns: dict[str, Column]) -> Column:
        tests = [columns[f] <= F.lit(t) if op == "<=" else columns[f] >= F.lit(t) for f, op, t in self.conditions]
        return reduce(lambda a, b: a & b, tests)

    def covers(self, x: np.ndarray, names: list[str]) -> np.ndarray:
        out = np.ones(len(x), bool)
        for f, op, t in self.conditions:
            v = x[:, names.index(f)]
            out &= v <= t if op == "<=" else v >= t
        return out

    def __str__(self) -> str:
        return " and ".join(f"{f} {op} {t:.6g}" for f, op, t in self.conditions) + f" -> {self.label}"


@dataclass
class DecisionList:
    rules: list[Rule] = field(default_factory=list)
    default: int = 1

    def column(self, columns: dict[str, Column]) -> Column:
        """The class by the first rule that holds, as one conditional expression."""
        out: Column = F.lit(self.default)
        for rule in reversed(self.rules):
            out = F.when(rule.column(columns), F.lit(rule.label)).otherwise(out)
        return out


def _grow(x: np.ndarray, bad: np.ndarray, names: list[str], most: int) -> list[tuple[str, str, float]]:
    """Add the condition of the largest information gain until only bad rows are covered."""
    conditions: list[tuple[str, str, float]] = []
    inside = np.ones(len(x), bool)
    while len(conditions) < most and not bad[inside].all():
        p0, n0 = bad[inside].sum(), (~bad[inside]).sum()
        best = (0.0, None, None)
        for k, name in enumerate(names):
            v, y = x[inside, k], bad[inside]
            for t in np.unique(np.quantile(v, np.linspace(0, 1, 65))):
                for op in ("<=", ">="):
                    got = v <= t if op == "<=" else v >= t
                    p, n = (got & y).sum(), (got & ~y).sum()
                    if p < 3 or got.all():
                        continue
                    gain = p * (np.log2(p / (p + n)) - np.log2(p0 / (p0 + n0)))
                    if gain > best[0] + 1e-9:
                        best = (gain, (name, op, float(t)), got)
        if best[1] is None:
            break
        conditions.append(best[1])
        inside[np.flatnonzero(inside)[~best[2]]] = False
    return conditions


def _prune(conditions: list, x: np.ndarray, bad: np.ndarray, names: list[str]) -> tuple[Rule | None, int]:
    """Cut the tail of conditions where held-back rows speak for it: the best (p - n) / (p + n)."""
    best: tuple[float, Rule | None, int] = (-1.0, None, 0)
    for k in range(len(conditions), 0, -1):
        rule = Rule(tuple(conditions[:k]), 0, 0.0)
        got = rule.covers(x, names)
        p, n = int((got & bad).sum()), int((got & ~bad).sum())
        worth = (p - n) / (p + n) if p + n else -1.0
        if worth > best[0]:
            best = (worth, Rule(rule.conditions, 0, p / max(1, p + n)), p)
    return best[1], best[2]


def fit_list(x: np.ndarray, good: np.ndarray, names: list[str], least_precision: float = 0.9, most_rules: int = 12, most_conditions: int = 4) -> DecisionList:
    """Learn rules that reject; what none of them covers is kept. No rows, or one class: keep all."""
    bad = ~good.astype(bool)
    back = np.arange(len(x)) % 3 == 0  # rows come in hash order
    out, left = DecisionList(), np.ones(len(x), bool)
    while len(out.rules) < most_rules and bad[left & ~back].sum() >= 3:
        conditions = _grow(x[left & ~back], bad[left & ~back], names, most_conditions)
        if not conditions:
            break
        rule, found = _prune(conditions, x[left & back], bad[left & back], names)
        if rule is None or found < 2 or rule.precision < least_precision:
            break
        out.rules.append(rule)
        left &= ~rule.covers(x, names)
    return out


def labelled_sample(stats: DataFrame, labels: DataFrame, id_col: str, label_col: str, bound: int) -> DataFrame:
    """Features and label of at most `bound` labelled rows, in hash order. Null labels go; of repeated labels the largest counts."""
    one = labels.where(F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max(F.col(label_col)).alias("_label"))
    cols = [c.alias(n) for n, c in doc_stats.features().items()]
    return stats.join(one, stats[id_col] == one["_id"]).select(F.xxhash64("_id").alias("_order"), "_label", *cols).orderBy("_order", *doc_stats.features()).limit(bound)


def learn(stats: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", bound: int = BOUND) -> DecisionList:
    """Fit on the labelled rows that base_failed() lets through: those the list has to decide."""
    rows = labelled_sample(stats.where(~doc_stats.base_failed()), labels, id_col, label_col, bound).toArrow().to_pandas().sort_values("_order", kind="stable")
    names = list(doc_stats.features())
    return fit_list(rows[names].to_numpy(float).reshape(-1, len(names)), rows["_label"].to_numpy() == 1, names)


def apply_rules(docs: DataFrame, labels: DataFrame, bound: int = BOUND) -> DataFrame:
    """doc_id, the base counts, base_failed and kept for every row; null or empty text fails the base; an empty table gives none."""
    with small_batches(docs.sparkSession):
        stats = stage(doc_stats.with_stats(docs), "text-stats")
    verdict = learn(stats, labels, bound=bound).column(doc_stats.features())
    failed = doc_stats.base_failed()
    return stats.select("doc_id", *COUNTS, failed.alias("base_failed"), ((verdict == 1) & ~failed).alias("kept"))
