"""Regularised quadratic discriminant over transformed text statistics.

Per class: mean and covariance from sums that Spark adds up over all labelled training rows, the covariance
shrunk towards the pooled one and then towards a multiple of the identity. A score is the logistic of the
difference of the two log densities; the inverse Cholesky factors are made once and reused for all rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewlake.llm import doc_stats
from reviewlake.llm.common import crc_bucket, small_batches, stage

THRESHOLD = 0.3


def transformed() -> dict[str, Column]:
    """Statistics on scales where a class is closer to a normal cloud."""
    f = doc_stats.features()
    shares = ("dup_line_share", "repeat_share", "upper_share", "digit_share", "mark_share", "distinct_share", "top_share", "short_line_share", "run_share")
    rates = ("symbols_a_word", "bangs_a_word", "stops_a_word")
    return (
        {"words": F.log1p(f["words"]), "word_length": F.log1p(f["word_length"]), "words_a_line": F.log1p(f["words_a_line"])}
        | {k: F.asin(F.sqrt(F.least(F.lit(1.0), F.greatest(F.lit(0.0), f[k])))) for k in shares}
        | {k: F.log1p(f[k] * 4) for k in rates}
    )


@dataclass(frozen=True)
class Discriminant:
    means: np.ndarray  # class x feature
    roots: np.ndarray  # class x feature x feature: inverses of the Cholesky factors
    offsets: np.ndarray  # class: log prior minus the log of the factor's determinant
    heat: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """The chance of class 1."""
        log = [self.offsets[k] - 0.5 * (((x - self.means[k]) @ self.roots[k].T) ** 2).sum(1) for k in (0, 1)]
        return 1 / (1 + np.exp(-np.clip((log[1] - log[0]) / self.heat, -500, 500)))


def fit(count: np.ndarray, total: np.ndarray, squares: np.ndarray, shrink: float = 0.2, ridge: float = 0.02, heat: float = 3.0) -> Discriminant:
    """From each class's count, sums and sums of products. A class without rows takes the pooled mean and covariance."""
    p = total.shape[1]
    n = np.maximum(count, 1)[:, None]
    means = total / n
    own = squares / n[:, :, None] - means[:, :, None] * means[:, None, :]
    all_n = max(count.sum(), 1)
    pooled = (own * count[:, None, None]).sum(0) / all_n
    means = np.where(count[:, None] > 0, means, total.sum(0) / all_n)
    scale = max(np.trace(pooled) / p, 1e-6)
    roots, offsets = [], []
    for k in (0, 1):
        a = shrink + (1 - shrink) * p / (p + count[k])  # few rows: more of the pooled one
        s = (1 - a) * own[k] + a * pooled
        s = (1 - ridge) * s + ridge * scale * np.eye(p)
        low = np.linalg.cholesky(s)
        roots.append(np.linalg.inv(low))
        offsets.append(np.log((count[k] + 1) / (all_n + 2)) - np.log(np.diag(low)).sum())
    return Discriminant(means, np.array(roots), np.array(offsets), heat)


def class_sums(rows: DataFrame, label_col: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Count, sums and sums of products by class, each added up by Spark: two rows reach the driver."""
    names = list(transformed())
    p = len(names)
    sums = [F.sum(c).alias(f"s{i}") for i, c in enumerate(names)]
    products = [F.sum(F.col(names[i]) * F.col(names[j])).alias(f"p{i}_{j}") for i in range(p) for j in range(i + 1)]
    count, total, squares = np.zeros(2), np.zeros((2, p)), np.zeros((2, p, p))
    for r in rows.groupBy(label_col).agg(F.count(F.lit(1)).alias("n"), *sums, *products).collect():
        k = int(r[label_col])
        count[k], total[k] = r["n"], [r[f"s{i}"] for i in range(p)]
        for i in range(p):
            for j in range(i + 1):
                squares[k, i, j] = squares[k, j, i] = r[f"p{i}_{j}"]
    return count, total, squares


def learn(stats: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality") -> Discriminant:
    """Fit on all labelled rows given. Null labels go; of repeated labels the largest counts."""
    one = labels.where(F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("_id")).agg(F.max(F.col(label_col)).alias("_label"))
    rows = stats.join(one, stats[id_col] == one["_id"]).select("_label", *[c.alias(n) for n, c in transformed().items()])
    return fit(*class_sums(rows, "_label"))


def score_rows(stats: DataFrame, model: Discriminant, id_col: str = "doc_id") -> DataFrame:
    """id_col, text_key and score."""
    kind = dict(stats.dtypes)[id_col]
    names = list(transformed())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.stack([b.column(c).to_numpy(zero_copy_only=False) for c in names], 1)
            yield pa.RecordBatch.from_arrays([b.column(id_col), b.column("text_key"), pa.array(model.score(x))], [id_col, "text_key", "score"])

    return stats.select(id_col, "text_key", *[c.alias(n) for n, c in transformed().items()]).mapInArrow(run, f"{id_col} {kind}, text_key long, score double")


def quality_verdicts(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, text_key, held_out, score, predicted for every row of docs.

    Labels of held-out ids (crc32 of the id, modulo 5, is 0) are never read. Null and empty texts get the
    score of zero counts; rows with a null id are scored like others; repeated rows get equal scores, and columns of docs other than
    doc_id and text don't matter, whatever their names; without labels all scores are one half; an empty table gives no rows.
    """
    with small_batches(docs.sparkSession):
        stats = stage(doc_stats.with_stats(docs), "quality-stats")
    model = learn(stats, labels.where(crc_bucket("doc_id", 5) != 0))
    held = (crc_bucket("doc_id", 5) == 0).alias("held_out")
    return score_rows(stats, model).select("doc_id", "text_key", held, "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted: the digest of quality_verdicts."""
    return quality_verdicts(docs, labels, threshold).drop("text_key")
