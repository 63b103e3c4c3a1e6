"""Artifact hashes, report order and upserts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlake.functions.columns import severity_rank
from reviewlake.operators.joins import first_by, first_n


def artifact_index(files: DataFrame, content: str = "content", keep: tuple[str, ...] = ("label", "kind", "path")) -> DataFrame:
    """keep, bytes, sha256 of every artifact; content is binary."""
    return files.select(*keep, F.length(content).cast("long").alias("bytes"), F.sha2(content, 256).alias("sha256"))


def read_artifacts(spark: SparkSession, path: str, kind: str = "artifact") -> DataFrame:
    """Files under a folder as artifacts, by their paths in it."""
    name = F.element_at(F.split("path", "/"), -1)
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(name.alias("label"), F.lit(kind).alias("kind"), "path", "content")


def attest(index: DataFrame, current: DataFrame, keys: tuple[str, ...] = ("path",)) -> DataFrame:
    """index with passed and failures: missing, byte size changed, hash changed."""
    now = current.select(*keys, F.col("bytes").alias("_bytes"), F.col("sha256").alias("_sha"), F.lit(True).alias("_there"))
    j = index.join(now, list(keys), "left")
    name = F.concat("label", F.lit(" "), "kind")
    path = F.col("path")
    failures = F.array_compact(F.array(
        F.when(F.col("_there").isNull(), F.concat(name, F.lit(" missing: "), path)),
        F.when(F.col("_bytes") != F.col("bytes"), F.concat(name, F.lit(" byte size changed from "), F.col("bytes").cast("string"), F.lit(" to "), F.col("_bytes").cast("string"), F.lit(": "), path)),
        F.when(F.col("_sha") != F.col("sha256"), F.concat(name, F.lit(" SHA-256 changed from "), "sha256", F.lit(" to "), "_sha", F.lit(": "), path)),
    ))
    return j.withColumn("failures", failures).withColumn("passed", F.size("failures") == 0).drop("_bytes", "_sha", "_there")


def top_findings(findings: DataFrame, key: str = "review_id", n: int = 5) -> DataFrame:
    """The first n findings of a review, with total and shown."""
    totals = findings.groupBy(F.col(key).alias("_key")).agg(F.count(F.lit(1)).alias("total"))  # a count over the window would stop its limit
    out = first_n(findings, [key], ["seq"], n)
    return out.join(totals, F.col(key).eqNullSafe(F.col("_key"))).drop("_key").withColumn("shown", F.least(F.lit(n), F.col("total")))


def order_findings(findings: DataFrame) -> DataFrame:
    """By severity, falling confidence, path and start."""
    return findings.orderBy(severity_rank("severity"), F.desc("confidence"), "file_path", "start_line")


def plan_upserts(bodies: DataFrame, existing: DataFrame, marker: str, key: str = "review_id") -> DataFrame:
    """key, action, target_id: update the first existing row whose body has the marker, else create. existing: key, seq, target_id, body."""
    mine = first_by(existing.where(F.contains("body", F.lit(marker))), [key], ["seq"]).select(key, "target_id")
    return bodies.select(key).join(mine, key, "left").select(key, F.when(F.col("target_id").isNotNull(), "update").otherwise("create").alias("action"), "target_id")
