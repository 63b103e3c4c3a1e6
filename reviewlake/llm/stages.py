"""The stages of the corpus pipeline.

Each works on any documents table: null ids and texts, empty and very long texts, repeated ids and rows, no rows at all, and columns
of any names, all of which are returned as they are but for what the stage decides. Verdicts are carried by id and text together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlake.llm.common import if_few, table, without_rows
from reviewlake.llm.decontam import contamination
from reviewlake.llm.ngram_join import similar_documents
from reviewlake.llm.packing import pack_documents
from reviewlake.llm.pii import redact
from reviewlake.llm.qda import quality_verdicts
from reviewlake.llm.queries import tokenizer_path

#: Near duplicates of the pipeline: Jaccard similarity in hundredths, and the words of a shingle.
SIMILAR, WORDS = 80, 5


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go, rows with null ids too; of rows that share an id each is judged by its own text."""
    return without_rows(docs, quality_verdicts(docs, table(spark, sf_dir, "labels")).where(F.col("predicted") == 0))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates stays: that of the least id, a null id last; of rows that share an id any one.

    Rows are told apart by a 64-bit hash of id and text; rows equal in both are one. Texts without words are no one's
    duplicates, but repeated rows of such a text with one id are one, too.
    """
    row = F.xxhash64("doc_id", F.coalesce("text", F.lit(""))).alias("row")
    found = similar_documents(docs.select(row, "text"), "row", least=SIMILAR, words=WORDS)
    both = found.select("row", F.col("component_id").alias("group")).join(docs.select(row, F.col("doc_id").alias("id")), "row").distinct()
    first = both.groupBy("group").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row"))["row"].alias("row"))
    gone = if_few(both.join(first, "row", "left_anti").select(F.col("row").alias("_row")), "gone")
    kept = docs.join(gone, row == gone["_row"], "left_anti")
    again = if_few(found.groupBy("row").count().where("count > 1").select(F.col("row").alias("_row")), "again")
    if again.isEmpty():
        return kept
    names = [f"c{k}" for k in range(len(docs.columns))]  # so that a column of docs may have any name
    copies = kept.join(again, row == again["_row"], "left_semi").select(row, *[F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, names, strict=True)])
    return kept.join(again, row == again["_row"], "left_anti").union(copies.dropDuplicates(["row"]).select(names).toDF(*docs.columns))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark items beyond the limit go; of rows that share an id each is judged by its own text."""
    return without_rows(docs, contamination(docs, table(spark, sf_dir, "benchmark")).where("contaminated"))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data and secrets are replaced by their kinds; no document goes."""
    return redact(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All kept documents as pieces of sequences."""
    return pack_documents(docs, tokenizer_path())


STAGES = [
    ("quality classifier", quality), ("n-gram Jaccard join", near_duplicates), ("benchmark decontamination", decontamination), ("PII", pii), ("packing", packing),
]
