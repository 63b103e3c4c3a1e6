"""The registered queries of the training-data operators: (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from reviewlake.llm.common import table


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from reviewlake.llm.token_scan import document_tokens

    return document_tokens(table(spark, sf_dir, "documents"), tokenizer_path())


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from reviewlake.llm.decision_list import apply_rules

    return apply_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from reviewlake.llm.host_paths import main_text

    return main_text(table(spark, sf_dir, "pages"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from reviewlake.llm.pii import personal_data

    return personal_data(table(spark, sf_dir, "documents"))


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from reviewlake.llm.ngram_join import similar_documents

    return similar_documents(table(spark, sf_dir, "documents"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from reviewlake.llm.decontam import decontaminate

    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_hilbert_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from reviewlake.llm.hilbert import shard_documents

    return shard_documents(table(spark, sf_dir, "documents"))


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from reviewlake.llm.ppm import language_scores

    return language_scores(table(spark, sf_dir, "documents"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from reviewlake.llm.qda import quality_scores

    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from reviewlake.llm.packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from reviewlake.llm.conversation_repair import repair_damaged

    return repair_damaged(table(spark, sf_dir, "conversations"))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from reviewlake.llm.k2_search import ranked

    return ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    from reviewlake.llm.bpe_transducer import encoded_digests

    return encoded_digests(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_token_counts": op1_token_counts,
        "op2_quality_rules": op2_quality_rules,
        "op3_html_extraction": op3_html_extraction,
        "op4_pii": op4_pii,
        "op5_ngram_jaccard": op5_ngram_jaccard,
        "op6_decontamination": op6_decontamination,
        "op7_hilbert_sharding": op7_hilbert_sharding,
        "op8_lm_scoring": op8_lm_scoring,
        "op9_quality_classifier": op9_quality_classifier,
        "op10_packing": op10_packing,
        "op11_conversation_repair": op11_conversation_repair,
        "op12_ranked_search": op12_ranked_search,
        "op13_byte_bpe": op13_byte_bpe,
    }


def oracle_sql() -> dict[str, str]:
    from reviewlake.llm.oracles import SQL

    return dict(SQL)
