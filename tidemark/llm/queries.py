"""The registered queries of the operators, and the SQL that says the same where SQL can."""

from __future__ import annotations

from pathlib import Path

from public_tokenizers import path as tokenizer_path
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import chats, classifier, decontaminate, extract, lines, mixing, quality, repeats, sketch, tokens
from tidemark.llm.common import table
from tidemark.llm.oracles import ORACLES  # noqa: F401

#: The vocabulary of the token counts; a caller with another one sets this.
VOCABULARY = "piece_bpe_32k.model"


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = quality.judge(docs, keep_text=False)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return lines.dedup_lines(docs).select("doc_id", "n_lines", "n_removed", "text")


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return classifier.score(docs, table(spark, sf_dir, "labels"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = Path(tokenizer_path(VOCABULARY)).read_bytes()
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return tokens.count_tokens(docs, model).drop("text")


def op6_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketch.find_groups(table(spark, sf_dir, "documents").select("doc_id", "text"), words=2)


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return repeats.remove_repeats(docs, keep=False)


def op8_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.find_contamination(docs, table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chats.render(table(spark, sf_dir, "conversations"))


QUERIES = {f.__name__: f for f in (op1_mix_sources, op2_quality_rules, op3_line_dedup, op4_quality_classifier, op5_token_counts, op6_minhash_dedup, op7_suffix_dedup, op8_html_extract, op9_decontaminate, op10_chat_format)}
