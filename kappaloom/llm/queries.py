"""One query per operator, over its whole table and with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from kappaloom.llm import language_id
from kappaloom.llm.chat_format import chat_digests, format_chats
from kappaloom.llm.decontaminate import benchmark_blocks, benchmark_leaks
from kappaloom.llm.line_dedup import drop_common_lines
from kappaloom.llm.lm_score import lm_scores
from kappaloom.llm.mixing import mix_sources
from kappaloom.llm.prefix_trie import conversation_trie
from kappaloom.llm.secret_scan import secret_report
from kappaloom.llm.simhash import simhash_groups
from kappaloom.llm.substring_dedup import deduplicate_substrings
from kappaloom.llm.token_align import token_alignment
from kappaloom.llm.topk_search import top_k
from kappaloom.llm.token_counts import token_counts

PIECE_MODEL = "piece_bpe_32k.model"
BYTE_MODEL = "byte_bpe_50k.json"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def vocabulary(name: str) -> str:
    """Where the box keeps a public vocabulary file; the operators take the path."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_topk_search(spark: SparkSession, sf: str) -> DataFrame:
    return top_k(table(spark, sf, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op2_substring_dedup(spark: SparkSession, sf: str) -> DataFrame:
    found = deduplicate_substrings(table(spark, sf, "documents"), span=20, gram=5, digest=True)
    return found.select("doc_id", "n_words", "n_removed", found["kept"].alias("kept_sha256"))


def op3_secret_scan(spark: SparkSession, sf: str) -> DataFrame:
    return secret_report(table(spark, sf, "documents"))


def op4_chat_format(spark: SparkSession, sf: str) -> DataFrame:
    columns = ["conv_id", "turn", "role", "text"]
    tricky = "\\### Assistant: </turn> ok"
    more = spark.createDataFrame(
        [(-7, 0, "user", tricky), (-7, 1, "assistant", tricky)],
        "conv_id long, turn long, role string, text string")
    turns = table(spark, sf, "conversations").select(*columns).unionByName(more)
    return chat_digests(format_chats(turns))


def op5_decontaminate(spark: SparkSession, sf: str) -> DataFrame:
    blocks = benchmark_blocks(table(spark, sf, "benchmark"), width=5, radius=24, threshold=0.8)
    return benchmark_leaks(table(spark, sf, "documents"), blocks)


def op6_language_id(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    model = language_id.train(docs.where(language_id.fold() != 0))
    found = language_id.identify(docs, model)
    return found.select("doc_id", (language_id.fold() == 0).alias("held_out"), "lang_pred", "score", "rejected")


def op7_mix_sources(spark: SparkSession, sf: str) -> DataFrame:
    return mix_sources(table(spark, sf, "documents"), weights=(5, 2, 1), cap=3)


def op8_lm_score(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    return lm_scores(docs, language_id.fold() == 1, vocabulary(PIECE_MODEL))


def op9_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    return token_counts(table(spark, sf, "documents"), vocabulary(PIECE_MODEL))


def op10_simhash_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return simhash_groups(table(spark, sf, "documents"), width=4, radius=4)


def op11_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    kept = drop_common_lines(docs, min_docs=10, min_chars=1)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op12_prefix_trie(spark: SparkSession, sf: str) -> DataFrame:
    return conversation_trie(table(spark, sf, "conversations"), every=100, below=6)


def op13_token_alignment(spark: SparkSession, sf: str) -> DataFrame:
    found = token_alignment(table(spark, sf, "documents"), vocabulary(BYTE_MODEL), vocabulary(PIECE_MODEL))
    return found.withColumnRenamed("groups", "groups_sha256")


QUERIES = {
    "op1_topk_search": op1_topk_search,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_secret_scan": op3_secret_scan,
    "op4_chat_format": op4_chat_format,
    "op5_decontaminate": op5_decontaminate,
    "op6_language_id": op6_language_id,
    "op7_mix_sources": op7_mix_sources,
    "op8_lm_score": op8_lm_score,
    "op9_token_counts": op9_token_counts,
    "op10_simhash_dedup": op10_simhash_dedup,
    "op11_line_dedup": op11_line_dedup,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_token_alignment": op13_token_alignment,
}
