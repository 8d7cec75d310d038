"""The queries of this subpackage: each operator on its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from silvermart.llm import (
    conversation_repair,
    language_rnn,
    merkle_manifest,
    oracle,
    order_minhash,
    quality_mil,
    quality_rules,
    toxicity,
    tree_dedup,
    word_bpe,
)
from silvermart.llm.common import conversations, documents, held_out, labels, pages
from silvermart.llm.html_text import extract
from silvermart.llm.jaccard_join import link_documents
from silvermart.llm.mixing import by_length, mix
from silvermart.llm.substring_dedup import remove_repeats


def op1_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text."""
    return order_minhash.compare_edits(documents(spark, sf_dir))


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return extract(pages(spark, sf_dir)).select("page_id", "url", "text", "n_chars")


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document."""
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    model = language_rnn.train(docs)
    return language_rnn.identify(docs.select("doc_id", "text"), model).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score"
    )


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chance of every document to be of good quality."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    model = quality_mil.train(docs, labels(spark, sf_dir))
    return _scored(quality_mil.score(docs, model), "quality", 0.3)


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What repeated word sequences leave of every document."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return remove_repeats(docs).select(
        "doc_id",
        "n_words",
        "n_removed",
        F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"),
    )


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op6_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document and the text they stand for, as digests."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    coded = word_bpe.round_trip(docs, tokenizer_path())
    written = F.array_join(F.col("ids").cast("array<string>"), " ")
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(written.cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words each document gives to the mix; fragments are drawn less often than long texts."""
    mixed = mix(documents(spark, sf_dir), "doc_id", "text", "source", lean=by_length)
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def _scored(docs: DataFrame, column: str, threshold: float) -> DataFrame:
    return docs.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        F.col(column).alias("score"),
        (F.col(column) >= threshold).cast("int").alias("predicted"),
    )


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate component of every document."""
    return link_documents(documents(spark, sf_dir))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chance of every document to be toxic."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    model = toxicity.train(docs, labels(spark, sf_dir))
    return _scored(toxicity.score(docs, model), "toxicity", 0.5)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts, distances to the languages and the verdict on every document."""
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    return quality_rules.judge(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", "class_distance", "word_distance",
    )


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The Merkle proof of every document, and the root of its version where it was tampered with."""
    manifest = merkle_manifest.build(
        documents(spark, sf_dir),
        tampered=merkle_manifest.tampered_ids(F.col("doc_id")),
        changes={"n_chars": merkle_manifest.one_more(F.col("n_chars"))},
    )
    return manifest.proofs().select(
        F.col("id").alias("doc_id"), "leaf", "subroot", "root", "proof_sha256", "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cheapest repair of every conversation after planted damage."""
    original = conversations(spark, sf_dir)
    return conversation_repair.repair_all(original, conversation_repair.damage(original))


def op13_tree_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which document of each group of equal texts stays."""
    return tree_dedup.exact_groups(documents(spark, sf_dir).select("doc_id", "text"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_order_minhash": op1_order_minhash,
    "op2_html_text": op2_html_text,
    "op3_language": op3_language,
    "op4_quality": op4_quality,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_word_bpe": op6_word_bpe,
    "op7_mixing": op7_mixing,
    "op8_jaccard_join": op8_jaccard_join,
    "op9_toxicity": op9_toxicity,
    "op10_quality_rules": op10_quality_rules,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_tree_dedup": op13_tree_dedup,
}

# The other operators are beyond SQL: learned scores, hash draws, page trees, token ids.
ORACLE_SQL: dict[str, str] = {
    "op5_substring_dedup": oracle.SUBSTRING_DEDUP,
    "op8_jaccard_join": oracle.JACCARD_JOIN,
    "op11_merkle_manifest": oracle.MERKLE_MANIFEST,
    "op12_conversation_repair": oracle.CONVERSATION_REPAIR,
    "op13_tree_dedup": oracle.TREE_DEDUP,
}
