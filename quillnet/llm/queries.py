"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillnet.llm.conversations import repair_conversations
from quillnet.llm.decontaminate import decontaminate
from quillnet.llm.embeddings import embedding_links
from quillnet.llm.jaccard import jaccard_components
from quillnet.llm.language import held_out, identify_languages
from quillnet.llm.licenses import scan_licenses
from quillnet.llm.packing import pack_documents
from quillnet.llm.quality import score_quality
from quillnet.llm.substrings import remove_repeats
from quillnet.llm.tokens import encoded_lengths, length_histogram
from quillnet.llm.toxicity import score_toxicity, trains
from quillnet.llm.urls import filter_urls
from quillnet.llm.whitening import whiten
from quillnet.session import table


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that lie in a ten-word window of a benchmark item, and the items that occur."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate(docs, table(spark, sf_dir, "benchmark"), window=10, carry=["doc_id"])
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        "contaminated",
    )


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of every document and their places in sequences of 1,024 tokens."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pack_documents(docs, limit=1024, carry=["doc_id"])


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of documents of each encoded length, with suffix sums for every limit."""
    docs = table(spark, sf_dir, "documents").select("text")
    return length_histogram(encoded_lengths(docs, carry=[]))


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrases, licence labels and the best containment of a template in every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return scan_licenses(docs, carry=["doc_id"]).drop("blocks")


def op6_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set size and component of every document: sets of four-word shingles that are alike to 85 of 100."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return jaccard_components(docs, k=4, similarity=(85, 100))


def op10_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links at cosine 0.93 within a label, and the component of every vector."""
    return embedding_links(table(spark, sf_dir, "embeddings"), threshold=0.93).drop("embedding", "label")


def op8_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every page."""
    judged = filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"))
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from those that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = identify_languages(docs, docs.where(~held_out() & F.col("doc_id").isNotNull()), carry=["doc_id"])
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from the labels of those that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = score_toxicity(docs, docs.where(trains()), table(spark, sf_dir, "labels"), carry=["doc_id"])
    held = F.coalesce(~trains() & F.col("doc_id").isNotNull(), F.lit(False))
    return found.select("doc_id", held.alias("held_out"), "score", "predicted")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document by both views and their sum, learned from the labels of those that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang", "n_chars")
    found = score_quality(docs, docs.where(trains()), table(spark, sf_dir, "labels"), carry=["doc_id"])
    held = F.coalesce(~trains() & F.col("doc_id").isNotNull(), F.lit(False))
    return found.select("doc_id", held.alias("held_out"), "content_score", "metadata_score", "score", "predicted")


def op11_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without the windows of 35 words that occur twice."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return remove_repeats(docs, window=35, carry=["doc_id"]).drop("spans")


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first eight whitened components of every valid vector."""
    return whiten(table(spark, sf_dir, "embeddings"), n_components=8, carry=["vec_id"])


def op13_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Damage, faults, cheapest repair and its digest of every conversation."""
    return repair_conversations(table(spark, sf_dir, "conversations"))


QUERIES = {
    "op1_decontamination": op1_decontamination,
    "op2_language": op2_language,
    "op3_packing": op3_packing,
    "op4_licenses": op4_licenses,
    "op5_token_counts": op5_token_counts,
    "op6_jaccard": op6_jaccard,
    "op7_quality": op7_quality,
    "op8_urls": op8_urls,
    "op9_toxicity": op9_toxicity,
    "op10_embeddings": op10_embeddings,
    "op11_substrings": op11_substrings,
    "op12_whitening": op12_whitening,
    "op13_conversations": op13_conversations,
}
