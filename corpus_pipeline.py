"""From raw documents to packed training sequences, in five stages.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame. All but the last return the
columns of documents. Between stages the table is written and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillnet.llm.common import fresh, join_bounded
from quillnet.llm.decontaminate import decontaminate
from quillnet.llm.jaccard import jaccard_components
from quillnet.llm.language import UNDETERMINED, identify_languages
from quillnet.llm.packing import pack_documents
from quillnet.llm.toxicity import score_toxicity
from quillnet.session import cut, table

#: A text nearer to no profile than this share of the largest distance is taken for no language.
MIN_LANGUAGE_SCORE = 0.2


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the corpus teaches; null texts, texts without a letter and texts like no profile go.

    Where no row of docs bears a language there is nothing to tell apart, and every text with a letter stays.
    """
    pred, score = fresh(docs, "_lang_pred"), fresh(docs, "_lang_score")
    found = identify_languages(docs.withColumnsRenamed({"lang_pred": pred, "score": score}), docs)
    taught = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull()).limit(1).count()
    if not taught:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    kept = found.where((F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= MIN_LANGUAGE_SCORE))
    return kept.drop("lang_pred", "score").withColumnsRenamed({pred: "lang_pred", score: "score"})


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, learned from labels, does not call toxic."""
    was, score = fresh(docs, "_predicted"), fresh(docs, "_score")
    renamed = docs.withColumnsRenamed({"predicted": was, "score": score})
    found = score_toxicity(renamed, docs, table(spark, sf_dir, "labels"))
    return found.where("predicted = 0").drop("predicted", "score").withColumnsRenamed({was: "predicted", score: "score"})


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: the smallest doc_id of those linked by 5-word shingles at a similarity of 0.8.

    Documents without an id or without words are in no group and stay. Rows that repeat an id are one document; that of the
    smallest hash stays.
    """
    groups = cut(jaccard_components(docs, k=5, similarity=(80, 100)).select("doc_id", "component_id"))
    gone = groups.where(F.col("component_id") != F.col("doc_id")).select("doc_id").distinct()
    kept = join_bounded(docs, gone, "doc_id", "left_anti", 1_000_000)
    twice = cut(groups.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"))
    if twice.limit(1).count():
        # Of rows that repeat an id, always the same one stays: a task that runs again must not keep another.
        once = join_bounded(kept, twice, "doc_id", "left_semi")
        once = once.groupBy("doc_id").agg(F.min_by(F.struct(*docs.columns), F.xxhash64(*docs.columns)).alias("row")).select("row.*")
        kept = join_bounded(kept, twice, "doc_id", "left_anti").unionByName(once)
    return kept.select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no ten-word window of a benchmark item occurs."""
    hit, own = fresh(docs, "_hit"), "contaminated"
    renamed = docs.withColumnsRenamed({own: hit})
    names = ("n_words", "n_hit", "items", "spans")
    aside = {n: fresh(docs, f"_{n}") for n in names}
    found = decontaminate(renamed.withColumnsRenamed(aside), table(spark, sf_dir, "benchmark"))
    return found.where(~F.col(own)).drop(own, *names).withColumnsRenamed({hit: own, **{v: k for k, v in aside.items()}})


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, with their places in sequences of at most 1024 tokens."""
    return pack_documents(docs.select("doc_id", "text"), limit=1024, carry=["doc_id"])


STAGES = [
    ("language", language),
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: SQL cannot express the language, toxicity and packing stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = cut(docs)
    return docs
