"""Language identification by rank-order profiles.

A profile is a language's most frequent letter n-grams (n = 1 to 3, words padded with a boundary), by rank. A document's
most frequent n-grams are compared with each profile by the out-of-place distance: how far each n-gram's rank is from
its rank in the profile, or the profile's size where it is absent.

Profiles are learned from at most ``max_train_docs`` documents of each language, those of the smallest hash, over their whole
texts. Every document is predicted from its whole text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from quillnet.llm.common import BlobReader, bucket, fresh, join_bounded, map_batches, with_fields

MAX_TRAIN_DOCS = 2000
UNDETERMINED = "und"
_LETTER: list[np.ndarray] = []
_TWO = np.uint64(0x1FFFFF << 42)
_ONE = np.uint64(0x1FFFFE << 42)


def _letters() -> np.ndarray:
    if not _LETTER:
        _LETTER.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _LETTER[0]


def gram_codes(text: str | None) -> np.ndarray:
    """Codes of all n-grams of a text, in order and repeated; none of a text without letters."""
    if not text:
        return np.empty(0, np.uint64)
    c = np.frombuffer(text.lower().encode("utf-32-le"), np.uint32)
    c = np.where(_letters()[c], c, 0).astype(np.uint64)
    c = np.concatenate([np.zeros(1, np.uint64), c, np.zeros(1, np.uint64)])
    c = c[np.concatenate([[True], (c[1:] != 0) | (c[:-1] != 0)])]
    if len(c) < 3:
        return np.empty(0, np.uint64)
    a, b = c[:-1], c[1:]
    s = np.uint64(21)
    two = _TWO | (a << s) | b
    three = ((a[:-1] << s | b[:-1]) << s) | b[1:]
    return np.concatenate([_ONE | c[c != 0], two, three[b[:-1] != 0]])


def ranked(codes: np.ndarray, k: int) -> np.ndarray:
    """The k most frequent codes, most frequent first; ties by code."""
    grams, n = np.unique(codes, return_counts=True)
    return grams[np.argsort(-n, kind="stable")[:k]]


def learn_profiles(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    size: int = 400,
    max_train_docs: int = MAX_TRAIN_DOCS,
) -> DataFrame:
    """(lang, rank, gram) for each language among the rows; null languages, ids and texts teach nothing."""
    keyed = docs.where(F.col(lang_col).isNotNull() & F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(id_col).alias("id"), F.col(lang_col).alias("lang")
    )
    # A cut of the hash leaves some times max_train_docs of each language; only these are ranked.
    share = F.least(F.lit(1.0), 4.0 * max_train_docs / F.col("n"))
    sizes = keyed.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    draw = F.xxhash64("id").bitwiseAND(0x7FFFFFFF) / F.lit(float(1 << 31))
    keyed = join_bounded(keyed, sizes, "lang", "inner", 100_000).where(draw < share)
    order = W.partitionBy("lang").orderBy(draw, "id")
    chosen = keyed.withColumn("k", F.row_number().over(order)).where(F.col("k") <= max_train_docs).select("id").distinct()
    rows = docs.where(F.col(lang_col).isNotNull()).select(
        F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text")
    )
    sample = join_bounded(rows, chosen, "id", "left_semi")

    def count(batches):
        for batch in batches:
            b = BlobReader(batch)
            by: dict[str, list] = {}
            for lang, text in zip(b.list("lang"), b.list("text"), strict=True):
                by.setdefault(lang, []).append(gram_codes(text))
            for lang, parts in by.items():
                grams, n = np.unique(np.concatenate(parts), return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(grams), pa.string()), pa.array(grams.astype(np.int64)), pa.array(n)],
                    ["lang", "gram", "n"],
                )

    counts = map_batches(sample.select("lang", "text"), count, "lang string, gram long, n long")
    counts = counts.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    return counts.withColumn("rank", rank).where(F.col("rank") <= size).select("lang", "rank", "gram")


class Profiles:
    """All profiles as one table: sorted n-grams by languages, holding ranks."""

    def __init__(self, rows: list[tuple[str, int, int]], size: int):
        self.langs = sorted({r[0] for r in rows})
        self.size = size
        self.grams = np.unique(np.array([r[2] for r in rows], np.int64).astype(np.uint64))
        self.rank = np.full((len(self.grams) + 1, len(self.langs)), -1, np.int32)
        at = {lang: k for k, lang in enumerate(self.langs)}
        for lang, rank, gram in rows:
            self.rank[np.searchsorted(self.grams, np.uint64(gram % (1 << 64))), at[lang]] = rank - 1

    def nearest(self, grams: np.ndarray) -> tuple[str, float]:
        """The nearest language, and 1 - its share of the largest possible distance."""
        at = np.searchsorted(self.grams, grams)
        at[(at == len(self.grams)) | (self.grams[np.minimum(at, len(self.grams) - 1)] != grams)] = len(self.grams)
        ranks = self.rank[at]
        place = np.arange(len(grams), dtype=np.int32)[:, None]
        out = np.where(ranks < 0, self.size, np.minimum(np.abs(ranks - place), self.size)).sum(0)
        k = int(np.argmin(out))
        return self.langs[k], 1 - float(out[k]) / (self.size * len(grams))


def identify_languages(
    docs: DataFrame,
    train: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    carry: list[str] | None = None,
    size: int = 400,
    top: int = 400,
    max_train_docs: int = MAX_TRAIN_DOCS,
) -> DataFrame:
    """Adds lang_pred and score to every row of docs, from its text alone; profiles are learned from train.

    A null text, one without a letter, and any text when train teaches no language: ``und`` and score 0. Ties go to the
    language of the smallest name. Repeated rows are predicted each; columns that bear a new name are replaced.
    """
    new = ("lang_pred", "score")
    carry = [c for c in (docs.columns if carry is None else carry) if c.lower() not in new]
    text_at = fresh(docs, "_text")
    learned = learn_profiles(train, id_col, text_col, lang_col, size, max_train_docs).collect()
    sent = docs.sparkSession.sparkContext.broadcast(Profiles([tuple(r) for r in learned], size))

    def predict(batches):
        known = sent.value
        for batch in batches:
            b = BlobReader(batch)
            langs, scores = [], []
            for text in b.list(text_at):
                grams = ranked(gram_codes(text), top)
                lang, score = known.nearest(grams) if len(grams) and known.langs else (UNDETERMINED, 0.0)
                langs.append(lang)
                scores.append(score)
            yield pa.RecordBatch.from_arrays(
                [*b.keep(carry), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*carry, *new]
            )

    return map_batches(
        docs.select(*carry, F.col(text_col).alias(text_at)),
        predict,
        with_fields(docs, carry, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())),
    )


def held_out(id_col: str = "doc_id") -> Column:
    """crc32(doc_id as text) mod 4 is 2; false for a null id."""
    return F.coalesce(bucket(id_col, 4) == 2, F.lit(False))
