"""Encoding of whole texts with a public byte-level BPE, and exact statistics of encoded lengths."""

from __future__ import annotations

import json
import os
import re
from array import array

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from quillnet.llm.common import BlobReader, fresh, map_batches, with_fields
from quillnet.session import cut

TOKENIZER = "byte_bpe_50k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: The pattern by which byte-level BPE splits a text before merging; a fixed value.
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_LONG_SPACE = re.compile(r"\s{1000}")


def _byte_letters() -> dict[str, int]:
    """Byte-level BPE writes each byte as one letter: printable Latin-1 as it is, the others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Encoder:
    """Encodes texts to little-endian unsigned 32-bit ids, as the tokenizer file says.

    Where the file is plain byte-level BPE with ids in the order of its merges, its own vocabulary is handed to a faster BPE
    library, which gives the same ids: every merged token is then the only way to its bytes. Texts that hold an added token's
    string or a run of 1,000 spaces, which that library's splitter cannot take, go to the tokenizer itself, and so do
    all texts of any other file.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        self.tokenizer = Tokenizer.from_file(path)
        self.added = [x["content"] for x in said.get("added_tokens", [])]
        self.fast = self._fast(said)

    def _fast(self, said: dict):
        model, split = said["model"], said.get("pre_tokenizer") or {}
        plain = (
            model.get("type") == "BPE" and split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split["add_prefix_space"]
            and said.get("normalizer") is None and said.get("post_processor") is None
            and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
        )
        if not plain:
            return None
        merges = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
        ids, letters = [model["vocab"].get(m) for m in merges], _byte_letters()
        if None in ids or any(a >= b for a, b in zip(ids, ids[1:], strict=False)) or len(ids) + 256 != len(model["vocab"]):
            return None
        import tiktoken

        ranks = {bytes(letters[c] for c in token): k for token, k in model["vocab"].items()}
        return tiktoken.Encoding("file", pat_str=_SPLIT, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def _odd(self, text: str) -> bool:
        if any(a in text for a in self.added):
            return True
        probes = text[::500] if len(text) >= 1000 else ""
        spaces = any(c.isspace() for c in probes)
        return spaces and _LONG_SPACE.search(text) is not None

    def ids(self, text: str | None) -> list[int]:
        if not text:
            return []
        if self.fast is None or self._odd(text):
            return self.tokenizer.encode(text, add_special_tokens=False).ids
        return self.fast(text)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        return [array("I", self.ids(t)).tobytes() for t in texts]

    def lengths(self, texts: list[str | None]) -> list[int]:
        return [len(self.ids(t)) for t in texts]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One in each Python worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def _some(batch: pa.RecordBatch, column: str, step: int = 256):
    """The texts of a batch, a few hundred at a time."""
    texts = batch.column(batch.schema.names.index(column))
    for i in range(0, len(texts), step):
        yield i, texts.slice(i, step).to_pylist()


def encoded_lengths(docs: DataFrame, text_col: str = "text", carry: list[str] | None = None, path: str | None = None) -> DataFrame:
    """The carried columns of every row, and n_tokens: the number of ids of its whole text (0 for null)."""
    path = path or tokenizer_path()
    carry = [c for c in (docs.columns if carry is None else carry) if c.lower() != "n_tokens"]
    text = fresh(docs, "_text")

    def count(batches):
        for batch in batches:
            n = [k for _, texts in _some(batch, text) for k in encoder(path).lengths(texts)]
            yield pa.RecordBatch.from_arrays(
                [*BlobReader(batch).keep(carry), pa.array(n, pa.int64())], [*carry, "n_tokens"]
            )

    return map_batches(
        docs.select(*carry, F.col(text_col).alias(text)),
        count,
        with_fields(docs, carry, T.StructField("n_tokens", T.LongType())),
    )


def length_histogram(lengths: DataFrame, col: str = "n_tokens", stride: int = 4096) -> DataFrame:
    """Exact length histogram with suffix sums: the answer for every context limit that is some document's length.

    Rows: n_tokens, n_docs (of this length), docs_longer, tokens_longer (over documents longer than this limit),
    total_docs, total_tokens, truncated_tokens (what is left when documents are cut at this limit), cut_tokens, and
    quantile (share of documents of this length or less). ``at_limit`` answers other limits and ``quantile`` any rank.

    Partial counts are added before the one small shuffle by length. Suffix sums come in two levels, over strides of
    lengths and then within each stride, so that no task needs the whole histogram. The counts, one row for each distinct
    length, are written once, since both levels read them and the texts must be encoded only once. Null lengths count
    nowhere; an empty input gives no rows.
    """
    counted = (
        lengths.where(F.col(col).isNotNull())
        .groupBy(F.col(col).cast("long").alias("n_tokens"))
        .agg(F.count(F.lit(1)).alias("n_docs"))
    )
    hist = cut(counted).withColumn("_s", F.floor(F.col("n_tokens") / stride))
    strides = hist.groupBy("_s").agg(
        F.sum("n_docs").alias("_d"), F.sum(F.col("n_docs") * F.col("n_tokens")).alias("_t")
    )
    after = W.orderBy(F.desc("_s")).rowsBetween(W.unboundedPreceding, -1)
    whole = W.orderBy("_s").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    strides = strides.select(
        "_s",
        F.coalesce(F.sum("_d").over(after), F.lit(0)).alias("_docs_after"),
        F.coalesce(F.sum("_t").over(after), F.lit(0)).alias("_tokens_after"),
        F.sum("_d").over(whole).alias("total_docs"),
        F.sum("_t").over(whole).alias("total_tokens"),
    )
    inside = W.partitionBy("_s").orderBy(F.desc("n_tokens")).rowsBetween(W.unboundedPreceding, -1)
    out = (
        hist.withColumn("_in_d", F.coalesce(F.sum("n_docs").over(inside), F.lit(0)))
        .withColumn("_in_t", F.coalesce(F.sum(F.col("n_docs") * F.col("n_tokens")).over(inside), F.lit(0)))
        .join(strides, "_s")
        .withColumn("docs_longer", F.col("_in_d") + F.col("_docs_after"))
        .withColumn("tokens_longer", F.col("_in_t") + F.col("_tokens_after"))
        .withColumn("cut_tokens", F.col("tokens_longer") - F.col("docs_longer") * F.col("n_tokens"))
    )
    return out.select(
        "n_tokens",
        "n_docs",
        "docs_longer",
        "tokens_longer",
        "total_docs",
        "total_tokens",
        (F.col("total_tokens") - F.col("cut_tokens")).alias("truncated_tokens"),
        "cut_tokens",
        ((F.col("total_docs") - F.col("docs_longer")) / F.col("total_docs")).alias("quantile"),
    )


def at_limit(histogram: DataFrame, limit: int) -> DataFrame:
    """One row for any context limit: docs and tokens within it and cut by it, from the histogram alone."""
    n, d = F.col("n_tokens"), F.col("n_docs")
    zero = F.lit(0).cast("long")
    return histogram.agg(
        F.lit(limit).cast("long").alias("context_limit"),
        F.coalesce(F.sum(d), zero).alias("total_docs"),
        F.coalesce(F.sum(F.when(n > limit, d)), zero).alias("docs_longer"),
        F.coalesce(F.sum(d * F.least(n, F.lit(limit).cast("long"))), zero).alias("truncated_tokens"),
        F.coalesce(F.sum(F.when(n > limit, d * (n - limit))), zero).alias("cut_tokens"),
    )


def length_quantile(histogram: DataFrame, p: float) -> DataFrame:
    """The smallest length that at least a share p of the documents does not exceed."""
    return histogram.where(F.col("quantile") >= p).agg(F.min("n_tokens").alias("n_tokens"))
