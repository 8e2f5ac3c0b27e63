"""Benchmark decontamination: one Aho-Corasick automaton over normalised benchmark passages, one scan of each text.

A text's words (ASCII lower-cased, split at ASCII punctuation) are written with single spaces between them, and so are
the benchmark's windows of ``window`` consecutive words; an automaton over " w1 w2 ... " finds every occurrence in a
single pass. Positions are word numbers, which are mapped back to character offsets of the original text.

The windows' total size is counted first. One automaton takes about ``block_bytes`` of them, for each of which it needs some
35 bytes of memory in every Python worker (measured: 141 MB for 4 MB). A larger benchmark is dealt by hash into several
automata, through which the rows pass one after the other, without a shuffle; with more than two, rows are written in
between, so that no stage holds more than two automata.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillnet.llm.common import BlobReader, fresh, map_batches, with_fields, words_of
from quillnet.session import cut

_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = {c: c + 32 for c in range(65, 91)}
_AUTOMATA: dict[str, ahocorasick.Automaton] = {}


def windows(benchmark: DataFrame, window: int = 10, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item, phrase) rows: each ``window`` consecutive words of an item; an item of fewer words, but not none, is one.

    Items whose id is null, and null or wordless texts, have none. Repeated items count once.
    """

    def cut_up(batches):
        for batch in batches:
            b = BlobReader(batch)
            out = set()
            for item, text in zip(b.list("item"), b.list("text"), strict=True):
                w = words_of(text)
                for i in range(max(1, len(w) - window + 1)) if w else ():
                    out.add((item, b" ".join(w[i : i + window]).decode()))
            rows = sorted(out)
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string())],
                ["item", "phrase"],
            )

    items = benchmark.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("string").alias("item"), F.col(text_col).cast("binary").alias("text")
    )
    return map_batches(items, cut_up, "item string, phrase string").distinct()


def _automaton(key: str, phrases: list[tuple[str, list[str]]]) -> ahocorasick.Automaton:
    """Built once in each Python worker; the newest one is kept."""
    if key not in _AUTOMATA:
        _AUTOMATA.clear()
        made = ahocorasick.Automaton()
        for phrase, items in phrases:
            padded = f" {phrase} ".encode().decode("latin-1")
            made.add_word(padded, (len(padded) - 1, phrase.count(" ") + 1, items))
        made.make_automaton()
        _AUTOMATA[key] = made
    return _AUTOMATA[key]


def _scan(found, words: list[bytes]) -> tuple[set[str], list[tuple[int, int]]]:
    """Items that occur, and merged [first, last] word ranges that they cover."""
    if not words:
        return set(), []
    line = b" " + b" ".join(words) + b" "
    hits = [(end - size, n, items) for end, (size, n, items) in found.iter(line.decode("latin-1"))]
    if not hits:
        return set(), []
    spaces = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
    first = np.searchsorted(spaces, np.array([h[0] for h in hits]))
    ranges: list[list[int]] = []
    for a, n in sorted(zip(first.tolist(), (h[1] for h in hits), strict=True)):
        if ranges and a <= ranges[-1][1] + 1:
            ranges[-1][1] = max(ranges[-1][1], a + n - 1)
        else:
            ranges.append([a, a + n - 1])
    return {i for h in hits for i in h[2]}, [(a, b) for a, b in ranges]


def _merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _blocks(grams: DataFrame, block_bytes: int) -> tuple[DataFrame, int]:
    """(phrase, items) and the number of blocks; with more than one, a column block too.

    The benchmark is cut into windows once. Of several blocks each lies together in the written table, so reading one of them
    skips the others, and the work grows as the benchmark, not as its square.
    """
    by_phrase = cut(grams.groupBy("phrase").agg(F.sort_array(F.collect_set("item")).alias("items")))
    size = F.size("items") * (F.octet_length("phrase") + 4) + F.octet_length(F.array_join("items", ""))
    total = by_phrase.agg(F.sum(size.cast("long"))).first()[0] or 0
    n_blocks = max(1, -(-total // block_bytes))
    if n_blocks > 1:
        block = F.pmod(F.xxhash64("phrase"), F.lit(n_blocks)).cast("int")
        by_phrase = cut(by_phrase.withColumn("block", block).repartitionByRange("block").sortWithinPartitions("block"))
    return by_phrase, n_blocks


SPAN = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = 10,
    text_col: str = "text",
    item_col: str = "item_id",
    bench_text_col: str = "text",
    carry: list[str] | None = None,
    block_bytes: int = 3_000_000,
) -> DataFrame:
    """Adds n_words, n_hit, items, spans and contaminated to every row of docs.

    items: sorted ids of the items of which a window occurs. spans: character ranges [start, end) of the original text
    that windows cover, merged. carry: the columns of docs to return (default: all).

    Null and wordless texts: no words, no hits. An empty benchmark hits nothing. Repeated rows are scanned and returned
    each. Columns of docs that bear one of the new names are replaced.
    """
    spark = docs.sparkSession
    new = ("n_words", "n_hit", "items", "spans", "contaminated")
    carry = [c for c in (docs.columns if carry is None else carry) if c.lower() not in new]
    by_phrase, n_blocks = _blocks(windows(benchmark, window, item_col, bench_text_col), block_bytes)
    blob, got, at = (fresh(docs, c) for c in ("_text", "_items", "_ranges"))
    rows = docs.select(
        *carry,
        F.col(text_col).cast("binary").alias(blob),
        F.array().cast("array<string>").alias(got),
        F.array().cast("array<int>").alias(at),
    )
    for k in range(n_blocks):
        mine = by_phrase.where(F.col("block") == k) if n_blocks > 1 else by_phrase
        phrases = [(r["phrase"], list(r["items"])) for r in mine.collect()]
        sent = spark.sparkContext.broadcast(phrases)
        key = hashlib.sha256(repr(sorted(phrases)).encode()).hexdigest()
        last = k == n_blocks - 1

        def scan(batches, sent=sent, key=key, last=last):
            found = _automaton(key, sent.value) if sent.value else None
            for batch in batches:
                b = BlobReader(batch)
                cols: dict[str, list] = defaultdict(list)
                for text, items, flat in zip(b.list(blob), b.list(got), b.list(at), strict=True):
                    words = words_of(text)
                    now, ranges = _scan(found, words) if found is not None else (set(), [])
                    now |= set(items)
                    ranges = _merged(ranges + list(zip(flat[::2], flat[1::2], strict=True)))
                    if not last:
                        cols["items"].append(sorted(now))
                        cols["ranges"].append([x for r in ranges for x in r])
                        continue
                    where = []
                    if ranges:
                        spots = [m.span() for m in _WORD.finditer(text.decode().translate(_LOWER))]
                        where = [{"start": spots[a][0], "end": spots[z][1]} for a, z in ranges]
                    cols["n_words"].append(len(words))
                    cols["n_hit"].append(sum(z - a + 1 for a, z in ranges))
                    cols["items"].append(sorted(now))
                    cols["spans"].append(where)
                    cols["contaminated"].append(bool(ranges))
                if last:
                    made = [
                        pa.array(cols["n_words"], pa.int64()),
                        pa.array(cols["n_hit"], pa.int64()),
                        pa.array(cols["items"], pa.list_(pa.string())),
                        pa.array(cols["spans"], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
                        pa.array(cols["contaminated"], pa.bool_()),
                    ]
                    yield pa.RecordBatch.from_arrays([*b.keep(carry), *made], [*carry, *new])
                else:
                    made = [
                        *b.keep([blob]),
                        pa.array(cols["items"], pa.list_(pa.string())),
                        pa.array(cols["ranges"], pa.list_(pa.int32())),
                    ]
                    yield pa.RecordBatch.from_arrays([*b.keep(carry), *made], [*carry, blob, got, at])

        fields = (
            (
                T.StructField("n_words", T.LongType()),
                T.StructField("n_hit", T.LongType()),
                T.StructField("items", T.ArrayType(T.StringType())),
                T.StructField("spans", SPAN),
                T.StructField("contaminated", T.BooleanType()),
            )
            if last
            else tuple(rows.schema[c] for c in (blob, got, at))
        )
        rows = map_batches(rows, scan, with_fields(docs, carry, *fields))
        if n_blocks > 2 and not last:
            rows = cut(rows)
    return rows
