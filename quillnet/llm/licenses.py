"""License scans: an exact set-similarity join of text blocks with license templates.

The blocks of a template are all windows of the text's word sequence, over line breaks, of the template's own number of words
and a tenth more. A template is met by a block that holds at least a share ``containment`` of its distinct words.
Words are ordered by how many documents hold them, rarest first, counted over the whole corpus. A block that meets
template T shares at least o = ceil(containment |T|) words with it, so it holds one of T's |T| - o + 1 rarest words (prefix
filter), has o words or more (length filter), and what follows a shared prefix word still allows o shared words (positional
filter). These filters are asked of the whole text first: only the windows of templates that pass are counted out. Phrases are templates of containment 1 whose block is the whole document;
their words must also stand in a row.

Templates are a parameter of bounded size; corpus statistics cover every document.
"""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right
from collections import Counter
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillnet.llm.common import BlobReader, fresh, map_batches, with_fields, words_of

MAX_TEMPLATE_WORDS = 100_000

# The phrases and labels of the contract.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# Short notices by which public licenses are usually stated.
TEMPLATES = [
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl-2.0", "This work is licensed under the GNU General Public License, version 2"),
    ("lgpl-3.0", "This work is licensed under the GNU Lesser General Public License, version 3"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("cc-by-4.0", "Licensed under CC BY 4.0"),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0"),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0"),
    ("cc0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work, CC0"),
    ("public-domain", "This work has been released into the public domain"),
    ("all-rights-reserved", "All rights reserved"),
]


def word_frequencies(docs: DataFrame, vocabulary: set[bytes], text_col: str = "text") -> dict[bytes, int]:
    """How many documents hold each word of the (bounded) vocabulary, over all documents."""

    def count(batches):
        seen: Counter = Counter()
        for batch in batches:
            for text in BlobReader(batch).list("text"):
                seen.update(vocabulary.intersection(words_of(text)))
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["word", "n"]
        )

    rows = map_batches(docs.select(F.col(text_col).cast("binary").alias("text")), count, "word binary, n long")
    return {bytes(r["word"]): r["n"] for r in rows.groupBy("word").agg(F.sum("n").alias("n")).collect()}


class TemplateIndex:
    """Inverted index over the prefixes of ordered template word sets."""

    def __init__(self, templates: list[tuple[str, str]], phrases: dict[str, str], containment: float, freq: dict[bytes, int]):
        self.rank = {}
        sets = [(label, frozenset(words_of(text.encode())), containment) for label, text in templates]
        self.phrases = [(label, words_of(p.encode())) for p, label in phrases.items()]
        sets += [(label, frozenset(w), 1.0) for label, w in self.phrases]
        every = sorted({w for _, s, _ in sets for w in s}, key=lambda w: (freq.get(w, 0), w))
        self.rank = {w: i for i, w in enumerate(every)}
        self.sets = [(label, sorted(s, key=self.rank.__getitem__), s, math.ceil(c * len(s) - 1e-9)) for label, s, c in sets]
        self.n_templates = len(templates)
        lengths = [len(words_of(text.encode())) for _, text in templates]
        self.widths = [n + math.ceil(n / 10) for n in lengths]
        self.prefix: dict[bytes, list[tuple[int, int]]] = {}
        for t, (_, order, _, need) in enumerate(self.sets):
            for i, w in enumerate(order[: len(order) - need + 1]):
                self.prefix.setdefault(w, []).append((t, i))
        self.phrase_words = {w for t in range(self.n_templates, len(self.sets)) for w in self.sets[t][1]}
        self.prefix_words = frozenset(self.prefix)

    def candidates(self, block: set[bytes], of_phrases: bool) -> set[int]:
        known = sorted((w for w in block if w in self.rank), key=self.rank.__getitem__)
        out = set()
        for j, w in enumerate(known):
            for t, i in self.prefix.get(w, ()):
                if (t >= self.n_templates) != of_phrases:
                    continue
                _, order, _, need = self.sets[t]
                if len(block) < need:
                    continue
                if i + min(len(order) - i, len(known) - j) >= need:
                    out.add(t)
        return out

    def met(self, words: list[bytes], held: set[bytes]) -> list[tuple[int, int, float]]:
        """(first word, template, containment) of the best window of every stretch of text whose windows meet a template.

        A window counts for nothing where it overlaps one of another template that holds all words of its own and more,
        and that is met no less: a longer notice stands there.
        """
        found = []
        for t in self.candidates(held, False):
            _, order, own, need = self.sets[t]
            if len(own & held) >= need:
                at = [k for k, w in enumerate(words) if w in own]
                found += [(a, z, t, n / len(order)) for a, z, n in _windows(words, at, self.widths[t], need)]
        found.sort()
        firsts, reach = [f[0] for f in found], max(self.widths, default=0)
        left: dict[int, list[tuple[int, int, float]]] = {}
        for a, z, t, c in found:
            near = found[bisect_left(firsts, a - reach) : bisect_right(firsts, z)]
            if not any(self.sets[t][2] < self.sets[u][2] and d >= c and a <= last for _, last, u, d in near):
                left.setdefault(t, []).append((a, z, c))
        return sorted((a, t, c) for t, windows in left.items() for a, _, c in _best(windows))


def _windows(words: list[bytes], at: list[int], width: int, need: int) -> list[tuple[int, int, int]]:
    """(first, last, different words) of the windows of width words that hold need different words of those at the given places:
    one for each place that ends such a window, from the last place at which it still holds as many."""
    out: list[tuple[int, int, int]] = []
    inside: Counter = Counter()
    first = 0
    for place in at:
        inside[words[place]] += 1
        while at[first] <= place - width or inside[words[at[first]]] > 1:
            inside[words[at[first]]] -= 1
            if not inside[words[at[first]]]:
                del inside[words[at[first]]]
            first += 1
        if len(inside) >= need:
            out.append((at[first], place, len(inside)))
    return out


def _best(windows: list[tuple[int, int, float]]) -> list[tuple[int, int, float]]:
    """Of windows that overlap, in their order, the one with most; of those with as many, the shortest."""
    out: list[tuple[int, int, float]] = []
    for now in sorted(windows, key=lambda w: (w[1], w[0])):
        if not out or out[-1][1] < now[0]:
            out.append(now)
        elif (now[2], now[0] - now[1]) > (out[-1][2], out[-1][0] - out[-1][1]):
            out[-1] = now
    return out


def _places(words: list[bytes], phrase: list[bytes]) -> list[int]:
    out, at, k = [], -1, len(phrase)
    while True:
        try:
            at = words.index(phrase[0], at + 1)
        except ValueError:
            return out
        if words[at : at + k] == phrase:
            out.append(at)


def scan_licenses(
    docs: DataFrame,
    templates: list[tuple[str, str]] | None = None,
    phrases: dict[str, str] | None = None,
    containment: float = 0.9,
    text_col: str = "text",
    carry: list[str] | None = None,
) -> DataFrame:
    """Adds n_words, n_base, first_word, last_word, base_labels, labels, score and blocks to every row.

    blocks: (line, label, containment) of every place where a template is met; line is that of its first word. score: the largest containment
    found, 0 if none. Null and empty texts: no words, no labels, score 0, null first_word and last_word. Repeated rows are
    returned each; an empty table gives no rows; columns that bear a new name are replaced, others may have any name.
    """
    templates = TEMPLATES if templates is None else templates
    phrases = PHRASES if phrases is None else phrases
    vocabulary = {w for t in [*(x for _, x in templates), *phrases] for w in words_of(t.encode())}
    if len(vocabulary) > MAX_TEMPLATE_WORDS:
        raise ValueError(f"templates hold {len(vocabulary)} words; at most {MAX_TEMPLATE_WORDS} are sent to all tasks")
    new = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "blocks")
    carry = [c for c in (docs.columns if carry is None else carry) if c.lower() not in new]
    text_at = fresh(docs, "_text")
    index = docs.sparkSession.sparkContext.broadcast(
        TemplateIndex(templates, phrases, containment, word_frequencies(docs, vocabulary, text_col))
    )

    def scan(batches):
        ix = index.value
        for batch in batches:
            b = BlobReader(batch)
            cols: dict[str, list] = {c: [] for c in new}
            for text in b.list(text_at):
                words = words_of(text)
                held = set(words)
                places, base, labels, blocks, score = [], set(), set(), [], 0.0
                if not ix.prefix_words.isdisjoint(held):
                    for t in ix.candidates(held, True):
                        label, phrase = ix.phrases[t - ix.n_templates]
                        if at := _places(words, phrase):
                            places += at
                            base.add(label)
                            score = 1.0
                    if met := ix.met(words, held):
                        upto = list(accumulate(len(words_of(line)) for line in text.split(b"\n")))
                    for first, t, c in met:
                        blocks.append({"line": bisect_right(upto, first), "label": ix.sets[t][0], "containment": c})
                        labels.add(ix.sets[t][0])
                        score = max(score, c)
                cols["n_words"].append(len(words))
                cols["n_base"].append(len(places))
                cols["first_word"].append(min(places, default=None))
                cols["last_word"].append(max(places, default=None))
                cols["base_labels"].append(",".join(sorted(base)))
                cols["labels"].append(",".join(sorted(base | labels)))
                cols["score"].append(score)
                cols["blocks"].append(blocks)
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
            kinds.append(pa.list_(pa.struct([("line", pa.int32()), ("label", pa.string()), ("containment", pa.float64())])))
            made = [pa.array(cols[c], k) for c, k in zip(new, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*b.keep(carry), *made], [*carry, *new])

    long, text, double = T.LongType(), T.StringType(), T.DoubleType()
    block = T.StructType([T.StructField("line", T.IntegerType()), T.StructField("label", text), T.StructField("containment", double)])
    kinds = [long, long, long, long, text, text, double, T.ArrayType(block)]
    return map_batches(
        docs.select(*carry, F.col(text_col).cast("binary").alias(text_at)),
        scan,
        with_fields(docs, carry, *[T.StructField(c, k) for c, k in zip(new, kinds, strict=True)]),
    )
