"""Removes passages that repeat across the corpus: FM-index shards that answer matching statistics of streamed documents.

A window is ``window`` consecutive words; each word goes that lies in a window whose words also start anywhere else.

1. Every window has an anchor: of its runs of ``anchor`` words the one with the least hash. Neighbouring windows of one anchor are a
   passage. Equal windows have equal anchors, so a window can repeat only inside passages of one anchor.
2. Anchors are counted over the corpus. Those that occur once are done with; a sieve of bounded size keeps most of their
   passages from being written at all, and a join drops the rest.
3. Equal passages are counted once, with their number; of each one document brings the words. Passages are dealt by anchor to
   shards of a bounded number of them, whatever the size of the corpus.
4. Each shard builds one FM-index (``fmindex``) over its passages and streams the same passages through it: backward search gives the
   matching statistics, and windows whose match is at least ``window`` words long and occurs twice are reported.
5. The reported windows go back to all documents that hold the passage; documents without any are settled by then.

An anchor with very many different passages (a common line in ever new surroundings) would overfill its shard. Windows with
such an anchor are passages of their own, whose anchor is the hash of the whole window: equal ones still meet.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillnet.llm.common import BlobReader, fresh, map_batches, map_groups, with_fields
from quillnet.llm.fmindex import FMIndex, word_ids
from quillnet.session import cut, discard

NEW = ("n_words", "n_removed", "spans", "kept_sha256")
CHUNK_BYTES = 1 << 20
#: Passages of a shard, on average.
SHARD_PASSAGES = 10_000
#: An anchor with more different passages is split into windows.
HOT_PASSAGES = 20_000
SIEVE_BITS = 28
_U = np.uint64
_R = _U(0x9E3779B97F4A7C15)
_powers = np.ones(1, np.uint64)


def _pow(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        _powers = np.concatenate([[_U(1)], np.cumprod(np.full(2 * n, _R))])
    return _powers[:n]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> _U(33))


def _runs(h: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k words from each place on."""
    out, p = np.zeros(len(at), np.uint64), _pow(k)
    for j in range(k):
        out += h[at + j] * p[j]
    return _mix(out)


class Passages(NamedTuple):
    """Passages of several texts: text's number, first word (counted over all texts), number of windows, anchor."""

    doc: np.ndarray
    first: np.ndarray
    windows: np.ndarray
    anchor: np.ndarray
    data: bytes
    starts: np.ndarray
    ends: np.ndarray
    base: np.ndarray
    window: int

    def words(self, k: int) -> bytes:
        return self.data[self.starts[self.first[k]] : self.ends[self.first[k] + self.windows[k] + self.window - 2]]

    def digest(self, k: int) -> int:
        return int.from_bytes(hashlib.blake2b(self.words(k), digest_size=8).digest(), "little", signed=True)


def plain(text: bytes | None) -> bytes:
    """The words, one space apart."""
    return b" ".join(text.split()) if text else b""


def passages(texts: list[bytes], window: int, anchor: int, hot: np.ndarray) -> Passages:
    """Passages of texts in the form of ``plain``; hot: sorted anchors whose windows are passages of their own."""
    counts = np.array([t.count(b" ") + 1 if t else 0 for t in texts], np.int64)
    data = b" ".join([t for t in texts if t]) + b" "
    raw = np.frombuffer(data, np.uint8)
    ends = np.flatnonzero(raw == 32)
    starts = np.concatenate([[0], ends[:-1] + 1])
    base = np.cumsum(counts) - counts
    none = np.zeros(0, np.int64)
    nothing = Passages(none, none, none, none, data, starts, ends, base, window)
    n = int(counts.sum())
    if n < window:
        return nothing
    length = ends - starts
    place = np.arange(len(raw) - 1) - np.repeat(starts, length + 1)[: len(raw) - 1]
    h = _mix(np.add.reduceat(raw[:-1].astype(np.uint64) * _pow(int(length.max()) + 1)[place] * (raw[:-1] != 32), starts) + length.astype(np.uint64))
    # The least run of each window, the leftmost of equal ones.
    least = _runs(h, np.arange(n - anchor + 1), anchor)
    at, value, width, span = np.arange(len(least)), least, 1, window - anchor + 1
    while width < span:
        step = min(width, span - width)
        a, b = value[:-step], value[step:]
        right = b < a
        at, value, width = np.where(right, at[step:], at[:-step]), np.where(right, b, a), width + step
    doc = np.repeat(np.arange(len(texts)), counts)
    inside = np.flatnonzero(doc[: n - window + 1] == doc[window - 1 :])
    if not len(inside):
        return nothing
    pos = at[inside]
    head = np.flatnonzero(np.concatenate([[True], (pos[1:] != pos[:-1]) | (inside[1:] != inside[:-1] + 1)]))
    first, windows = inside[head], np.diff(np.concatenate([head, [len(inside)]]))
    key = least[pos[head]].view(np.int64)
    if len(hot):
        split = np.isin(key, hot)
        apart = np.concatenate([np.arange(a, a + w) for a, w in zip(first[split], windows[split], strict=True)]) if split.any() else none
        whole = _runs(h, apart, window).view(np.int64)
        first, windows, key = np.concatenate([first[~split], apart]), np.concatenate([windows[~split], np.ones(len(apart), np.int64)]), np.concatenate([key[~split], whole])
        order = np.argsort(first, kind="stable")
        first, windows, key = first[order], windows[order], key[order]
    return Passages(doc[first], first, windows, key, data, starts, ends, base, window)


def _chunks(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of batches with some CHUNK_BYTES of text each, the texts in plain form."""
    for batch in batches:
        texts, size, begin = [], 0, 0
        for k, text in enumerate(BlobReader(batch).keep([column])[0]):
            one = text.as_buffer()
            texts.append(plain(one.to_pybytes() if one else None))
            size += len(texts[-1])
            if size >= CHUNK_BYTES:
                yield batch.slice(begin, len(texts)), texts
                texts, size, begin = [], 0, k + 1
        if texts:
            yield batch.slice(begin, len(texts)), texts


def _doc_key(text: bytes) -> int:
    return int.from_bytes(hashlib.sha256(text).digest()[:8], "little", signed=True)


class Sieve:
    """A bit for each key that may be there. Of a bounded size: with more keys it lets more others pass."""

    def __init__(self, keys: DataFrame, column: str):
        distinct = keys.select(column).distinct()
        self.bits = min(SIEVE_BITS, max(16, (distinct.count() * 16).bit_length()))
        part = min(self.bits, 19)
        place = F.col(column).bitwiseAND(F.lit((1 << self.bits) - 1))
        spots = distinct.select(F.shiftright(place, part).alias("part"), place.bitwiseAND(F.lit((1 << part) - 1)).cast("int").alias("bit")).distinct()

        def fill(table: pa.Table) -> pa.Table:
            bits = np.zeros(1 << part, np.uint8)
            bits[table.column("bit").to_numpy()] = 1
            return pa.table([table.column("part").slice(0, 1), pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())], names=["part", "bits"])

        made = bytearray(1 << (self.bits - 3))
        for r in map_groups(spots.groupBy("part"), fill, "part long, bits binary").collect():
            made[r["part"] << (part - 3) : (r["part"] + 1) << (part - 3)] = r["bits"]
        self.held = keys.sparkSession.sparkContext.broadcast(bytes(made))

    def tester(self) -> Callable[[np.ndarray], np.ndarray]:
        held, mask = self.held, (1 << self.bits) - 1

        def test(keys: np.ndarray) -> np.ndarray:
            bits, at = np.frombuffer(held.value, np.uint8), keys & mask
            return ((bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1).astype(bool)

        return test


def _rows(names: str, *columns: np.ndarray | list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names.split())


def _repeated_anchors(texts: DataFrame, column: str, window: int, anchor: int, hot: np.ndarray) -> DataFrame:
    """(a): anchors of more than one passage."""

    def count(batches):
        for _, chunk in _chunks(batches, column):
            keys, times = np.unique(passages(chunk, window, anchor, hot).anchor, return_counts=True)
            yield _rows("a n", keys, times)

    found = map_batches(texts, count, "a long, n long").groupBy("a").agg(F.sum("n").alias("n"))
    return cut(found.where("n > 1").select("a"))


def _occurrences(texts: DataFrame, column: str, window: int, anchor: int, hot: np.ndarray, sieve: Sieve) -> DataFrame:
    """(a, p, d, n): anchor and digest of passages that may repeat, the document, and how often there."""
    test = sieve.tester()

    def list_them(batches):
        for _, chunk in _chunks(batches, column):
            found = passages(chunk, window, anchor, hot)
            kept = np.flatnonzero(test(found.anchor)) if len(found.anchor) else np.zeros(0, np.int64)
            keys = {k: _doc_key(chunk[k]) for k in np.unique(found.doc[kept]).tolist()}
            rows = np.empty((len(kept), 3), np.int64)
            rows[:, 0] = found.anchor[kept]
            rows[:, 1] = [found.digest(k) for k in kept.tolist()]
            rows[:, 2] = [keys[k] for k in found.doc[kept].tolist()]
            rows, times = np.unique(rows, axis=0, return_counts=True) if len(rows) else (rows, np.zeros(0, np.int64))
            yield _rows("a p d n", rows[:, 0].copy(), rows[:, 1].copy(), rows[:, 2].copy(), times)

    return cut(map_batches(texts, list_them, "a long, p long, d long, n long"))


def _texts_of(texts: DataFrame, column: str, sieve: Sieve) -> DataFrame:
    """(d, text): plain texts of documents that the sieve lets pass; copies met by one task once."""
    test = sieve.tester()

    def pick(batches):
        seen: set[int] = set()
        for _, chunk in _chunks(batches, column):
            chunk = [t for t in chunk if t]
            keys = np.array([_doc_key(t) for t in chunk], np.int64)
            new = [k for k in np.flatnonzero(test(keys)).tolist() if not (keys[k] in seen or seen.add(keys[k]))] if len(keys) else []
            yield _rows("d text", keys[new], pa.array([chunk[k] for k in new], pa.binary()))

    return map_batches(texts, pick, "d long, text binary")


def _search(window: int) -> Callable[[pa.Table], pa.Table]:
    """A shard: its passages are indexed and streamed through the index; (a, p, hits), hits: a bit for each window reported."""

    def search(table: pa.Table) -> pa.Table:
        keys = np.column_stack([table.column("a").to_numpy(), table.column("p").to_numpy()])
        _, kept = np.unique(keys, axis=0, return_index=True)
        part = table.take(pa.array(kept))
        ids, lengths = word_ids(part.column("words").to_pylist())
        index = FMIndex(ids, lengths, np.minimum(part.column("n").to_numpy(), 2))
        hit = index.matching_statistics(window) >= window
        hits = np.zeros(len(kept), np.int64)
        for k in range(int(lengths.max()) - window + 1):
            on = np.flatnonzero(lengths - window >= k)
            hits[on] |= hit[index.start[on] + k].astype(np.int64) << k
        on = np.flatnonzero(hits)
        return pa.table([pa.array(keys[kept[on], 0]), pa.array(keys[kept[on], 1]), pa.array(hits[on])], names=["a", "p", "hits"])

    return search


def repeated_passages(texts: DataFrame, column: str, window: int, anchor: int, shard_passages: int, hot_passages: int) -> tuple[DataFrame, DataFrame, np.ndarray]:
    """(a, p, hits) of passages that hold repeated windows, the occurrences, and the anchors that were split."""
    hot = np.zeros(0, np.int64)
    while True:
        anchors = _repeated_anchors(texts, column, window, anchor, hot)
        seen = _occurrences(texts, column, window, anchor, hot, Sieve(anchors, "a"))
        different = cut(seen.groupBy("a", "p").agg(F.sum("n").alias("n"), F.min("d").alias("d")))
        # A whole window has no second passage, so the next round finds no such anchor.
        many = [] if len(hot) else different.groupBy("a").count().where(F.col("count") > hot_passages).select("a").collect()
        if not many:
            break
        hot = np.sort(np.array([r["a"] for r in many], np.int64))
        for df in (anchors, seen, different):
            discard(df)
    wanted = cut(different.join(anchors, "a", "left_semi"))
    discard(different)
    shards = max(1, -(-wanted.count() // shard_passages))
    needs = wanted.groupBy("d").agg(F.collect_list(F.struct("a", "p", "n")).alias("needs"))
    brought = _texts_of(texts, column, Sieve(wanted, "d")).join(needs, "d").select("text", "needs")

    def bring(batches):
        for batch in batches:
            for text, needs in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                want = needs.values
                a, p, n = (want.field(c).to_numpy() for c in ("a", "p", "n"))
                times = dict(zip(zip(a.tolist(), p.tolist(), strict=True), n.tolist(), strict=True))
                found = passages([text], window, anchor, hot)
                out = []
                for k in np.flatnonzero(np.isin(found.anchor, a)).tolist():
                    key = (int(found.anchor[k]), found.digest(k))
                    if key in times:
                        out.append((*key, times.pop(key), found.words(k)))
                yield _rows("a p n words", *[pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.binary()))])

    words = map_batches(brought, bring, "a long, p long, n long, words binary", rows=64)
    dealt = words.withColumn("shard", F.pmod(F.hash("a"), F.lit(shards))).groupBy("shard")
    return cut(map_groups(dealt, _search(window), "a long, p long, hits long")), seen, hot


def _join_spans(hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true."""
    edge = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def remove_repeats(
    docs: DataFrame,
    window: int = 35,
    text_col: str = "text",
    carry: list[str] | None = None,
    anchor: int = 8,
    shard_passages: int = SHARD_PASSAGES,
    hot_passages: int = HOT_PASSAGES,
) -> DataFrame:
    """carry, n_words, n_removed, spans (first word and the word after the last, of what goes), kept_sha256 of every document.

    Words are separated by the bytes 20 and 09 to 0D. Windows are judged on the input. A null or empty text, or one without
    words, has none: kept_sha256 is that of the empty string. A text of fewer than ``window`` words keeps all. Rows that repeat are documents each,
    so copies of at least ``window`` words go as a whole. An empty table gives no rows; columns that bear a new name are
    replaced. ``window - anchor`` is at most 62. Two passages are taken for one if their anchors and 64-bit BLAKE2 digests agree.
    """
    if not 0 < anchor <= window or window - anchor > 62:
        raise ValueError("anchor must be from 1 to window, and window - anchor at most 62")
    carry = [c for c in (docs.columns if carry is None else carry) if c.lower() not in NEW]
    text, key, hits_col = fresh(docs, "_text"), fresh(docs, "_d"), fresh(docs, "_hits")
    texts = docs.select(F.col(text_col).alias(text))
    found, seen, hot = repeated_passages(texts, text, window, anchor, shard_passages, hot_passages)
    back = seen.select("a", "p", "d").join(found, ["a", "p"]).groupBy("d", "a", "p").agg(F.max("hits").alias("hits"))
    hits = cut(back.groupBy("d").agg(F.collect_list(F.struct("a", "p", "hits")).alias("hits")))
    test = Sieve(hits, "d").tester()
    names = [*carry, key, "n_words", "kept_sha256", text]

    def settle(batches):
        for batch, chunk in _chunks(batches, text):
            digests = [hashlib.sha256(t) for t in chunk]
            keys = np.array([int.from_bytes(x.digest()[:8], "little", signed=True) for x in digests], np.int64)
            open_ = test(keys)
            yield pa.RecordBatch.from_arrays(
                [
                    *BlobReader(batch).keep(carry),
                    pa.array(keys),
                    pa.array([t.count(b" ") + 1 if t else 0 for t in chunk], pa.int64()),
                    pa.array([x.hexdigest() for x in digests]),
                    pa.array([t if o else None for t, o in zip(chunk, open_.tolist(), strict=True)], pa.binary()),
                ],
                names,
            )

    field = T.StructField
    plain_fields = [field("n_words", T.LongType()), field("kept_sha256", T.StringType())]
    schema = with_fields(docs, carry, field(key, T.LongType()), *plain_fields, field(text, T.BinaryType()))
    rows = map_batches(docs.select(*carry, F.col(text_col).alias(text)), settle, schema)
    joined = rows.join(hits.withColumnsRenamed({"d": key, "hits": hits_col}), key, "left").select(*names, hits_col)

    def remove(batches):
        for batch in batches:
            b = BlobReader(batch)
            removed, spans, kept = [], [], b.list("kept_sha256")
            for k, (raw, hits) in enumerate(zip(b.list(text), b.keep([hits_col])[0], strict=True)):
                begin, end = np.zeros(0, np.int64), np.zeros(0, np.int64)
                if raw is not None and hits.is_valid:
                    part = passages([raw], window, anchor, hot)
                    a, p, h = (hits.values.field(c).to_numpy() for c in ("a", "p", "hits"))
                    known = dict(zip(zip(a.tolist(), p.tolist(), strict=True), h.tolist(), strict=True))
                    gone = np.zeros(len(part.starts) + 1, np.int64)
                    for j in np.flatnonzero(np.isin(part.anchor, a)).tolist():
                        bits = known.get((int(part.anchor[j]), part.digest(j)), 0)
                        at = int(part.first[j])
                        while bits:
                            low = bits & -bits
                            i = at + low.bit_length() - 1
                            gone[i] += 1
                            gone[i + window] -= 1
                            bits ^= low
                    gone = np.cumsum(gone[:-1]) > 0
                    begin, end = _join_spans(gone)
                    if len(begin):
                        stay, stop = _join_spans(~gone)
                        kept[k] = hashlib.sha256(b" ".join(raw[part.starts[i] : part.ends[j - 1]] for i, j in zip(stay, stop, strict=True))).hexdigest()
                removed.append(int((end - begin).sum()))
                spans.append([{"first": int(i), "end": int(j)} for i, j in zip(begin, end, strict=True)])
            span = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([*b.keep([*carry, "n_words"]), pa.array(removed, pa.int64()), pa.array(spans, span), pa.array(kept, pa.string())], [*carry, *NEW])

    span = T.ArrayType(T.StructType([field("first", T.LongType()), field("end", T.LongType())]))
    out = with_fields(docs, carry, plain_fields[0], field("n_removed", T.LongType()), field("spans", span), plain_fields[1])
    return map_batches(joined, remove, out, rows=256)


def without_spans(docs: DataFrame, text_col: str = "text", spans_col: str = "spans") -> DataFrame:
    """docs with the words outside the spans, one space apart, as text."""
    words = F.filter(F.split(F.col(text_col), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    kept = F.filter(words, lambda w, i: ~F.exists(F.col(spans_col), lambda s: (s["first"] <= i) & (i < s["end"])))
    return docs.withColumn(text_col, F.array_join(kept, " "))
