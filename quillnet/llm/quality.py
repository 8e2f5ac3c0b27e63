"""Quality: co-training of a text-content and a page-metadata classifier.

Content view: hashed words and word pairs of the whole text, and its shares of character classes and repetition.
Metadata view: what is known of a page beside its text: source, language and length.

Both start from the same bounded sample of labelled rows. A quarter of these trains neither: on it each view is calibrated, in every round
anew. (Where a view says the same of all of these, such as of pages without metadata, it is calibrated on a quarter of the rows that the other
one has labelled for it, which does not train it.) In each round either classifier scores all other training rows, and those of which it is surest, by rank within each class and in the
classes' proportion, go to the other one's training set. Surest means at least halfway from the share of label 1 to
certainty, so a rare class is given as well as a common one; a view that tells the calibration rows apart no better than that
share does gives none. At the end the calibrated log-odds of both views less those of the share score every document; a view that
is no better than the share counts as the share.

The features of the rows without a label are written once and read in each round; of every part of them only the most
confident rows leave a task, and of all rows 2 * per_round for each view reach the driver in a round.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillnet.llm.common import BlobReader, fresh, join_bounded, map_batches, with_fields
from quillnet.llm.jaccard import ngram_hashes
from quillnet.llm.toxicity import _fit
from quillnet.session import cut

MAX_LABELLED = 4000
BUCKETS = 1 << 16
SIZES = 32
#: A source or language is told apart if more than one row in so many bears it.
MAX_VALUES = 200
_CLASS = bytes(65 if 65 <= b <= 90 else 97 if 97 <= b <= 122 or b >= 128 else 48 if 48 <= b <= 57 else 32 if b in (9, 10, 13, 32) else 33 for b in range(256))


def content_view(text: bytes | None) -> tuple[np.ndarray, list[float]]:
    """The buckets of a text's different words and word pairs, and its style; of nothing for null and empty texts."""
    text = text or b""
    n = max(1, len(text))
    c = np.bincount(np.frombuffer(text.translate(_CLASS), np.uint8), minlength=128)
    words = text.split()
    w = max(1, len(words))
    lines = text.split(b"\n")
    same = sum(a == b for a, b in zip(words, words[1:], strict=False))
    style = [
        c[65] / n, c[97] / n, c[48] / n, c[33] / n, len(set(words)) / w, same / w, min(5.0, len(text) / w / 10),
        float(np.log1p(w)) / 5, float(np.log1p(len(lines))) / 5, len(set(lines)) / len(lines),
    ]
    return np.unique((ngram_hashes(text, (1, 2)) & np.uint64(BUCKETS - 1)).astype(np.uint16)), style


N_STYLE = 10


class Content:
    """Logistic regression on hashed n-grams (each text's of length 1 together) and standardised style."""

    def __init__(self, rounds: int = 80, ridge: float = 1e-4):
        self.rounds, self.ridge = rounds, ridge
        self.w, self.v, self.b = np.zeros(BUCKETS), np.zeros(N_STYLE), 0.0
        self.mean, self.scale = np.zeros(N_STYLE), np.ones(N_STYLE)

    def odds(self, rows: list[tuple[np.ndarray, list[float]]]) -> np.ndarray:
        if not rows:
            return np.empty(0)
        size = np.array([len(r[0]) for r in rows])
        style = (np.array([r[1] for r in rows]) - self.mean) / self.scale
        sums = np.concatenate([[0.0], np.cumsum(self.w[np.concatenate([r[0] for r in rows])])])
        ends = np.cumsum(size)
        return (sums[ends] - sums[ends - size]) / np.sqrt(np.maximum(size, 1)) + style @ self.v + self.b

    def fit(self, rows: list[tuple[np.ndarray, list[float]]], y: np.ndarray) -> Content:
        """Accelerated gradient steps from where the model stands."""
        size = np.array([len(r[0]) for r in rows])
        at, row = np.concatenate([r[0] for r in rows]).astype(np.int64), np.repeat(np.arange(len(rows)), size)
        share = 1 / np.sqrt(np.maximum(size, 1))
        raw = np.array([r[1] for r in rows])
        mean, scale = raw.mean(0), raw.std(0)
        scale = np.where(scale > 1e-6, scale, np.inf)
        # The same model in the new scale.
        v = np.where(np.isfinite(scale), self.v * np.where(np.isfinite(scale), scale, 1) / self.scale, 0)
        self.b += float(((mean - self.mean) / self.scale) @ self.v)
        self.mean, self.scale = mean, scale
        style = (raw - mean) / scale
        now = [self.w.copy(), v, self.b]
        ahead, step = [x if isinstance(x, float) else x.copy() for x in now], 4.0 / (2 + (style**2).sum(1).max())
        for k in range(self.rounds):
            odds = np.bincount(row, ahead[0][at], len(rows)) * share + style @ ahead[1] + ahead[2]
            g = (1 / (1 + np.exp(-np.clip(odds, -30, 30))) - y) / len(y)
            grads = (np.bincount(at, (g * share)[row], BUCKETS) + self.ridge * ahead[0], style.T @ g + self.ridge * ahead[1], float(g.sum()))
            new = [x - step * d for x, d in zip(ahead, grads, strict=True)]
            ahead = [x + k / (k + 3) * (x - old) for x, old in zip(new, now, strict=True)]
            now = new
        self.w, self.v, self.b = now
        return self


class Metadata:
    """Logistic regression on one-hot source, language and length class; values outside the given ones are all alike."""

    def __init__(self, values: list[list]):
        self.places, n = [], 0
        for of in values:
            self.places.append({v: n + i for i, v in enumerate(sorted(of, key=repr))})
            n += len(of)
        self.n = n
        self.weights = np.zeros(n + SIZES + 2)

    def _matrix(self, rows: list[tuple]) -> np.ndarray:
        x = np.zeros((len(rows), self.n + SIZES + 1))
        for i, (source, lang, size) in enumerate(rows):
            for v, place in zip((source, lang), self.places, strict=True):
                if v in place:
                    x[i, place[v]] = 1
            x[i, self.n + min(SIZES - 1, int(2 * np.log2(1 + max(0, size))))] = 1
            x[i, -1] = np.log1p(max(0, size))
        return x

    def odds(self, rows: list[tuple]) -> np.ndarray:
        return self._matrix(rows) @ self.weights[:-1] + self.weights[-1]

    def fit(self, rows: list[tuple], y: np.ndarray) -> Metadata:
        self.weights = _fit(self._matrix(rows), y, ridge=1.0)
        return self


def logit(p: float) -> float:
    return float(np.log(p / (1 - p)))


def calibration(odds: np.ndarray, y: np.ndarray, prior: float | None = None) -> tuple[float, float]:
    """(slope, bias) of a view's log-odds on rows that did not train it; (0, prior: by default the log-odds of the share of label 1) if the view
    tells no more than the share: by falling with the labels, or by a likelihood not better by the two that a parameter costs."""
    share = float(y.mean())
    none = (0.0, logit(share) if prior is None else prior)
    x = np.clip(odds, -30, 30)
    slope, bias = _fit(x[:, None], y, ridge=0.1).tolist()
    z = np.clip(slope * x + bias, -30, 30)
    gain = float((y * z - np.log1p(np.exp(z))).sum()) - len(y) * (share * np.log(share) + (1 - share) * np.log(1 - share))
    return (slope, bias) if slope > 0 and gain > 2 else none


def _aside(row_id) -> bool:
    """Whether a row calibrates and trains nothing."""
    return zlib.crc32(f"{row_id}/fold".encode()) % 4 == 0


def cotrain(models: list, views: list[list], y: np.ndarray, confident, rounds: int, apart: list[tuple[list, list]] | None = None) -> list:
    """Fits both models on the labelled rows, then in each round on what the other one is sure of as well.

    apart: for each model rows and labels that do not train it; those of the new rows that are ``_aside`` go there.

    confident(models, used) -> for each model its new pseudo-labelled rows, (view rows of the other model, labels, ids); used: for
    each model the ids that it has been given already.
    """
    sets = [(list(v), y) for v in views]
    used: list[set] = [set(), set()]
    for m, (rows, t) in zip(models, sets, strict=True):
        m.fit(rows, t)
    for _ in range(rounds):
        given = confident(models, used)
        if not any(len(g[2]) for g in given):
            break
        for k, (rows, t, ids) in enumerate(given):
            other = 1 - k
            used[other].update(ids)
            held = [apart is not None and _aside(i) for i in ids]
            if apart is not None:
                apart[other][0].extend(r for r, h in zip(rows, held, strict=True) if h)
                apart[other][1].extend(x for x, h in zip(t, held, strict=True) if h)
            trains = [r for r, h in zip(rows, held, strict=True) if not h]
            sets[other] = (sets[other][0] + trains, np.concatenate([sets[other][1], t[~np.array(held, bool)]]))
        for m, (rows, t) in zip(models, sets, strict=True):
            m.fit(rows, t)
    return models


ROW = "id {}, label int, at binary, style array<double>, source string, lang string, size double"


def _row(r) -> tuple[tuple, tuple]:
    return (np.frombuffer(r["at"], "<u2"), r["style"]), (r["source"], r["lang"], r["size"])


def score_quality(
    docs: DataFrame,
    train: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    carry: list[str] | None = None,
    rounds: int = 3,
    per_round: int = 400,
    max_labelled: int = MAX_LABELLED,
    source_col: str = "source",
    lang_col: str = "lang",
    size_col: str = "n_chars",
) -> DataFrame:
    """Adds content_score, metadata_score, score (0 to 1, higher: label 1 likelier) and predicted to every row of docs.

    At most max_labelled labelled rows of train, those of the smallest hash, are learned from (three quarters of them; a quarter
    calibrates), and all its rows without a label by co-training. Labels other than 0 and 1 and null ids teach nothing; where an
    id has both labels, 0 stands. With labels of one class only, or none, every score is 0.5 (predicted 1). The columns of
    metadata may be missing or null; a missing or null size is the text's. Repeated rows are scored each; an empty table
    gives no rows; columns that bear a new name are replaced, others may have any name.
    """
    spark = docs.sparkSession
    new = ("content_score", "metadata_score", "score", "predicted")
    carry = [c for c in (docs.columns if carry is None else carry) if c.lower() not in new]
    names = text_at, source_at, lang_at, size_at = tuple(fresh(docs, c) for c in ("_text", "_source", "_lang", "_size"))

    def inputs(df: DataFrame, *cols):
        known = {c.lower() for c in df.columns}
        meta = lambda c, kind: (F.col(c) if c.lower() in known else F.lit(None)).cast(kind)
        size = F.coalesce(meta(size_col, "double"), F.length(text_col).cast("double"), F.lit(0.0))
        return df.select(
            *cols, F.col(text_col).cast("binary").alias(text_at), meta(source_col, "string").alias(source_at),
            meta(lang_col, "string").alias(lang_at), size.alias(size_at),
        )

    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(
        F.min(label_col).cast("int").alias("label")
    )
    ids = train.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"))
    there = join_bounded(known, ids, "id", "left_semi", 200_000)
    chosen = cut(there.orderBy(F.xxhash64("id"), "id").limit(max_labelled))
    kind = train.schema[id_col].dataType.simpleString()

    def describe(batches):
        for batch in batches:
            b = BlobReader(batch)
            rows = [content_view(t) for t in b.list(text_at)]
            made = [pa.array([r[0].astype("<u2").tobytes() for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays([*b.keep(["id", "label"]), *made, *b.keep([source_at, lang_at, size_at])], ["id", "label", "at", "style", "source", "lang", "size"])

    def described(rows: DataFrame) -> DataFrame:
        return map_batches(rows.select("id", "label", *names), describe, ROW.format(kind))

    taught = inputs(train, F.col(id_col).alias("id")).where("id is not null")
    got = described(join_bounded(taught, chosen, "id", "inner")).collect()
    y = np.array([r["label"] for r in got], float)
    content, meta = [_row(r)[0] for r in got], [_row(r)[1] for r in got]
    aside = np.array([_aside(r["id"]) for r in got], bool)
    fits, held = np.flatnonzero(~aside), np.flatnonzero(aside)
    pick = lambda rows, at: [rows[k] for k in at.tolist()]
    lines, prior = [(0.0, 0.0)] * 2, 0.0
    models = [Content(), Metadata(_common(taught, [source_at, lang_at]))]
    if len(set(y[fits].tolist())) == 2 and len(set(y[held].tolist())) == 2:
        pool = cut(described(join_bounded(taught, known, "id", "left_anti", 200_000).withColumn("label", F.lit(None).cast("int"))))
        labelled, given = [(pick(v, held), y[held]) for v in (content, meta)], [([], []), ([], [])]
        prior = logit(float(y[held].mean()))

        def calibrated(models: list) -> list[tuple[float, float]]:
            out = []
            for m, (rows, t), (more, said) in zip(models, labelled, given, strict=True):
                odds = m.odds(rows)
                if np.ptp(odds) < 1e-9 and len(set(said)) == 2:
                    odds, t = m.odds(more), np.array(said)
                out.append(calibration(odds, t, prior))
            return out

        cotrain(models, [pick(content, fits), pick(meta, fits)], y[fits], _confident(pool, per_round, calibrated, float(y[held].mean())), rounds, given)
        lines = calibrated(models)
    model = spark.sparkContext.broadcast((models, lines, prior))

    def score(batches):
        (one, two), by_view, share = model.value
        for batch in batches:
            r = BlobReader(batch)
            a = one.odds([content_view(t) for t in r.list(text_at)])
            z = two.odds(list(zip(*(r.list(c) for c in names[1:]), strict=True)))
            odds = np.column_stack([slope * np.clip(x, -30, 30) + bias for x, (slope, bias) in zip((a, z), by_view, strict=True)])
            p = 1 / (1 + np.exp(-np.clip(odds.sum(1) - share, -30, 30)))
            each = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
            yield pa.RecordBatch.from_arrays(
                [*r.keep(carry), pa.array(each[:, 0]), pa.array(each[:, 1]), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], [*carry, *new]
            )

    double = T.DoubleType()
    fields = [T.StructField(c, double) for c in new[:3]] + [T.StructField("predicted", T.IntegerType())]
    return map_batches(inputs(docs, *carry), score, with_fields(docs, carry, *fields))


def _common(rows: DataFrame, columns: list[str], at_most: int = MAX_VALUES) -> list[list]:
    """For each column the values that more than a share 1 / at_most of all rows bear."""
    total = rows.count()
    often = lambda c: rows.groupBy(c).count().where(F.col("count") * at_most > total)
    return [[r[0] for r in often(c).collect()] for c in columns]


def _confident(pool: DataFrame, per_round: int, calibrated, share: float):
    """The rows of the pool of which each model is surest, in the classes' proportion, ties by id's hash; calibrated(models): their lines.

    For label 1 the calibrated share must reach halfway from the share of label 1 to 1, for label 0 halfway to 0.
    """
    n_one = max(1, round(per_round * share))
    n_of = {1: n_one, 0: max(1, per_round - n_one)}

    def confident(models: list, used: list[set]):
        lines = calibrated(models)
        sent = pool.sparkSession.sparkContext.broadcast((models, used))

        def surest(batches):
            ms, given = sent.value
            for batch in batches:
                rows = batch.to_pylist()
                views = list(zip(*(_row(r) for r in rows), strict=True)) if rows else [(), ()]
                keep: dict[int, list] = {}
                for k, m in enumerate(ms):
                    slope, bias = lines[k]
                    if not slope:
                        continue
                    p = 1 / (1 + np.exp(-np.clip(slope * np.clip(m.odds(list(views[k])), -30, 30) + bias, -30, 30)))
                    for label in (0, 1):
                        sure, least = (p, (1 + share) / 2) if label else (1 - p, 1 - share / 2)
                        order = [i for i in np.argsort(-sure, kind="stable").tolist() if sure[i] >= least and rows[i]["id"] not in given[1 - k]]
                        for i in order[: n_of[label]]:
                            keep.setdefault(i, []).append((k, label, float(sure[i])))
                flat = [(i, *x) for i, found in sorted(keep.items()) for x in found]
                cols = list(zip(*flat, strict=True)) if flat else [[]] * 4
                part = batch.take(pa.array(list(cols[0]), pa.int64()))
                extra = [pa.array(list(cols[1]), pa.int32()), pa.array(list(cols[2]), pa.int32()), pa.array(list(cols[3]), pa.float64())]
                yield pa.RecordBatch.from_arrays([*part.columns, *extra], [*part.schema.names, "by", "is", "sure"])

        found = cut(map_batches(pool, surest, T.StructType([*pool.schema, *T._parse_datatype_string("`by` int, `is` int, sure double")]), rows=None))
        out = []
        for k in (0, 1):
            rows = []
            for label in (0, 1):
                mine = found.where((F.col("by") == k) & (F.col("is") == label)).orderBy(F.desc("sure"), F.xxhash64("id"), "id")
                rows += [(r, label) for r in mine.limit(n_of[label]).collect()]
            out.append(([_row(r)[1 - k] for r, _ in rows], np.array([t for _, t in rows], float), [r["id"] for r, _ in rows]))
        return out

    return confident
