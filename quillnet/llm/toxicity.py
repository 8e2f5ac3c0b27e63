"""Toxicity: class-conditional Kneser-Ney models of letters, compared by length-normalised log-likelihood.

Each class (toxic, ordinary) has an interpolated Kneser-Ney model of order 5 over the letters of words:
P_c(s | ctx) = max(n_c(ctx s) - D, 0) / n_c(ctx) + D t_c(ctx) / n_c(ctx) * P(s | shorter ctx). The shorter-context
distributions are Kneser-Ney continuation models whose counts both classes share, so an expression that one class has hardly
seen leans on the same backoff as in the other.

A second pair of models reads whole words, and beginnings of 7 and of 4 letters of longer ones, as expressions:
P_c(w) = max(n_c(w) - D, 0) / N_c + D t_c / N_c * 1 / t, over the t expressions of a kind that toxic texts hold, of which class c has
t_c. A word has the log ratio of its longest expression that toxic texts hold, 0 if there is none. So a long word made of
ordinary letter runs, or a stem that takes many endings, is seen as one expression. Ordinary texts are counted only for
expressions that toxic ones hold: a sieve of these, of bounded size, leaves out most others before the shuffle, and the
ratios leave out the rest.

Scoring needs only the log ratio of the two models. It is kept for every counted n-gram by its five letters as they are, and
for every context, and every expression, by 104 bits of hash: an n-gram that neither class has counted has the ratio of D t_c(ctx) / n_c(ctx), as the shared backoff is
the same in both, and 0 after a context that neither has counted. These tables grow with the corpus; beyond
``block_entries`` they are sent in blocks, and rows pass through one block after the other.

A document is compared as a whole, in windows of words and of letters, and word by word, normalised by length, by both pairs
of models; a logistic model of these ratios gives the score. It is learned on a bounded sample of training rows, as models of all other rows describe
them; documents are then scored by models of all labelled training rows, the sample too.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillnet.llm.common import BlobReader, bucket, fresh, join_bounded, map_batches, with_fields
from quillnet.llm.language import _letters
from quillnet.session import cut, discard

DISCOUNT = 0.75
N_FEATURES = 17
#: A word of this log ratio is plainly toxic: some fifty times likelier in toxic texts.
PLAINLY = 4.0
MAX_CALIBRATION_ROWS = 20_000
MIN_CALIBRATION_ROWS = 10
BLOCK_ENTRIES = 1 << 21
#: So many letters are counted at once.
COUNT_LETTERS = 1 << 20
#: So many letters are looked up together: with one block, and where every block is loaded for them.
CHUNK_LETTERS = (1 << 16, 1 << 21)
#: A letter takes 21 bits. No letter has them all set: in the place of the last letter they mark a context.
BITS, ANY = 21, (1 << 21) - 1
KEY = ["hi", "lo"]
#: Keys of expressions have this bit of hi set, and 42 more bits of the hash in lo, where their kind stands last: 0 for words.
WORD_KEY = 1 << 62
STEMS = (7, 4)
KINDS = (0, *STEMS)
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
#: The sieve has 16 bits for each expression, within these bounds (32 MB at most). A full sieve costs time, not results.
SIEVE_BITS = (1 << 16, 1 << 28)
_NONE = np.empty(0, np.int64)


def letter_codes(text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(four letters before, letter) for every letter of every word and its end, and each word's first place.

    hi holds the first two of the five, lo the others, 21 bits each; 0 is no letter. What precedes a word is not seen from
    within it.
    """
    if not text:
        return _NONE, _NONE, _NONE
    c = np.frombuffer(text.lower().encode("utf-32-le"), np.uint32)
    s = np.where(_letters()[c], c, 0).astype(np.int64)
    s = np.concatenate([np.zeros(1, np.int64), s, np.zeros(1, np.int64)])
    s = s[np.concatenate([[True], (s[1:] != 0) | (s[:-1] != 0)])]
    if len(s) < 3:
        return _NONE, _NONE, _NONE
    padded = np.concatenate([np.zeros(3, np.int64), s])
    n = len(s) - 1
    before, open_word = [], np.ones(n, bool)
    for k in range(4):
        symbol = padded[3 - k : 3 - k + n]
        before.append(np.where(open_word, symbol, 0))
        open_word = open_word & (symbol != 0)
    return before[3] << BITS | before[2], before[1] << 2 * BITS | before[0] << BITS | s[1:], np.flatnonzero(s[:-1] == 0)


def word_codes(hi: np.ndarray, lo: np.ndarray, starts: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """kind -> (hi, lo, which words): keys of the words that letter_codes tells, and of the beginnings of longer ones."""
    if not len(starts):
        return {k: (_NONE, _NONE, _NONE) for k in KINDS}
    letter = (lo & ANY).astype(np.uint64)
    size = np.diff(np.append(starts, len(lo)))
    place = np.arange(len(lo), dtype=np.uint64) - np.repeat(starts.astype(np.uint64), size)
    sums = []
    for salt in (np.uint64(0x632BE59BD9B4E019), np.uint64(0xD6E8FEB86659FD93)):
        h = (letter + salt) * _MULTIPLIER ^ (place * salt)
        h = (h ^ h >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
        sums.append(np.concatenate([np.zeros(1, np.uint64), np.cumsum(h, dtype=np.uint64)]))
    out = {}
    for kind in KINDS:
        which = np.flatnonzero(size - 1 > kind) if kind else np.arange(len(starts))
        first = starts[which]
        last = first + kind if kind else first + size - 1
        mixed = []
        for total in sums:
            h = total[last] - total[first]
            h = (h ^ h >> np.uint64(31)) * _MULTIPLIER
            mixed.append(h ^ h >> np.uint64(32))
        out[kind] = (mixed[0] >> np.uint64(2)).astype(np.int64) | WORD_KEY, (mixed[1] >> np.uint64(22)).astype(np.int64) << BITS | kind, which
    return out


def _counted(hi: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different (hi, lo), and how often each stands there."""
    if len(hi) and hi[0] >= WORD_KEY:  # hashes
        order = np.lexsort((lo, hi))
        hi, lo = hi[order], lo[order]
        first = np.flatnonzero(np.concatenate([[True], (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1])]))
        return hi[first], lo[first], np.diff(np.append(first, len(hi)))
    held = np.zeros(ANY, bool)
    held[lo & ANY] = held[0] = True
    letters, rank = np.flatnonzero(held), np.cumsum(held) - 1
    width = len(letters).bit_length()
    if 5 * width < 64:  # few letters: one number for all five
        packed = np.zeros(len(hi), np.int64)
        for code, shift in ((hi, BITS), (hi, 0), (lo, 2 * BITS), (lo, BITS), (lo, 0)):
            packed = packed << width | rank[code >> shift & ANY]
        packed, n = np.unique(packed, return_counts=True)
        a, b, c, d, e = (letters[packed >> width * k & ((1 << width) - 1)] for k in (4, 3, 2, 1, 0))
        return a << BITS | b, c << 2 * BITS | d << BITS | e, n
    his, at = np.unique(hi, return_inverse=True)
    los, low = np.unique(lo, return_inverse=True)
    keys, n = np.unique(at * len(los) + low, return_counts=True)
    return his[keys // len(los)], los[keys % len(los)], n


def letter_counts(rows: DataFrame, text_col: str, label_col: str, part_col: str) -> DataFrame:
    """(hi, lo, toxic, ordinary, toxic_0, ordinary_0): how often each 5-gram, and each expression that toxic rows hold, stands in
    rows of either class, in all and in those of part 0. Expressions of hash 0 tell how many there are of a kind in all."""
    texts = rows.select(F.col(text_col).alias("text"), F.col(label_col).alias("label"), F.col(part_col).alias("part"))

    def first_pass(codes, label):
        return [codes[:2], _expressions(word_codes(*codes))] if label else [codes[:2]]

    first = cut(_summed(_counts(texts, first_pass)))
    of_words = F.col("hi") >= WORD_KEY
    sieve = texts.sparkSession.sparkContext.broadcast(_sieve(first.where(F.col("hi") > WORD_KEY)))

    def second_pass(codes, label):
        hi, lo = _expressions(word_codes(*codes))
        held = _sifted(sieve.value, hi) | (hi == WORD_KEY)
        return [(hi[held], lo[held])]

    second = _counts(texts.where("label = 0"), second_pass)
    counts = cut(first.where(~of_words).unionByName(_summed(first.where(of_words).unionByName(second))))
    sieve.destroy()
    discard(first)
    return counts


def _expressions(codes: dict[int, tuple]) -> tuple[np.ndarray, np.ndarray]:
    """All keys of a text, and for each of them one of hash 0."""
    hi, lo = (np.concatenate([codes[k][i] for k in KINDS]) for i in (0, 1))
    return np.concatenate([hi, np.full(len(hi), WORD_KEY)]), np.concatenate([lo, lo & ANY])


NAMES = ("toxic", "ordinary", "toxic_0", "ordinary_0")


def _summed(counts: DataFrame) -> DataFrame:
    return counts.groupBy(*KEY).agg(*[F.sum(c).alias(c) for c in NAMES])


def _counts(texts: DataFrame, pass_of: Callable) -> DataFrame:
    """Partial counts of what pass_of(letter codes, label) finds in (text, label, part) rows."""

    def counts_of(by: dict[tuple[int, int, int], list]) -> Iterator[pa.RecordBatch]:
        for (label, part, _), found in by.items():
            hi, lo, n = _counted(*(np.concatenate(x) for x in zip(*found, strict=True)))
            zero = np.zeros(len(n), np.int64)
            mine = (label == 1, label == 0, label == 1 and part == 0, label == 0 and part == 0)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (hi, lo, *(n if m else zero for m in mine))], [*KEY, *NAMES])

    def count(batches):
        by, letters = {}, 0
        for batch in batches:
            b = BlobReader(batch)
            for text, label, part in zip(b.list("text"), b.list("label"), b.list("part"), strict=True):
                for k, codes in enumerate(pass_of(letter_codes(text), label)):
                    by.setdefault((label, part, k), []).append(codes)
                    letters += len(codes[0])
                if letters >= COUNT_LETTERS:
                    yield from counts_of(by)
                    by, letters = {}, 0
        yield from counts_of(by)

    return map_batches(texts, count, ", ".join(f"{c} long" for c in (*KEY, *NAMES)))


def _sieve(entries: DataFrame) -> np.ndarray:
    """A bit for the hash of every expression."""
    least, most = SIEVE_BITS
    bits = min(most, max(least, 1 << (16 * entries.count()).bit_length()))
    place = F.shiftright("hi", 10).bitwiseAND(bits - 1)
    found = entries.groupBy(F.shiftright(place, 6).alias("at")).agg(
        F.bit_or(F.expr(f"shiftleft(1L, cast(shiftright(hi, 10) & {bits - 1} & 63 as int))")).alias("held")
    ).toArrow()
    sieve = np.zeros(bits >> 6, np.int64)
    sieve[found["at"].to_numpy()] = found["held"].to_numpy()
    return sieve


def _sifted(sieve: np.ndarray, hi: np.ndarray) -> np.ndarray:
    place = hi >> 10 & (len(sieve) * 64 - 1)
    return sieve[place >> 6] >> (place & 63) & 1 == 1


def _suffix(order: int) -> list:
    """The last symbols of a 5-gram, as its key."""
    hi, lo = F.col("hi"), F.col("lo")
    return [
        (hi.bitwiseAND(ANY) if order == 4 else F.lit(0).cast("long")).alias("hi"),
        (lo if order > 2 else lo.bitwiseAND((1 << BITS * order) - 1)).alias("lo"),
    ]


def log_ratios(counts: DataFrame, toxic: str = "toxic", ordinary: str = "ordinary", discount: float = DISCOUNT) -> DataFrame:
    """(hi, lo, ratio): log P_toxic - log P_ordinary of every counted 5-gram and of every expression that toxic rows hold; with ANY for
    the last letter, that of any which does not stand here after the other four."""
    every = counts.select(*KEY, F.col(toxic).alias("toxic"), F.col(ordinary).alias("ordinary")).where("toxic + ordinary > 0")
    seen = every.where(F.col("hi") < WORD_KEY)
    ctx_of = F.col("lo").bitwiseOR(ANY).alias("ctx")

    # Shared backoff: continuation counts of orders 4 to 1, each interpolated with the next shorter one. Every level is written
    # once: in one plan, a level would be counted again for each that leans on it, and the driver would plan, and describe to its
    # listeners, all of them anew after each stage.
    levels, grams = [], seen.select(*KEY)
    for order in (4, 3, 2, 1):
        grams = cut(grams.groupBy(*_suffix(order)).agg(F.count(F.lit(1)).alias("n")))
        levels.append((order, grams))
    shared = None
    for order, grams in reversed(levels):
        ctx = grams.withColumn("ctx", ctx_of)
        per = ctx.groupBy("hi", "ctx").agg(F.sum("n").alias("all"), F.count(F.lit(1)).alias("types"))
        known, lower = ctx.join(per, ["hi", "ctx"]), shared
        if lower is None:
            p = F.col("n") / F.col("all")
        else:
            hi, lo = _suffix(order - 1)
            known = known.select("*", hi.alias("_hi"), lo.alias("_lo")).join(lower, ["_hi", "_lo"])
            p = F.greatest(F.col("n") - discount, F.lit(0.0)) / F.col("all") + discount * F.col("types") / F.col("all") * F.col("_p")
        shared = cut(known.select(F.col("hi").alias("_hi"), F.col("lo").alias("_lo"), p.alias("_p")))
        for done in (grams, lower):
            if done is not None:
                discard(done)
    ctx = seen.withColumn("ctx", ctx_of)
    per = cut(
        ctx.groupBy("hi", "ctx").agg(
            *[F.sum(c).alias(f"{c}_all") for c in ("toxic", "ordinary")],
            *[F.count(F.when(F.col(c) > 0, 1)).alias(f"{c}_types") for c in ("toxic", "ordinary")],
        )
    )
    hi, lo = _suffix(4)
    known = ctx.join(per, ["hi", "ctx"]).select("*", hi.alias("_hi"), lo.alias("_lo")).join(shared, ["_hi", "_lo"])

    kind = F.col("lo").bitwiseAND(ANY).alias("kind")
    words = every.where((F.col("hi") >= WORD_KEY) & (F.col("toxic") > 0)).select("*", kind)
    listed = words.where(F.col("hi") > WORD_KEY)
    of_kind = words.groupBy("kind").agg(
        *[F.sum(F.when(F.col("hi") == WORD_KEY, F.col(c))).alias(f"{c}_all") for c in ("toxic", "ordinary")],
        *[F.count(F.when((F.col("hi") > WORD_KEY) & (F.col(c) > 0), 1)).alias(f"{c}_types") for c in ("toxic", "ordinary")],
    )
    of_words = listed.join(F.broadcast(of_kind), "kind").withColumn("_p", 1 / F.col("toxic_types"))

    def model(c: str):
        n, all_, types = F.col(c), F.col(f"{c}_all"), F.col(f"{c}_types")
        own = (F.greatest(n - discount, F.lit(0.0)) + discount * types * F.col("_p")) / F.greatest(all_, F.lit(1))
        return F.when(all_ > 0, own).otherwise(F.col("_p"))

    def backoff(c: str):
        all_ = F.col(f"{c}_all")
        return F.when(all_ > 0, discount * F.col(f"{c}_types") / F.greatest(all_, F.lit(1))).otherwise(F.lit(1.0))

    def ratio(f):
        return (F.log(f("toxic")) - F.log(f("ordinary"))).alias("ratio")

    words = of_words.select(*KEY, ratio(model)).where("ratio is not null")
    return known.select(*KEY, ratio(model)).unionByName(words).unionByName(per.select("hi", F.col("ctx").alias("lo"), ratio(backoff)))


class Block:
    """Log ratios by (hi, lo): an open-addressed table of at least twice as many places, made where it is first asked, or once for all
    tasks before it is sent."""

    def __init__(self, hi: np.ndarray, lo: np.ndarray, ratio: np.ndarray):
        self.hi, self.lo, self.ratio = hi, lo, ratio
        self.bits = (2 * len(hi)).bit_length()
        self.at = None

    def open(self) -> Block:
        self.at = np.full(1 << self.bits, -1, np.int32)
        left, at = np.arange(len(self.hi), dtype=np.int32), self._place(self.hi, self.lo)
        while len(left):
            free = self.at[at] < 0
            self.at[at[free]] = left[free]
            lost = self.at[at] != left
            left, at = left[lost], (at[lost] + 1) & (len(self.at) - 1)
        return self

    def _place(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        h = lo.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + hi.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
        h = (h ^ h >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
        return (h >> np.uint64(64 - self.bits)).astype(np.int64) if self.bits else np.zeros(len(h), np.int64)

    def find(self, hi: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ratio of every key, and whether it is there."""
        if self.at is None:
            self.open()
        ratio, there = np.zeros(len(hi), np.float32), np.zeros(len(hi), bool)
        todo, at = np.arange(len(hi)), self._place(hi, lo)
        while len(todo) and len(self.hi):
            i = self.at[at]
            same = (i >= 0) & (self.hi[i] == hi[todo]) & (self.lo[i] == lo[todo])
            ratio[todo[same]], there[todo[same]] = self.ratio[i[same]], True
            on = (i >= 0) & ~same
            todo, at = todo[on], (at[on] + 1) & (len(self.at) - 1)
        return ratio, there

    def ratios(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        out, there = self.find(hi, lo)
        rest = np.flatnonzero(~there & (hi < WORD_KEY))
        out[rest] = self.find(hi[rest], lo[rest] | ANY)[0]
        return out


def _block_of(hi, context, n: int):
    """The block of a context, of numbers and columns alike; no product passes 63 bits."""
    return (hi % 1_000_003 * 7919 + context % 1_000_003) % n


def send(learned: DataFrame, block_entries: int = BLOCK_ENTRIES) -> list:
    """Broadcasts the log ratios in blocks of about block_entries; all n-grams of a context are in one block."""
    learned = cut(learned.select(*KEY, F.col("ratio").cast("float").alias("ratio")))
    n = max(1, -(-learned.count() // block_entries))
    sent = []
    for k in range(n):
        mine = learned.where(_block_of(F.col("hi"), F.col("lo").bitwiseOR(ANY), n) == k) if n > 1 else learned
        found = mine.toArrow()
        block = Block(*(found[c].to_numpy() for c in (*KEY, "ratio")))
        # Of several blocks, workers load one after the other, many times: what they load is the table itself.
        sent.append(learned.sparkSession.sparkContext.broadcast(block.open() if n > 1 else block))
        if n > 1:
            sent[-1].__dict__.pop("_value", None)
    return sent


def ratios_of(sent: list, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
    """The log ratio of every 5-gram. Of several blocks, a worker holds one at a time."""
    if len(sent) == 1:
        return sent[0].value.ratios(hi, lo)
    out, block = np.zeros(len(hi), np.float32), _block_of(hi, lo | ANY, len(sent))
    for k, one in enumerate(sent):
        mine = np.flatnonzero(block == k)
        out[mine] = one.value.ratios(hi[mine], lo[mine])
        one.__dict__.pop("_value", None)
    return out


def described(sent: list, texts: Iterable[str | None]) -> Iterator[list[float]]:
    """The evidence of every text; some texts are looked up together."""
    held: list = []
    letters = 0

    def look_up():
        ends = np.cumsum([len(h[0]) for h in held])
        starts = np.concatenate([h[2] + e - len(h[0]) for h, e in zip(held, ends.tolist(), strict=True)]).astype(np.int64)
        hi, lo = (np.concatenate([h[k] for h in held]) for k in (0, 1))
        words = word_codes(hi, lo, starts)
        found = ratios_of(sent, np.concatenate([hi, *[words[k][0] for k in KINDS]]), np.concatenate([lo, *[words[k][1] for k in KINDS]]))
        ratio, by_kind = found[: len(hi)].astype(np.float64), np.split(found[len(hi) :], np.cumsum([len(words[k][0]) for k in KINDS])[:-1])
        by_word = np.zeros((1 + len(KINDS), len(starts)))
        for k, r in reversed(list(enumerate(by_kind))):  # of a word, the longest that is there stands
            which, there = words[KINDS[k]][2], r != 0
            by_word[0, which[there]] = by_word[1 + k, which[there]] = r[there]
        last = np.cumsum([len(h[2]) for h in held])[:-1]
        return [evidence(r, w, h[2]) for r, w, h in zip(np.split(ratio, ends[:-1]), np.split(by_word, last, axis=1), held, strict=True)]

    for text in texts:
        held.append(letter_codes(text))
        letters += len(held[-1][0])
        if letters >= CHUNK_LETTERS[len(sent) > 1]:
            yield from look_up()
            held, letters = [], 0
    if held:
        yield from look_up()


def _top(word: np.ndarray) -> list[float]:
    """The three largest of a text's words, zeros in the place of words that it lacks."""
    top = np.partition(word, -3)[-3:] if len(word) > 3 else word
    return [*np.sort(top)[::-1].tolist(), *[0.0] * (3 - len(top))]


def evidence(ratio: np.ndarray, by_word: np.ndarray, starts: np.ndarray, window: int = 4, letters: int = 5) -> list[float]:
    """What the log ratios of a text's letters say: per letter (all, largest window of words, largest run of letters, largest
    word), per word (mean), its three most toxic words, and the logarithm of its number of words; by the models of expressions
    the mean, the three most toxic words, the logarithm of how many are plainly toxic, and the most toxic one of each kind. Zeros for a text without words."""
    if not len(starts):
        return [0.0] * N_FEATURES
    word = np.add.reduceat(ratio, starts)
    size = np.diff(np.append(starts, len(ratio)))
    run = np.concatenate([[0.0], np.cumsum(ratio)])
    bounds = np.append(starts, len(ratio))
    k = min(window, len(word))
    windows = (run[bounds[k:]] - run[bounds[:-k]]) / (bounds[k:] - bounds[:-k])
    k = min(letters, len(ratio))
    return [
        float(ratio.mean()), float(windows.max()), float((run[k:] - run[:-k]).max() / k), float((word / size).max()), float(word.mean()),
        *_top(word), float(np.log1p(len(word))), float(by_word[0].mean()), *_top(by_word[0]), float(np.log1p((by_word[0] > PLAINLY).sum())),
        *by_word[1:].max(1).tolist(),
    ]


def _fit(x: np.ndarray, y: np.ndarray, rounds: int = 100, ridge: float = 1e-2) -> np.ndarray:
    """Logistic regression by Newton's method on standardised features; weights for them as they are, then the bias."""
    mean, scale = x.mean(0), x.std(0)
    scale = np.where(scale > 1e-6, scale, np.inf)  # what never varies tells nothing
    x = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return np.append(w[:-1] / scale, w[-1] - (w[:-1] * mean / scale).sum())


def score_toxicity(
    docs: DataFrame,
    train: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    carry: list[str] | None = None,
    max_calibration_rows: int = MAX_CALIBRATION_ROWS,
    block_entries: int = BLOCK_ENTRIES,
) -> DataFrame:
    """Adds score (0 to 1) and predicted (1 if score >= 0.5) to every row of docs, from its text alone.

    train: documents whose labels may be learned from; labels: (id_col, label_col) rows, of which 0 and 1 count, and 1 wins
    where an id has both. All labelled training rows teach the models that score. The calibration is on max_calibration_rows
    ids at most, of a fifth of the labels, described by models of all rows but theirs; with fewer than MIN_CALIBRATION_ROWS rows
    of a class there, or none of a class in the others, it is on rows of all labels, described by models of all. With labels of one class only, or none, nothing is learned, and the score is 1 / (1 + exp(3 - top / 2)), top being the
    largest of 0 and the text's words' log ratios. Null and wordless texts bear no evidence: the score of a text whose
    features are all 0. Repeated rows are scored each; an empty table gives no rows; columns that bear a new name are replaced.
    """
    spark = docs.sparkSession
    new = ("score", "predicted")
    carry = [c for c in (docs.columns if carry is None else carry) if c.lower() not in new]
    text_at = fresh(docs, "_text")
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(
        F.max(label_col).cast("int").alias("label")
    )
    texts = train.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.col("text").isNotNull())

    def some(of: DataFrame) -> DataFrame:
        return of.orderBy(F.xxhash64("id", F.lit(1)), "id").limit(max_calibration_rows)

    chosen = cut(some(known.where(F.pmod(F.xxhash64("id"), F.lit(5)) == 0)))
    part = F.coalesce("part", F.lit(0)).alias("part")
    parted = join_bounded(known, chosen.select("id", F.lit(1).alias("part")), "id", "left").select("id", "label", part)
    counts = letter_counts(join_bounded(texts, parted, "id", "inner"), "text", "label", "part")
    sent = send(log_ratios(counts), block_entries)

    def described_rows(by: list, which: DataFrame) -> tuple[np.ndarray, np.ndarray]:
        def describe(batches):
            for batch in batches:
                b = BlobReader(batch)
                x = list(described(by, b.list("text")))
                yield pa.RecordBatch.from_arrays([*b.keep(["label"]), pa.array(x, pa.list_(pa.float64()))], ["label", "x"])

        sample = join_bounded(texts, which, "id", "inner")
        found = map_batches(sample.select("label", "text"), describe, "label int, x array<double>").collect()
        return np.array([r["x"] for r in found]).reshape(-1, N_FEATURES), np.array([r["label"] for r in found], float)

    y = np.empty(0)
    others = counts.agg(F.sum("toxic_0"), F.sum("ordinary_0")).first()
    if all(others):
        by = send(log_ratios(counts, "toxic_0", "ordinary_0"), block_entries)
        x, y = described_rows(by, chosen)
        for block in by:  # no later task reads them
            block.destroy()
    if min((y == 0).sum(), (y == 1).sum()) < MIN_CALIBRATION_ROWS:
        x, y = described_rows(sent, some(known))
    if len(set(y.tolist())) == 2:
        weights = _fit(x, y)
    else:
        weights = np.array([0.0] * 5 + [0.5] + [0.0] * (N_FEATURES - 6) + [-3.0])

    def score(batches):
        for batch in batches:
            b = BlobReader(batch)
            x = np.array(list(described(sent, b.list(text_at)))).reshape(-1, N_FEATURES)
            s = 1 / (1 + np.exp(-np.clip(x @ weights[:-1] + weights[-1], -30, 30)))
            yield pa.RecordBatch.from_arrays(
                [*b.keep(carry), pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32))], [*carry, *new]
            )

    return map_batches(
        docs.select(*carry, F.col(text_col).alias(text_at)),
        score,
        with_fields(docs, carry, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())),
    )


def trains(id_col: str = "doc_id"):
    """crc32(doc_id as text) mod 5 is not 0; false for a null id."""
    return F.coalesce(bucket(id_col, 5) != 0, F.lit(False))
