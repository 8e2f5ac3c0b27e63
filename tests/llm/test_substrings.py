import hashlib
import random

import numpy as np
import pytest

from quillnet.llm.fmindex import BitRank, FMIndex, WaveletMatrix, suffix_array, word_ids
from quillnet.llm.substrings import passages, plain, remove_repeats, without_spans

SCHEMA = "doc_id long, text string, n_words string, tag string"
EMPTY = hashlib.sha256(b"").hexdigest()


def brute(texts, window):
    words = [(t or "").encode().split() for t in texts]
    count = {}
    for w in words:
        for i in range(len(w) - window + 1):
            g = tuple(w[i : i + window])
            count[g] = count.get(g, 0) + 1
    out = []
    for w in words:
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if count[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return out


def corpus(rng, n, vocabulary, longest, passage):
    shared = [[rng.choice(vocabulary) for _ in range(passage)] for _ in range(4)]
    texts = []
    for _ in range(n):
        w = [rng.choice(vocabulary) for _ in range(rng.randrange(longest))]
        for _ in range(rng.randrange(3)):
            at = rng.randrange(len(w) + 1)
            s = rng.choice(shared)
            a = rng.randrange(len(s) // 2)
            w[at:at] = s[a : a + rng.randrange(len(s))]
        texts.append(rng.choice([" ", "\n", " \t"]).join(w))
    return texts + texts[:5] + [None, "", " \n", "one", "x" * 300_000, "é " * 40]


def run(spark, texts, **options):
    df = spark.createDataFrame([(i, t, "old", "t") for i, t in enumerate(texts)], SCHEMA).repartition(6)
    rows = sorted(remove_repeats(df, **options).collect(), key=lambda r: r["doc_id"])
    assert len(rows) == len(texts)
    for r in rows:
        assert sum(s["end"] - s["first"] for s in r["spans"]) == r["n_removed"]
    return [(r["n_words"], r["n_removed"], r["kept_sha256"]) for r in rows]


@pytest.mark.parametrize("words,options", [(400, {}), (3, {}), (400, {"shard_passages": 3, "hot_passages": 3}), (12, {"shard_passages": 1, "hot_passages": 1, "anchor": 2}), (50, {"anchor": 6})])
def test_brute_force(spark, words, options):
    texts = corpus(random.Random(words), 60, [f"w{i}" for i in range(words)], 60, 40)
    assert run(spark, texts, window=12, **{"anchor": 4, **options}) == brute(texts, 12)


def test_window_of_35_and_near_misses(spark):
    rng = random.Random(1)
    base = [f"t{rng.randrange(10**6)}" for _ in range(200)]
    texts = [" ".join(base), " ".join(base[:34]), " ".join(base[50:85]), " ".join([*base[120:154], "other", *base[155:189]]), "a " * 36, "a " * 35]
    assert run(spark, texts) == brute(texts, 35)


def test_one_text_is_most_of_the_table_and_a_common_line(spark):
    rng = random.Random(2)
    word = lambda: f"v{rng.randrange(10**5)}"
    line = [word() for _ in range(10)]
    same = " ".join(word() for _ in range(60))
    texts = [same] * 200 + [" ".join([*(word() for _ in range(9)), *line, *(word() for _ in range(9))]) for _ in range(200)]
    texts += texts[-3:]
    assert run(spark, texts, window=12, anchor=4, shard_passages=40, hot_passages=40) == brute(texts, 12)


def test_empty_table_and_kept_text(spark):
    df = spark.createDataFrame([(1, " a  b c d ", "x", "t"), (2, "z a b c y", "x", "t")], SCHEMA)
    assert remove_repeats(df.limit(0)).count() == 0
    made = remove_repeats(df, window=3, anchor=2)
    assert made.columns == ["doc_id", "text", "tag", "n_words", "n_removed", "spans", "kept_sha256"]
    assert {r["doc_id"]: r["text"] for r in without_spans(made).collect()} == {1: "d", 2: "z y"}


def test_equal_windows_have_equal_anchors():
    rng = random.Random(4)
    words = [rng.choice("abc") for _ in range(400)]
    hot = np.zeros(0, np.int64)
    one = passages([" ".join(words).encode()], 9, 3, hot)
    split = passages([" ".join(words).encode()], 9, 3, np.unique(one.anchor))
    for found in (one, split):
        at, tied = {}, 0
        for first, n, a in zip(found.first, found.windows, found.anchor, strict=True):
            for i in range(first, first + n):
                g = tuple(words[i : i + 9])
                tied += g in at
                assert at.setdefault(g, a) == a
        assert sum(found.windows) == 392 and tied
    assert set(split.windows) == {1}


def test_rank_and_order():
    rng = np.random.default_rng(3)
    bits = rng.integers(0, 2, 1000).astype(np.uint8)
    ask = np.arange(1001)
    assert (BitRank(bits).rank(ask) == np.concatenate([[0], np.cumsum(bits)])).all()
    s = rng.integers(0, 37, 700)
    m = WaveletMatrix(s, 37)
    for c in (0, 5, 36):
        assert (m.rank(np.full(701, c), np.arange(701)) == np.concatenate([[0], np.cumsum(s == c)])).all()
    t = np.concatenate([rng.integers(1, 3, 300), [0]])
    assert suffix_array(t).tolist() == sorted(range(301), key=lambda i: t[i:].tolist())


def test_matching_statistics_by_brute_force():
    rng = random.Random(6)
    texts = [[rng.choice("abcd") for _ in range(rng.randrange(1, 30))] for _ in range(40)]
    weights = np.array([rng.choice([1, 1, 2]) for _ in texts])
    ids, lengths = word_ids([" ".join(t).encode() for t in texts])
    index = FMIndex(ids, lengths, weights)
    found = index.matching_statistics(4)
    for k, t in enumerate(texts):
        for i in range(len(t)):
            longest = 0
            for n in range(1, len(t) - i + 1):
                if sum(int(w) * sum(u[j : j + n] == t[i : i + n] for j in range(len(u) - n + 1)) for u, w in zip(texts, weights, strict=True)) >= 2:
                    longest = n
            got = int(found[index.start[k] + i])
            assert got == longest if longest >= 4 else got < 4, (k, i)


def test_plain():
    assert plain(b" a\x0b\x0cb\r\n\tc\xc2\xa0d\x1ce ") == b"a b c\xc2\xa0d\x1ce" and plain(None) == b""
