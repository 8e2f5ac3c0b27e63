"""Ties, clashes, empty tables and very long texts of every operator; language identification by brute force."""

import re
from collections import Counter

from pyspark.sql import functions as F

from quillnet.llm.jaccard import jaccard_components
from quillnet.llm.language import identify_languages
from quillnet.llm.packing import pack_sequences
from quillnet.llm.tokens import encoded_lengths, length_histogram

LONG = " ".join(f"w{k}" for k in range(60_000))


def _grams(text):
    out = []
    words = re.findall(r"[^\W\d_]+", text.lower())
    for w in words:
        out += [(c,) for c in w]
        padded = "\0" + w + "\0"
        out += [tuple(padded[k : k + n]) for n in (2, 3) for k in range(len(padded) - n + 1)]
    return out


def _ranked(grams, k):
    # Ties go by the n-gram's code: shorter ones first, then by letters.
    n = Counter(grams)
    return sorted(n, key=lambda g: (-n[g], len(g) if len(g) < 3 else 0, [ord(c) for c in g]))[:k]


def language_by_brute_force(texts, train, k=400):
    """The nearest language and 1 - its share of the largest distance; ranks of equal counts by code."""
    profiles = {}
    for lang in sorted({x for _, x in train}):
        profiles[lang] = {g: i for i, g in enumerate(_ranked([g for t, x in train if x == lang for g in _grams(t or "")], k))}
    out = []
    for t in texts:
        own = _ranked(_grams(t or ""), k)
        if not own or not profiles:
            out.append(("und", 0.0))
            continue
        far = {x: sum(min(abs(p[g] - i), k) if g in p else k for i, g in enumerate(own)) for x, p in profiles.items()}
        best = min(far, key=lambda x: (far[x], x))
        out.append((best, 1 - far[best] / (k * len(own))))
    return out


def test_language_by_brute_force(spark, docs):
    import duckdb

    rows = duckdb.sql("SELECT text, lang FROM '/root/testdata/sf0.001/documents.parquet' WHERE lang IS NOT NULL ORDER BY doc_id").fetchall()
    texts, langs = [r[0] for r in rows], [r[1] for r in rows]
    train = spark.createDataFrame([(k, t, x) for k, (t, x) in enumerate(rows)], "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in identify_languages(train.withColumn("lang", F.lit(None).cast("string")), train).collect()}
    want = language_by_brute_force(texts, list(zip(texts, langs, strict=True)))
    assert [got[k]["lang_pred"] for k in range(len(rows))] == [w[0] for w in want]
    assert max(abs(got[k]["score"] - w[1]) for k, w in enumerate(want)) < 1e-9


def test_language_ties_clashes_and_no_rows(spark, docs):
    train = docs("same text", lang="zz").unionByName(docs("same text", lang="aa"))
    odd = docs("same text", LONG).select("*", *[F.lit("q").alias(c) for c in ("_text", "Score", "gram", "rank", "n")])
    rows = identify_languages(odd, train).collect()
    assert rows[0]["lang_pred"] == "aa" and {r["gram"] for r in rows} == {"q"} and len(rows) == 2
    assert identify_languages(odd.limit(0), train).count() == 0


def test_jaccard_of_long_and_clashing(spark, docs):
    d = docs(LONG, LONG + " end", LONG.replace("w7 ", "x ", 1), "a b c d e", None, "").select("*", *[F.lit("q").alias(c) for c in ("id", "_digest", "n_shingles", "rep", "cid", "component", "token")])
    r = {x["doc_id"]: x for x in jaccard_components(d, per_message=50_000, per_range=20_000, block_shingles=100_000).collect()}
    assert [r[k]["component_id"] for k in range(6)] == [0, 0, 0, 3, 4, 5] and [r[k]["n_links"] for k in range(6)] == [2, 2, 2, 0, 0, 0]


def test_histogram_gaps(spark, docs):
    odd = docs("a", None).select("*", F.lit(5).alias("N_tokens"), F.lit(1).alias("_text"))
    assert sorted(r["n_tokens"] for r in encoded_lengths(odd).collect()) == [0, 1]
    lengths = spark.createDataFrame([(None,), (3,), (3,), (5000,)], "n_tokens long")
    assert {(r["n_tokens"], r["n_docs"], r["docs_longer"]) for r in length_histogram(lengths).collect()} == {(3, 2, 1), (5000, 1, 0)}
    assert length_histogram(encoded_lengths(docs("a").limit(0), carry=[])).count() == 0
    assert encoded_lengths(docs("word " * 500_000), carry=[]).first()["n_tokens"] == 500_001


def test_packing_of_many_short_items(spark):
    items = spark.range(5000).select("id", F.lit(1).alias("length"), F.lit("x").alias("members"), F.lit(2).alias("fill"))
    rows = pack_sequences(items, 100).collect()
    assert len({r["sequence_id"] for r in rows}) == 50 and {r["members"] for r in rows} == {"x"}
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append(r["offset"])
    assert all(sorted(x) == list(range(100)) for x in by.values())


def test_packing_replaces_new_names_in_any_case(spark):
    from quillnet.llm.packing import pack_documents, pack_sequences

    items = spark.createDataFrame([(1, 5, 7, 8), (2, 3, 7, 8)], "id long, length long, Offset long, Sequence_ID long")
    made = pack_sequences(items, limit=8)
    assert made.columns == ["id", "length", "sequence_id", "offset"] and sorted(r["offset"] for r in made.collect()) in ([0, 3], [0, 5])
    docs = spark.createDataFrame([(1, "a b", 0, 0)], "doc_id long, text string, Piece int, IDS int")
    assert pack_documents(docs, carry=["doc_id", "Piece", "IDS"]).count() == 1
