"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns; each against its stated result."""

import random

import pytest
from oracle import sql_rows
from pyspark.sql import functions as F

from quillnet.llm.decontaminate import decontaminate
from quillnet.llm.embeddings import embedding_links
from quillnet.llm.jaccard import jaccard_components
from quillnet.llm.language import identify_languages
from quillnet.llm.licenses import scan_licenses
from quillnet.llm.packing import pack_documents, pack_sequences
from quillnet.llm.quality import score_quality
from quillnet.llm.sql import _SETS, OP10
from quillnet.llm.tokens import Encoder, at_limit, encoded_lengths, length_histogram, length_quantile, tokenizer_path
from quillnet.llm.toxicity import score_toxicity
from quillnet.llm.urls import filter_urls

ODD = ("", None, "   ", "!!!", "A" * 200_000, "é ü", "one two three", "one two three")
TEN = "alpha beta gamma delta epsilon zeta eta theta iota kappa"


def test_decontamination_spans_and_blocks(spark, docs):
    d = docs(f"xx {TEN.upper()}, yy", "Short-item", *ODD)
    b = spark.createDataFrame([(1, TEN + " lambda"), (2, "short item"), (3, ""), (4, None), (None, "yy")], "item_id long, text string")
    for size in (32_000_000, 40):
        r = {x["doc_id"]: x for x in decontaminate(d, b, block_bytes=size).collect()}
        assert r[0]["items"] == ["1"] and r[0]["n_hit"] == 10
        s = r[0]["spans"][0]
        assert r[0]["text"][s["start"] : s["end"]] == TEN.upper()
        assert r[1]["items"] == ["2"] and r[1]["contaminated"]
        assert not any(r[k]["contaminated"] for k in range(2, 10)) and r[3]["n_words"] == 0
    assert not decontaminate(d, b.limit(0)).where("contaminated").count()
    assert decontaminate(d.limit(0), b).count() == 0
    assert decontaminate(d.withColumn("n_words", F.lit("old")), b).schema["n_words"].dataType.simpleString() == "bigint"


def test_decontamination_of_many_blocks_against_brute_force(spark, docs):
    """Repeated items, items that share windows, and ids in the order of strings; one block and many say the same."""
    rng = random.Random(11)
    words = [f"w{k}" for k in range(60)]
    items = [(k, " ".join(rng.choices(words, k=rng.choice((0, 2, 5, 14, 30))))) for k in range(40)]
    items += items[:6] + [(100 + k, t) for k, t in items[:9]]
    texts = [" ".join(rng.choices(words, k=80)) for _ in range(20)]
    for k in range(12):
        w, cut = texts[k].split(), " ".join(items[rng.randrange(40)][1] for _ in range(3)).split()
        texts[k] = " ".join(w[:20] + cut + w[20:])
    want = {}
    for d, text in enumerate(texts):
        w, hit, found = text.split(), set(), set()
        for i, t in items:
            b = t.split()
            for a in range(max(1, len(b) - 9)) if b else ():
                win = b[a : a + 10]
                at = [x for x in range(len(w) - len(win) + 1) if w[x : x + len(win)] == win]
                found |= {str(i)} if at else set()
                hit |= {x + y for x in at for y in range(len(win))}
        want[d] = (len(w), len(hit), sorted(found))
    b = spark.createDataFrame(items, "item_id long, text string").repartition(3)
    assert sum(len(v[2]) for v in want.values()) > 20
    for size in (3_000_000, 6000, 2500):
        got = decontaminate(docs(*texts), b, block_bytes=size).collect()
        assert {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"]) for r in got} == want


def test_a_block_reads_its_own_windows(spark):
    from quillnet.llm.decontaminate import _blocks, windows

    b = spark.createDataFrame([(k, " ".join(f"w{k}x{j}" for j in range(30))) for k in range(200)], "item_id long, text string")
    grams = windows(b)
    held, n = _blocks(grams, 50_000)
    assert n > 3 and [r[0] for r in held.select("block").distinct().orderBy("block").collect()] == list(range(n))
    assert held.count() == grams.select("phrase").distinct().count()
    assert "PushedFilters: [IsNotNull(block), EqualTo(block,1)]" in held.where("block = 1")._jdf.queryExecution().toString()
    assert _blocks(grams.limit(0), 50_000)[1] == 1


def test_language_cases(spark, docs):
    train = docs(*["the and of that with this for"] * 3).unionByName(docs(*["der die das und nicht mit für"] * 3, lang="de"))
    r = {x["doc_id"]: x for x in identify_languages(docs(*ODD, "und das mit der", "1234 !"), train, carry=["doc_id"]).collect()}
    assert r[8]["lang_pred"] == "de"
    assert [r[k]["lang_pred"] for k in (0, 1, 2, 3, 9)] == ["und"] * 5 and r[1]["score"] == 0
    none = identify_languages(docs("some text"), train.limit(0)).first()
    assert none["lang_pred"] == "und"


def test_encoder_is_exact():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    e, rng = Encoder(tokenizer_path()), random.Random(3)
    assert e.fast is not None
    # Every token is reached from its own bytes: then merging by rank is merging by the file's list.
    assert all([x.id for x in t.model.tokenize(s)] == [k] for s, k in t.get_vocab().items() if s != "<|endoftext|>")
    for odd in (" " * 40_000, "a" + "\n" * 30_000 + "b", "x" * 50_000 + "<|endoftext|>", "\t" * 1500 + "é" * 3000):
        assert e.ids(odd) == t.encode(odd, add_special_tokens=False).ids
    parts = ["a", "The", "don't", "é", "ß", "12", "3.5", "\n", "\t", " ", "  ", "   ", "\u00a0", "!!", "漢字", "<|endoftext|>", "\r\n", "x_y", "'s", "\u3000"]
    for _ in range(300):
        texts = ["".join(rng.choice(parts) + rng.choice(["", " ", " "]) for _ in range(rng.randrange(12))) for _ in range(5)]
        import numpy as np

        got = [np.frombuffer(x, "<u4").tolist() for x in e.encode(texts)]
        assert got == [t.encode(x, add_special_tokens=False).ids for x in texts]


def test_packing_cases(spark, docs):
    r = pack_documents(docs(*ODD), limit=64, carry=["doc_id"]).collect()
    assert {x["doc_id"] for x in r} == set(range(8)) and max(x["length"] for x in r) == 64
    clash = docs("a b", None).select("*", F.lit("x").alias("length"), F.lit("y").alias("ids_crc32"), F.lit(0).alias("Piece"))
    assert sorted(x["length"] for x in pack_documents(clash).collect()) == [1, 3]
    assert pack_documents(docs("a").limit(0)).count() == 0
    big = pack_documents(docs("word " * 1_000_000), carry=["doc_id"]).collect()
    assert sum(x["length"] for x in big) == 1_000_002 and all(x["length"] == 1024 for x in big if x["piece"])
    items = spark.createDataFrame([(1, 5, "x"), (2, None, "x"), (3, 0, "x"), (4, 99, "x"), (5, 10, "x")], "k int, length int, offset string")
    got = {x["k"]: x for x in pack_sequences(items, 10).collect()}
    assert [got[k]["sequence_id"] is None for k in (1, 2, 3, 4, 5)] == [False, True, True, True, False]
    assert pack_sequences(items.limit(0), 10).count() == 0


def test_many_rounds_of_packing(spark):
    rng = random.Random(1)
    sizes = [rng.randrange(1, 100) for _ in range(3000)]
    items = spark.createDataFrame(list(enumerate(sizes)), "k int, length int").repartition(30)
    for least, slack in ((1, 1.06), (20_000, 1.02)):
        rows = pack_sequences(items, 100, fan_in=3, min_items=least).collect()
        assert sorted(r["k"] for r in rows) == list(range(3000))
        assert len({r["sequence_id"] for r in rows}) <= -(-sum(sizes) // 100) * slack + 1


def test_histogram_cases(spark, docs):
    h = length_histogram(encoded_lengths(docs("a b c", "a", "a", None, ""), carry=[]), stride=2)
    assert {r["n_tokens"]: r["n_docs"] for r in h.collect()} == {0: 2, 1: 2, 3: 1}
    assert at_limit(h, 2).first().asDict() == {"context_limit": 2, "total_docs": 5, "docs_longer": 1, "truncated_tokens": 4, "cut_tokens": 1}
    assert length_quantile(h, 0.8).first()[0] == 1
    assert at_limit(h.limit(0), 2).first()["total_docs"] == 0


def test_license_cases(spark, docs):
    d = docs("Licensed under CC BY-NC 4.0.", "general public\nlicense; CC BY cc by", *ODD)
    r = {x["doc_id"]: x for x in scan_licenses(d).collect()}
    assert r[0]["labels"] == "cc-by,cc-by-nc-4.0" and r[0]["base_labels"] == "cc-by"
    assert (r[1]["n_base"], r[1]["first_word"], r[1]["last_word"], r[1]["base_labels"]) == (3, 0, 5, "cc-by,gpl")
    assert r[2]["labels"] == "" and r[3]["score"] == 0 and r[3]["first_word"] is None


@pytest.mark.parametrize("block", [2000, 4])
def test_jaccard_by_brute_force(spark, tmp_path, block):
    rng = random.Random(5)
    words = [f"w{k}" for k in range(400)]
    rows, i = [], 0
    for _ in range(6):
        base = [rng.choice(words) for _ in range(rng.randrange(30, 90))]
        for _ in range(12):
            t = list(base)
            for _ in range(rng.randrange(0, 3)):
                t[rng.randrange(len(t))] = rng.choice(words)
            rows.append((i, " ".join(t)))
            i += 1
    rows += [(i + k, t) for k, t in enumerate(("", None, " \t", "a b", "A  b", "c", "a b c d"))]
    rows += [(500, rows[0][1]), (501, rows[0][1])]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    d.write.parquet(f"{tmp_path}/documents.parquet")
    got = jaccard_components(d.repartition(3), per_message=500, per_range=100, block=block)
    sql = f"WITH RECURSIVE {_SETS.format(docs='documents')} SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, coalesce(n.n, 0)::BIGINT AS n_links, component_id FROM s JOIN comp ON s.doc_id = comp.id LEFT JOIN (SELECT a, count(*) AS n FROM e GROUP BY a) n ON n.a = s.doc_id"
    cols = ["doc_id", "n_shingles", "n_links", "component_id"]
    assert sorted(repr(tuple(r[c] for c in sorted(cols))) for r in got.collect()) == sql_rows(sql, str(tmp_path), cols)


def test_jaccard_null_ids_and_nothing(spark):
    d = spark.createDataFrame([(None, "a b c d e"), (7, "a b c d e"), (7, "a b c d e"), (3, "x y z w v")], "doc_id long, text string")
    got = {(r["doc_id"], r["component_id"], r["n_links"]) for r in jaccard_components(d).collect()}
    assert got == {(None, None, 0), (7, 7, 1), (3, 3, 0)}
    assert jaccard_components(d.limit(0)).count() == 0


def test_url_cases(spark):
    urls = ["http://a.COM/fr/x?q", "no scheme", None, "x://", "https://b.org", "http://b.example.org/en/12", "http://com/de/1#f", "a://b?c/d"]
    d = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("host", F.lit("old"))
    r = {x["page_id"]: x for x in filter_urls(d).collect()}
    assert (r[0]["host"], r[0]["path"], r[0]["rule"], r[0]["verdict"]) == ("a.com", "/fr/x", "com/fr/", "allow")
    assert [r[k]["host"] for k in (1, 2, 3, 4, 7)] == ["", "", "", "b.org", "b"]
    assert (r[5]["rule"], r[5]["verdict"]) == ("example.org/en/1", "block") and r[6]["verdict"] == "block" and r[4]["rule"] is None
    assert filter_urls(d.limit(0)).count() == 0


def test_toxicity_and_quality_cases(spark, docs):
    calm, rude = ["the cat sat on the mat near a door"] * 30, ["the awful zorgblat sat on the zorgblat"] * 30
    d = docs(*calm, *rude)
    labels = spark.createDataFrame([(k, 1, int(k >= 30)) for k in range(60)] + [(None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    r = {x["doc_id"]: x for x in score_toxicity(docs(*ODD, "zorgblat zorgblat mat", "the cat sat on a mat"), d, labels).collect()}
    assert len(r) == 10 and all(0 <= x["score"] <= 1 for x in r.values()) and r[8]["score"] > r[9]["score"]
    assert score_toxicity(docs(*ODD), d, labels.limit(0)).count() == 8
    q = score_quality(docs(*ODD).drop("source", "lang"), d.drop("source", "lang"), labels).collect()
    assert len(q) == 8 and {x["score"] for x in q} == {0.5}
    assert score_quality(docs(*ODD).limit(0), d, labels).count() == 0


def test_embedding_cases(spark, tmp_path):
    rng = random.Random(2)
    base = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(4)]
    rows = []
    for k in range(150):
        rows.append((k, [x + rng.gauss(0, 0.35) for x in base[k % 4]], k % 2))
    rows += [(200, rows[0][1], 0), (201, rows[0][1], 1), (202, [0.0] * 8, 0), (203, None, 0), (204, [1.0, None] + [0.0] * 6, 0), (205, [float("nan")] * 8, 0), (206, rows[0][1], None)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    d.write.parquet(f"{tmp_path}/embeddings.parquet")
    got = embedding_links(d.repartition(3), block_rows=16, rows_per_task=60).drop("embedding", "label")
    assert sorted(repr(tuple(r[c] for c in sorted(got.columns))) for r in got.collect()) == sql_rows(OP10, str(tmp_path), got.columns)
    assert embedding_links(d.limit(0)).count() == 0
    clash = d.select("*", *[F.lit("x").alias(c) for c in ("component", "_links", "_id", "_cid", "rep", "key", "Kept", "dim")])
    same = embedding_links(clash, block_rows=50)
    assert {r["component"] for r in same.collect()} == {"x"}
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in same.collect()) == sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in got.collect())
    long = spark.createDataFrame([(k, [float(k % 7 == j % 7) for j in range(210)], 1) for k in range(30)], d.schema)
    assert {r["n_links"] for r in embedding_links(long).collect()} == {3, 4}
    odd = spark.createDataFrame([(None, [1.0, 0.0], 1), (4, [1.0, 0.0], 1), (5, [2.0, 0.0, 0.0], 1), (6, [], 1)], d.schema)
    assert {(r["vec_id"], r["n_links"], r["component_id"]) for r in embedding_links(odd).collect()} == {(None, 0, None), (4, 0, 4), (5, 0, 5), (6, 0, 6)}
