import zlib

import duckdb
import pytest
from oracle import rows_of, sql_rows

from quillnet.llm.queries import QUERIES
from quillnet.llm.sql import ORACLES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    df = QUERIES[name](spark, SF)
    assert rows_of(df) == sql_rows(ORACLES[name], SF, df.columns)


def test_packing_round_trip(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = dict(duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall())
    rows = QUERIES["op3_packing"](spark, SF).collect()
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_seq.setdefault(r["sequence_id"], []).append(r)
    assert set(by_doc) == set(texts)
    for i, parts in by_doc.items():
        ids = [*t.encode(texts[i], add_special_tokens=False).ids, 2]
        at = 0
        for k, r in enumerate(sorted(parts, key=lambda r: r["piece"])):
            assert (r["piece"], r["start"]) == (k, at) and (k == 0 or r["length"] == 1024)
            assert r["ids_crc32"] == zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids[at : at + r["length"]]))
            at += r["length"]
        assert at == len(ids) and (len(parts) == 1 or len(ids) > 1024)
    for parts in by_seq.values():
        at = 0
        for r in sorted(parts, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 1024
    total = sum(r["length"] for r in rows)
    assert len(by_seq) <= -(-total // 1024) * 1.02 + 1


def test_token_histogram_by_brute_force(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = [r[0] for r in duckdb.sql(f"SELECT text FROM '{SF}/documents.parquet'").fetchall()]
    n = [len(t.encode(x, add_special_tokens=False).ids) for x in texts]
    rows = QUERIES["op5_token_counts"](spark, SF).collect()
    assert sum(r["n_docs"] for r in rows) == len(n)
    for r in rows:
        at = r["n_tokens"]
        assert r["n_docs"] == n.count(at) and r["docs_longer"] == sum(x > at for x in n)
        assert r["truncated_tokens"] == sum(min(x, at) for x in n) and r["total_tokens"] == sum(n)


def _labels():
    return {i: (q, t) for i, q, t in duckdb.sql("SELECT * FROM '/root/testdata/sf0.1/labels.parquet'").fetchall()}


def test_language_held_out_accuracy(spark):
    lang = dict(duckdb.sql("SELECT doc_id, lang FROM '/root/testdata/sf0.01/documents.parquet'").fetchall())
    rows = [r for r in QUERIES["op2_language"](spark, "/root/testdata/sf0.01").collect() if r["held_out"]]
    assert rows and sum(r["lang_pred"] == lang[r["doc_id"]] for r in rows) / len(rows) > 0.98
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_toxicity_and_quality_held_out(spark):
    known = _labels()
    lang = dict(duckdb.sql("SELECT doc_id, lang FROM '/root/testdata/sf0.1/documents.parquet'").fetchall())
    tox = [(lang[r["doc_id"]], known[r["doc_id"]][1], r["predicted"]) for r in QUERIES["op9_toxicity"](spark, "/root/testdata/sf0.1").collect() if r["held_out"] and r["doc_id"] in known]
    for one in {x for x, _, _ in tox}:
        bad = [p for x, t, p in tox if x == one and t == 1]
        fine = [p for x, t, p in tox if x == one and t == 0]
        assert len(bad) < 5 or sum(bad) / len(bad) >= 0.8, (one, sum(bad), len(bad))
        assert sum(fine) / len(fine) <= 0.05, (one, sum(fine), len(fine))
    good = [(r["predicted"], known[r["doc_id"]][0]) for r in QUERIES["op7_quality"](spark, "/root/testdata/sf0.1").collect() if r["held_out"] and r["doc_id"] in known]
    assert sum(p == t for p, t in good) / len(good) > 0.97


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline as c

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for k, (name, f) in enumerate(c.STAGES):
        f(spark, docs, SF).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        if k < 4:
            assert docs.columns == columns, name
            assert docs.select("doc_id").distinct().count() == docs.count() <= before
            before = docs.count()
    assert docs.select("doc_id").distinct().count() == before > 100
