"""Every stage of the pipeline against brute force or SQL over its own input, and over odd tables."""

import duckdb
import pytest
from oracle import sql_rows
from pyspark.sql import functions as F
from test_gaps import language_by_brute_force

import corpus_pipeline as c
from quillnet.llm.sql import _SETS, OP1

SF = "/root/testdata/sf0.001"


def _rows(df):
    return sorted(repr(tuple(r)) for r in df.collect())


def test_stages_by_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = docs.orderBy("doc_id").collect()
    pred = language_by_brute_force([r["text"] for r in rows], [(r["text"], r["lang"]) for r in rows if r["lang"] is not None and r["text"] is not None])
    want = {r["doc_id"] for r, (x, s) in zip(rows, pred, strict=True) if x != "und" and s >= c.MIN_LANGUAGE_SCORE}
    docs = c.language(spark, docs, SF)
    assert {r["doc_id"] for r in docs.collect()} == want and len(want) > 100

    docs.write.parquet(f"{tmp_path}/1")
    before = spark.read.parquet(f"{tmp_path}/1")
    after = c.toxicity(spark, before, SF)
    after.write.parquet(f"{tmp_path}/2")
    after = spark.read.parquet(f"{tmp_path}/2")
    toxic = duckdb.sql(f"SELECT doc_id FROM '{SF}/labels.parquet' WHERE toxic = 1").fetchall()
    gone = {r[0] for r in before.select("doc_id").collect()} - {r[0] for r in after.select("doc_id").collect()}
    assert len({t for (t,) in toxic} & gone) >= 0.7 * len({t for (t,) in toxic} & want) and len(gone) < 0.25 * len(want)

    near = c.near_duplicates(spark, after, SF)
    near.write.parquet(f"{tmp_path}/3")
    sets = _SETS.format(docs=f"'{tmp_path}/2/*.parquet'").replace("len(w) < 4", "len(w) < 5").replace("len(w) - 2)", "len(w) - 3)").replace("i + 3", "i + 4").replace("85 *", "80 *")
    kept = duckdb.sql(f"WITH RECURSIVE {sets} SELECT id FROM comp WHERE id = component_id").fetchall()
    near = spark.read.parquet(f"{tmp_path}/3")
    assert {r["doc_id"] for r in near.collect()} == {k for (k,) in kept}

    clean = c.decontamination(spark, near, SF)
    clean.write.parquet(f"{tmp_path}/documents.parquet")
    hit = duckdb.sql(OP1.replace("FROM documents)", f"FROM '{tmp_path}/3/*.parquet')").replace("FROM benchmark", f"FROM '{SF}/benchmark.parquet'")).fetchall()
    clean = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert {r["doc_id"] for r in clean.collect()} == {r[0] for r in hit if not r[5]}

    packed = c.packing(spark, clean, SF)
    total = packed.groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    assert {r["doc_id"] for r in total} == {r["doc_id"] for r in clean.collect()}
    full = packed.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("m")).collect()
    assert all(r["n"] == r["m"] <= 1024 for r in full)


@pytest.mark.parametrize("name, stage", c.STAGES)
def test_stages_of_odd_tables(spark, name, stage):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    extra = [F.lit("q").alias(x) for x in ("score", "lang_pred", "predicted", "contaminated", "items", "n_words", "component_id", "_text", "hi", "token")]
    nulls = docs.limit(1).select(*[F.lit(None).cast(t).alias(x) for x, t in docs.dtypes])
    odd = docs.unionByName(nulls).unionByName(docs.limit(5)).unionByName(docs.limit(1).withColumn("text", F.lit(""))).select("*", *extra)
    got = stage(spark, odd, SF)
    if name != "packing":
        assert got.columns == odd.columns
        ids = {r["doc_id"] for r in odd.collect()}
        assert {r["doc_id"] for r in got.collect()} <= ids and {r["token"] for r in got.collect()} == {"q"}
    assert got.count() > 40
    empty = stage(spark, odd.limit(0), SF)
    assert empty.columns == got.columns and empty.count() == 0


def test_repeated_ids_leave_the_same_row(spark):
    rows = [(1, "a b c d e f", "en", "s", 3), (1, "u v w x y z", "en", "s", 3), (2, "k l m n o p", "en", "s", 3), (None, "q", None, None, None), (None, "q", None, None, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    first = _rows(c.near_duplicates(spark, d, SF))
    assert len(first) == 4 and first == _rows(c.near_duplicates(spark, d.repartition(7), SF))


def test_near_duplicates_equal_sql(spark, tmp_path):
    spark.read.parquet(f"{SF}/documents.parquet").write.parquet(f"{tmp_path}/documents.parquet")
    sql = "WITH RECURSIVE " + _SETS.format(docs="documents").replace("len(w) < 4", "len(w) < 5").replace("len(w) - 2)", "len(w) - 3)").replace("i + 3", "i + 4").replace("85 *", "80 *") + " SELECT id AS doc_id FROM comp WHERE id = component_id"
    got = c.near_duplicates(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), SF).select("doc_id")
    assert sorted(repr((r["doc_id"],)) for r in got.collect()) == sql_rows(sql, str(tmp_path), ["doc_id"])
