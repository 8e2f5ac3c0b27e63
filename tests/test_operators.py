import pytest
from pyspark.sql import functions as F

from quillnet.functions import html, text
from quillnet.operators import corpus, graph, layout, relational
from quillnet.operators.components import connected_components
from quillnet.sources import files, writers


def edges(spark, rows):
    return spark.createDataFrame(rows, "src long, dst long, weight long")


def test_components_chain_cycle_and_loops(spark):
    e = edges(spark, [(k, k + 1, 1) for k in range(1, 30)] + [(50, 51, 1), (51, 52, 1), (52, 50, 1), (60, 60, 1), (None, 3, 1)])
    got = {r["id"]: r["component"] for r in connected_components(e).collect()}
    assert got == {**{k: 1 for k in range(1, 31)}, 50: 50, 51: 50, 52: 50}


def test_components_of_nothing(spark):
    assert connected_components(edges(spark, [])).count() == 0


def test_pagerank_sums_to_one_with_isolated_node(spark):
    nodes = spark.createDataFrame([(1,), (2,), (3,), (9,)], "id long")
    r = graph.pagerank(nodes, edges(spark, [(1, 2, 3), (2, 3, 1)])).collect()
    assert sum(x["rank"] for x in r) == pytest.approx(1)
    assert max(r, key=lambda x: x["rank"])["id"] == 2


def test_louvain_finds_two_cliques(spark):
    c = lambda b: [(b + i, b + j, 1) for i in range(5) for j in range(i + 1, 5)]
    e = edges(spark, c(0) + c(10) + [(4, 10, 1)])
    nodes = spark.createDataFrame([(k,) for k in [*range(5), *range(10, 15)]], "id long")
    part = graph.louvain(nodes, e)
    assert part.count() == 10
    single = graph.modularity(e, nodes.withColumn("community", F.col("id"))).first()[0]
    assert graph.modularity(e, part).first()[0] > single


def test_louvain_contracts_its_communities(spark):
    # A ring of twelve triangles: moves of single nodes find the triangles, only the next level joins some of them.
    e = [(3 * t + i, 3 * t + j, 2) for t in range(12) for i in range(3) for j in range(i + 1, 3)]
    e += [(min(3 * t, (3 * t + 4) % 36), max(3 * t, (3 * t + 4) % 36), 1) for t in range(12)]
    nodes = spark.createDataFrame([(k,) for k in range(36)] + [(99,)], "id long")
    part = graph.louvain(nodes, edges(spark, e))
    of = {r["id"]: r["community"] for r in part.collect()}
    assert len(of) == 37 and of[99] == 99
    triangles = nodes.where("id < 99").withColumn("community", F.floor(F.col("id") / 3))
    assert graph.modularity(edges(spark, e), part).first()[0] >= graph.modularity(edges(spark, e), triangles).first()[0] - 1e-9
    assert graph.louvain(nodes, edges(spark, [])).count() == 37


def test_hot_groups_are_dealt_out(spark):
    m = spark.createDataFrame([(1, k) for k in range(40)] + [(2, k) for k in range(5)] + [(None, 1), (1, None), (1, 3)], "g int, i long")
    plain = {tuple(r) for r in graph.cooccurrence(m, "g", "i").collect()}
    assert {tuple(r) for r in graph.cooccurrence(m, "g", "i", hot=7).collect()} == plain and len(plain) == 40 * 39 // 2


def test_betweenness_of_a_path(spark):
    nodes = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    got = {r["id"]: r["betweenness"] for r in graph.betweenness(nodes, edges(spark, [(1, 2, 1), (2, 3, 1)])).collect()}
    assert got == {1: 0.0, 2: 1.0, 3: 0.0}


def test_disparity_last_end_decides(spark):
    e = edges(spark, [(1, 2, 1), (1, 3, 1), (1, 4, 2)])
    scored, population = graph.disparity(spark.createDataFrame([(k,) for k in (1, 2, 3, 4)], "id long"), e)
    assert {r["alpha"] for r in scored.collect()} == {0.0}
    assert population.count() == 3


def test_text_functions(spark):
    rows = spark.createDataFrame([("\t o'neil  g.dénes ", "Band (Old Band) Old Band"), ("", "Plain (unclosed"), (None, None)], "a string, b string")
    got = rows.select(text.py_strip(F.col("a")), text.title_case(text.squash_ws(F.col("a"))), text.split_alias(F.col("b"))).collect()
    assert got[0][0] == "o'neil  g.dénes" and got[0][1] == "O'Neil G.Dénes"
    assert tuple(got[0][2]) == ("Band", "Old Band")
    assert tuple(got[1][2]) == ("Plain (unclosed", "None")


def test_decade_edges(spark):
    rows = spark.createDataFrame([(0,), (999,), (1999,), (2021,), (None,)], "y int")
    assert [r[0] for r in rows.select(text.decade(F.col("y"))).collect()] == [0, 0, 1990, 2020, 0]


def test_percentile_outside_population(spark):
    p = spark.createDataFrame([(0.2,), (0.2,), (0.4,)], "v double")
    s = spark.createDataFrame([(0.0,), (0.2,), (0.3,), (0.9,)], "s double")
    got = {r["s"]: r["ptile"] for r in relational.percentile_of_score(s, "s", p, "v").collect()}
    assert got == pytest.approx({0.0: 0.0, 0.2: 50.0, 0.3: 200 / 3, 0.9: 100.0})


def test_minmax_of_a_constant(spark):
    got = relational.minmax(spark.createDataFrame([(3.0,), (3.0,)], "x double"), ["x"], 1, 5).collect()
    assert [r[0] for r in got] == [1.0, 1.0]


def test_unique_check(spark):
    with pytest.raises(ValueError):
        relational.assert_unique(spark.createDataFrame([(1,), (1,)], "a int"), "a")


def test_skipgrams_of_three_tokens(spark):
    got = corpus.skipgrams(spark.createDataFrame([("a b c",)], "text string"), "text", min_count=1).collect()
    assert {(r["a"], r["b"]) for r in got} == {("a", "b"), ("a", "c"), ("b", "c")}


def test_label_table_and_seeds(spark):
    page = spark.createDataFrame([("<table><tr><th>Year</th><td>1999\n2000</td></tr></table>",)], "html string")
    got = page.select(F.inline(html.label_values(F.col("html")))).collect()
    assert [tuple(r) for r in got] == [("Year", "1999"), ("Year", "2000")]
    pagers = spark.createDataFrame([("a", "x?p=4"), ("b", None)], "initial string, last_link string")
    assert [r["page"] for r in html.seed_pages(pagers).orderBy("page").collect()] == [2, 3, 4]


def test_graphml_and_tsv_round_trip(spark, tmp_path):
    e = edges(spark, [(1, 2, 3), (2, 3, 5)])
    n = spark.createDataFrame([(1,), (2,), (3,), (4,)], "id long")
    writers.write_graphml(n, e, f"{tmp_path}/g.graphml")
    nodes, back = files.read_graphml(spark, f"{tmp_path}/g.graphml")
    assert nodes.count() == 4 and {(r["src"], r["dst"], r["weight"]) for r in back.collect()} == {("1", "2", 3.0), ("2", "3", 5.0)}
    files.write_tsv(e, f"{tmp_path}/t")
    assert files.read_tsv(spark, f"{tmp_path}/t", "src long, dst long, weight long").count() == 2


def test_sqlite_source(spark, tmp_path):
    import sqlite3

    with sqlite3.connect(f"{tmp_path}/a.db") as con:
        con.execute("CREATE TABLE song (id INTEGER, title TEXT)")
        con.executemany("INSERT INTO song VALUES (?, ?)", [(k, f"t{k}") for k in range(20)])
    spark.dataSource.register(files.SqliteSource)
    got = spark.read.format("sqlite").schema("id long, title string").option("table", "song").option("partitions", "3").option("key", "id").load(f"{tmp_path}/a.db")
    assert got.count() == 20 and got.agg(F.sum("id")).first()[0] == 190


def test_fetch_falls_back(spark):
    def broken(u):
        raise OSError

    urls = spark.createDataFrame([("u1",), ("u2",)], "url string")
    got = files.fetch_pages(urls, [broken, lambda u: u.upper() if u == "u1" else None]).collect()
    assert {r["url"]: r["html"] for r in got} == {"u1": "U1", "u2": None}


def test_lattice(spark):
    p, e = layout.lattice(spark, 3)
    assert p.count() == 27 and e.count() == 54


def test_stream_of_events(spark, tmp_path):
    from quillnet.streaming.cooccurrence import hourly_users

    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.write.parquet(f"{tmp_path}/in")
    stream = hourly_users(spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in"))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("hours").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("hours").agg(F.sum("events")).first()[0] == events.count()


def test_typed_graphml_and_tables(spark, tmp_path):
    nodes = spark.createDataFrame([("a & b", 3, 0.5), ("c", None, 1.0)], "id string, partition long, pr double")
    e = spark.createDataFrame([("a & b", "c", 4.0)], "src string, dst string, weight double")
    writers.write_graphml(nodes, e, f"{tmp_path}/g.graphml")
    assert 'attr.name="pr" attr.type="double"' in next((tmp_path / "g.graphml").glob("*.graphml")).read_text()
    back, be = files.read_graphml(spark, f"{tmp_path}/g.graphml")
    assert {(r["id"], r["data"].get("partition"), r["data"]["pr"]) for r in back.collect()} == {("a & b", "3", "0.5"), ("c", None, "1.0")}
    assert be.first()["weight"] == 4.0
    assert files.create_if_missing(spark, f"{tmp_path}/t", "a int") and not files.create_if_missing(spark, f"{tmp_path}/t", "a int")
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "1.txt").write_text("x\ny\n")
    (tmp_path / "d" / "2.txt").write_text("z\n")
    assert {tuple(r) for r in files.read_lines(spark, f"{tmp_path}/d").collect()} == {("1.txt", "x"), ("1.txt", "y"), ("2.txt", "z")}


def test_sqlite_keeps_null_keys(spark, tmp_path):
    import sqlite3

    with sqlite3.connect(f"{tmp_path}/b.db") as con:
        con.execute("CREATE TABLE t (k INTEGER, v TEXT)")
        con.executemany("INSERT INTO t VALUES (?, ?)", [(None, "n"), (-3, "m"), (4, "p")])
    spark.dataSource.register(files.SqliteSource)
    got = spark.read.format("sqlite").schema("k long, v string").option("table", "t").option("partitions", "2").option("key", "k").load(f"{tmp_path}/b.db")
    assert {r["v"] for r in got.collect()} == {"n", "m", "p"}


def test_links_inserted_once(spark):
    old = spark.createDataFrame([(1, None), (2, 5)], "a int, b int")
    new = spark.createDataFrame([(1, None), (2, 5), (3, 1), (3, 1), (None, None)], "a int, b int")
    got = sorted(map(repr, relational.insert_if_absent(old, new, ["a", "b"]).collect()))
    assert len(got) == 4 and relational.insert_if_absent(old.limit(0), new.limit(0), ["a"]).count() == 0


def test_end_forces_and_noise(spark):
    f = spark.createDataFrame([(1, 0, 1.0, 0.0, 0.0), (2, 0, 2.0, 1.0, 0.0), (2, 4, 9.0, 9.0, 9.0)], "link long, seg int, fx double, fy double, fz double")
    ends = spark.createDataFrame([(1, 0, 7), (2, 0, 7)], "link long, seg int, id long")
    assert [tuple(r) for r in layout.end_forces(f, ends).collect()] == [(7, 3.0, 1.0, 0.0)]
    p = spark.createDataFrame([(k, 0.0, 0.0, 0.0) for k in range(50)], "id long, x double, y double, z double")
    assert layout.noise(p, 0, 1.0, 10.0, 3).agg(F.stddev("x")).first()[0] > 10 * layout.noise(p, 50, 1.0, 10.0, 3).agg(F.stddev("x")).first()[0]


def test_language_filter_and_topics(spark):
    docs = spark.createDataFrame([(k, "the cat and the dog were there with them\nder Hund und die Katze", "en") for k in range(20)] + [(k, "der Hund und die Katze waren nicht da", "de") for k in range(20, 40)], "id long, text string, lang string")
    kept = corpus.language_filter(docs.where("lang = 'en'").unionByName(docs.where("lang = 'de'")), "id", "text", "lang", "de")
    assert {r["doc"] for r in kept.collect() if r["doc"] >= 20} == set(range(20, 40))
    assert not [r for r in kept.collect() if r["doc"] < 20 and r["line"] == 0]
    topics = corpus.lda_topics(docs, "id", "text", k=2, passes=3)
    assert topics.count() == 20 and topics.where("weight < 0 or term is null").count() == 0
