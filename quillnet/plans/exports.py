"""Registered queries that write and read back, quarantine rows, or project a bipartite graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillnet.operators import graph as G
from quillnet.operators import layout as L
from quillnet.plans.catalogue import _P, GP2, _f, _points, _segments, _strong, query
from quillnet.plans.records import _fresh
from quillnet.session import cut, table
from quillnet.sources import files, quarantine, writers


@query(GP2 + """ SELECT 'edge' AS kind, src::VARCHAR AS a, dst::VARCHAR AS b, weight::DOUBLE AS weight, NULL::VARCHAR AS size, NULL::VARCHAR AS name FROM e
UNION ALL SELECT 'node', p_partkey::VARCHAR, NULL, NULL, p_size::VARCHAR, p_name || ' <' || p_brand || '>' FROM part""")
def graphml_roundtrip(spark, d):
    """The part graph with typed attributes, written by tasks and read from the files."""
    path = _fresh(spark)
    parts = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("size"), F.concat("p_name", F.lit(" <"), "p_brand", F.lit(">")).alias("name"))
    writers.write_graphml(parts, _strong(spark, d).select("src", "dst", "weight"), path)
    nodes, edges = files.read_graphml(spark, path)
    none = F.lit(None).cast("string")
    return edges.select(F.lit("edge").alias("kind"), F.col("src").alias("a"), F.col("dst").alias("b"), "weight", none.alias("size"), none.alias("name")).unionByName(
        nodes.select(F.lit("node").alias("kind"), F.col("id").alias("a"), none.alias("b"), F.lit(None).cast("double").alias("weight"), F.col("data.size").alias("size"), F.col("data.name").alias("name"))
    )


@query(_P + """, o AS (SELECT *, lead(id) OVER (PARTITION BY link ORDER BY id) AS nxt FROM p)
SELECT 'node' AS kind, id AS k, 'v' || id AS label, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z, NULL::BIGINT AS b FROM p
UNION ALL SELECT 'link', o.id, 'v' || o.id || ';v' || nxt, round((o.x + q.x) / 2, 6), round(q.y, 6), round(q.z, 6), nxt FROM o JOIN p q ON q.id = nxt""")
def layout_roundtrip(spark, d):
    """Points and links with their paths as layout documents, and read again."""
    path, p, s = _fresh(spark), _points(spark, d), cut(_segments(spark, d))
    label = lambda c: F.concat(F.lit("v"), F.col(c).cast("string"))
    nodes = p.select(F.col("id").alias("ord"), label("id").alias("label"), *L.XYZ)
    line = L.polyline(s, 3).groupBy("link").agg(F.transform(F.sort_array(F.collect_list(F.struct("seg", F.array(*L.XYZ).alias("p")))), lambda q: q["p"]).alias("points"))
    links = s.join(line, "link").select(F.concat_ws(";", label("link"), label("dst")).alias("label"), F.col("link").cast("int").alias("a"), F.col("dst").cast("int").alias("b"), F.lit(0.1).alias("radius"), F.lit(1).alias("weight"), "points")
    writers.write_layout(nodes, links, path)
    n, k = files.read_layout(spark, path)
    long = F.lit(None).cast("long")
    return _f(
        n.select(F.lit("node").alias("kind"), F.col("ord").alias("k"), "label", *L.XYZ, long.alias("b")).unionByName(
            k.select(F.lit("link").alias("kind"), F.col("a").cast("long").alias("k"), "label", F.col("points")[1][0].alias("x"), F.col("points")[2][1].alias("y"), F.col("points")[2][2].alias("z"), F.col("b").cast("long").alias("b"))
        )
    )


@query("""SELECT CASE WHEN event_id % 7 = 0 OR event_id % 11 = 0 THEN 'reject' ELSE 'good' END AS status, event_id, CASE WHEN event_id % 7 = 0 OR event_id % 11 = 0 THEN NULL ELSE round(value, 6) END AS value FROM events""")
def quarantine_json(spark, d):
    """Events as JSON lines of which some are cut off and some hold words for numbers."""
    e, path = table(spark, d, "events"), _fresh(spark)
    line = F.to_json(F.struct("event_id", "user_id", "value"))
    odd = F.when(F.col("event_id") % 7 == 0, F.expr("left(line, length(line) - 3)")).when(F.col("event_id") % 11 == 0, F.regexp_replace("line", '"value":[^}]*', '"value":"many"')).otherwise(F.col("line"))
    e.select(F.col("event_id"), line.alias("line")).select(odd.alias("value")).write.text(path)
    found = quarantine.read_checked(spark, path, "event_id long, user_id long, value double")
    bad = found.rejects.select(F.lit("reject").alias("status"), F.regexp_extract("record", r'"event_id":(\d+)', 1).cast("long").alias("event_id"), F.lit(None).cast("double").alias("value"))
    return _f(found.good.select(F.lit("good").alias("status"), "event_id", "value").unionByName(bad))


@query("""WITH c AS (SELECT page_id, regexp_extract(url, '[?&]page=([0-9]+)', 1) AS n, regexp_extract(url, '^[a-z]+://[^/]*/([a-z]+)/', 1) AS lang FROM pages), m AS (SELECT *, CASE WHEN n = '' AND page_id % 5 = 0 THEN 'none' WHEN n = '' THEN NULL ELSE n END AS t FROM c)
SELECT page_id, lang, try_cast(t AS INT) AS page, array_to_string(list_filter([CASE WHEN t IS NOT NULL AND try_cast(t AS INT) IS NULL THEN 'page: not int' END, CASE WHEN length(lang) <> 2 THEN 'two letters' END], lambda x: x IS NOT NULL), '; ') AS errors FROM m""")
def quarantine_casts(spark, d):
    """Numbers and languages in addresses: what does not cast or breaks a rule is kept with its reasons."""
    p = table(spark, d, "pages").select("page_id", F.regexp_extract("url", r"[?&]page=([0-9]+)", 1).alias("n"), F.regexp_extract("url", "^[a-z]+://[^/]*/([a-z]+)/", 1).alias("lang"))
    text = F.when((F.col("n") == "") & (F.col("page_id") % 5 == 0), "none").when(F.col("n") != "", F.col("n"))
    found = quarantine.cast_checked(p.select("page_id", "lang", text.alias("page")), {"page": "int"}, {"two letters": F.length("lang") == 2})
    bad = found.rejects.select("page_id", "lang", F.col("page").try_cast("int").alias("page"), F.array_join("errors", "; ").alias("errors"))
    return found.good.withColumn("errors", F.lit("")).unionByName(bad)


@query("""WITH m AS (SELECT DISTINCT l_orderkey AS n, l_partkey AS c FROM lineitem), e AS (SELECT a.n AS src, b.n AS dst, count(*) AS weight FROM m a JOIN m b ON a.c = b.c AND a.n <> b.n GROUP BY ALL),
k AS (SELECT src FROM e GROUP BY src HAVING count(*) > 150) SELECT * FROM e WHERE src < dst AND src IN (FROM k) AND dst IN (FROM k)""")
def shared_contributors(spark, d):
    """Orders linked by the parts that they share, of those with more than 150 neighbours."""
    return G.shared_contributors(table(spark, d, "lineitem"), "l_orderkey", "l_partkey", min_degree=150)
