"""Registered queries over records: links and dimensions, contributors, nodes with attributes, pages, layouts, round trips."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import functions as F

from quillnet.functions import html as H
from quillnet.functions import text as X
from quillnet.operators import graph as G
from quillnet.operators import layout as L
from quillnet.operators import relational as R
from quillnet.plans.catalogue import _EGO, _P, ENDS, GP2, GS, _f, _graph, _points, _r, _rank_sql, _ranked, _segments, _strong, query
from quillnet.session import cut, shared_dir, table
from quillnet.sources import files

# ---- links and dimensions


@query("SELECT DISTINCT l_orderkey, s_name FROM lineitem JOIN supplier ON l_suppkey = s_suppkey")
def link_names(spark, d):
    links = table(spark, d, "lineitem").select("l_orderkey", F.col("l_suppkey").alias("s_suppkey")).distinct()
    return links.join(table(spark, d, "supplier"), "s_suppkey").select("l_orderkey", "s_name").distinct()


@query("SELECT DISTINCT o_orderkey, s_name FROM orders LEFT JOIN (SELECT * FROM lineitem WHERE l_returnflag = 'R') ON o_orderkey = l_orderkey LEFT JOIN supplier ON l_suppkey = s_suppkey")
def contributors_left(spark, d):
    links = table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_suppkey").alias("s_suppkey")).distinct()
    named = links.join(table(spark, d, "supplier"), "s_suppkey", "left")
    return table(spark, d, "orders").select("o_orderkey").join(named, "o_orderkey", "left").select("o_orderkey", "s_name").distinct()


@query("SELECT DISTINCT o_custkey, l_partkey FROM orders JOIN lineitem ON o_orderkey = l_orderkey")
def two_hop_chain(spark, d):
    o, li = table(spark, d, "orders"), table(spark, d, "lineitem")
    return o.select("o_custkey", F.col("o_orderkey").alias("l_orderkey")).join(li, "l_orderkey").select("o_custkey", "l_partkey").distinct()


@query("SELECT DISTINCT o_orderkey, c_name, n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey")
def performer_persons(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    c = table(spark, d, "customer").select("c_custkey", "c_name", F.col("c_nationkey").alias("n_nationkey"))
    return o.join(c, "c_custkey").join(table(spark, d, "nation"), "n_nationkey").select("o_orderkey", "c_name", "n_name").distinct()


@query("""WITH old AS (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem WHERE l_linenumber = 1), new AS (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem WHERE l_linenumber > 1)
SELECT * FROM old UNION ALL SELECT * FROM new WHERE (l_orderkey, l_suppkey) NOT IN (SELECT (l_orderkey, l_suppkey) FROM old)""")
def insert_if_absent(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey", "l_linenumber")
    old = li.where("l_linenumber = 1").drop("l_linenumber").distinct()
    return R.insert_if_absent(old, li.where("l_linenumber > 1").drop("l_linenumber"), ["l_orderkey", "l_suppkey"])


@query("SELECT DISTINCT l_orderkey AS a, l_suppkey AS b, l_linenumber AS w FROM lineitem")
def dedup_edges(spark, d):
    both = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("a"), F.col("l_suppkey").alias("b"), F.col("l_linenumber").alias("w"))
    return R.dedup_edges(both.unionByName(both), "a", "b", "w")


@query("SELECT p_partkey, p_name FROM part WHERE p_name IS NOT NULL AND p_name <> '' AND p_partkey % 4 <> 0")
def truthy_labels(spark, d):
    label = F.expr("CASE p_partkey % 8 WHEN 0 THEN '' WHEN 4 THEN NULL ELSE p_name END")
    return table(spark, d, "part").select("p_partkey", label.alias("p_name")).where(F.col("p_name").isNotNull() & (F.col("p_name") != ""))


@query("""WITH r AS (SELECT conv_id, list_sort(list(DISTINCT role) FILTER (role <> 'user')) AS roles FROM conversations GROUP BY conv_id)
SELECT conv_id, array_to_string(CASE WHEN coalesce(len(roles), 0) = 0 THEN ['conversation ' || conv_id] ELSE roles END, ',') AS roles FROM r""")
def default_roles(spark, d):
    roles = table(spark, d, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_set(F.when(F.col("role") != "user", F.col("role")))).alias("r"))
    named = F.when(F.size("r") == 0, F.array(F.concat(F.lit("conversation "), F.col("conv_id").cast("string")))).otherwise(F.col("r"))
    return roles.select("conv_id", F.array_join(named, ",").alias("roles"))


@query(GP2 + " SELECT src, dst, least(abs(4 - weight), 4) AS w FROM e")
def clamp_weight(spark, d):
    return _strong(spark, d).select("src", "dst", X.clamp_distance(F.col("weight"), 4).alias("w"))


@query("""SELECT 'l_quantity' AS name, round(min(l_quantity), 6) AS lo, round(max(l_quantity), 6) AS hi, round(avg(l_quantity), 6) AS mean, round(stddev_pop(l_quantity), 6) AS std, round(max(abs(l_quantity)), 6) AS largest FROM lineitem
UNION ALL SELECT 'l_extendedprice', round(min(l_extendedprice), 6), round(max(l_extendedprice), 6), round(avg(l_extendedprice), 6), round(stddev_pop(l_extendedprice), 6), round(max(abs(l_extendedprice)), 6) FROM lineitem""")
def column_spread(spark, d):
    numbers = table(spark, d, "lineitem").select(*[F.col(c).cast("double").alias(c) for c in ("l_quantity", "l_extendedprice")])
    return _f(R.spread(numbers, numbers.columns))


# ---- graphs with attributes


@query("""WITH c AS (SELECT DISTINCT l_orderkey AS g, nullif(upper(s_name[1]) || lower(s_name[2:]), '') AS i FROM lineitem JOIN supplier ON l_suppkey = s_suppkey),
k AS (SELECT g FROM c GROUP BY g HAVING count(*) = 1) SELECT i AS id, count(*) AS groups, count(*) FILTER (g IN (FROM k)) AS alone FROM c GROUP BY i""")
def named_nodes(spark, d):
    """Every name is a node, also where it stands alone in a group."""
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("g"), F.col("l_suppkey").alias("s_suppkey"))
    named = cut(li.join(table(spark, d, "supplier"), "s_suppkey").select("g", F.concat(F.upper(F.substring("s_name", 1, 1)), F.lower(F.substring("s_name", 2, 99))).alias("i")).distinct())
    nodes, _ = G.named_cooccurrence(named, "g", "i")
    alone = named.groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    per = named.join(alone, "g").groupBy(F.col("i").alias("id")).agg(F.count(F.lit(1)).alias("groups"), F.count(F.when(F.col("n") == 1, 1)).alias("alone"))
    return nodes.join(per, "id").select("id", "groups", "alone")


@query("""WITH m AS (SELECT DISTINCT l_orderkey AS g, p_brand || ' ' || p_size AS i FROM lineitem JOIN part ON l_partkey = p_partkey)
SELECT a.i AS src, b.i AS dst, count(*) AS weight FROM m a JOIN m b ON a.g = b.g AND a.i < b.i GROUP BY ALL""")
def named_edges(spark, d):
    """Parts of one name are one node."""
    p = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.concat_ws(" ", "p_brand", F.col("p_size").cast("string")).alias("name"))
    return G.named_cooccurrence(table(spark, d, "lineitem").select("l_orderkey", "l_partkey").join(p, "l_partkey"), "l_orderkey", "name")[1]


@query(GP2 + ENDS + ", s AS (SELECT id, pow(sum(pow(weight::DOUBLE, 2)), 0.5::DOUBLE) + 1e-5::DOUBLE AS size FROM n GROUP BY id) SELECT p_partkey AS id, round(coalesce(size, 0.001::DOUBLE), 9) AS size FROM part LEFT JOIN s ON p_partkey = id")
def root_degree(spark, d):
    return G.root_degree(table(spark, d, "part").select(F.col("p_partkey").alias("id")), _strong(spark, d)).select("id", _r("size"))


_TOP = """, q AS (SELECT id, round(r, 12) AS r FROM r20), top AS (SELECT q.id FROM q JOIN part ON p_partkey = q.id WHERE p_name <> '' ORDER BY q.r DESC, q.id LIMIT 60),
mem AS (SELECT n.id AS ego, other AS id FROM n WHERE n.id IN (FROM top) UNION SELECT id, id FROM top)"""


@query(GP2 + ENDS + _rank_sql("weight", 20) + _TOP + " SELECT ego, mem.id, p_name AS label, p_size % 5 AS partition, CASE WHEN ego = mem.id THEN 10.0::DOUBLE ELSE round(q.r, 9) END AS pr FROM mem JOIN q ON q.id = mem.id JOIN part ON p_partkey = mem.id")
def ego_attributes(spark, d):
    """Egos of the 60 nodes of the largest PageRank that bear a label."""
    e = _strong(spark, d)
    pr = cut(_ranked(e, True).select("id", F.round("rank", 12).alias("pr")))
    parts = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("label"), (F.col("p_size") % 5).alias("partition"))
    nodes = cut(pr.join(parts, "id"))
    top = R.top_k(nodes.where("label <> ''"), 60, [F.desc("pr"), F.col("id")]).select("id")
    return G.ego_nodes(G.ego_members(e, cut(top)), nodes).select("ego", "id", "label", "partition", _r("pr"))


@query(GS + ", o AS (SELECT id, id % 5 AS c, row_number() OVER (ORDER BY id % 5, id) - 1 AS k FROM (SELECT src AS id FROM e UNION SELECT dst FROM e)) SELECT a.k AS i, b.k AS j, CASE WHEN a.c = b.c THEN 'same' ELSE 'other' END AS colour, least(abs(100 - weight), 100) AS light FROM e JOIN o a ON a.id = src JOIN o b ON b.id = dst")
def adjacency_colours(spark, d):
    e = cut(_graph(spark, d, "gs"))
    nodes = e.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    cells = G.adjacency_coo(e, nodes.select("id", (F.col("id") % 5).alias("community")))
    return cells.select("i", "j", F.when(F.col("same"), "same").otherwise("other").alias("colour"), X.clamp_distance(F.col("weight")).alias("light"))


# ---- pages

_A = """WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, '(?is)(<a[^>]*href="[^"]*"[^>]*>.*?</a>)', 1)) AS a FROM pages)"""
_PLAIN = r"trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace({c}, '<[^>]*>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', chr(39)), '&nbsp;', ' '), '&amp;', '&'), '[\s\p{{Z}}]+', ' ', 'g'))".replace('\\"', '"')


@query(_A + f""" SELECT page_id, regexp_extract(a, '(?is)^<a[^>]*href="([^"]*)"', 1) AS href, {_PLAIN.format(c='a')} AS text, count(*) AS n FROM l GROUP BY ALL""")
def page_link_texts(spark, d):
    found = table(spark, d, "pages").select("page_id", F.inline(H.link_texts(F.col("html"))))
    return found.groupBy("page_id", "href", "text").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH a AS (SELECT page_id, unnest(regexp_extract_all(html, '(?is)<div\\b[^>]*class="ad"[^>]*>(.*?)</div>', 1)) AS t FROM pages) SELECT page_id, {_PLAIN.format(c='t')} AS text FROM a""")
def page_class_texts(spark, d):
    return table(spark, d, "pages").select("page_id", F.explode(H.by_class(F.col("html"), "ad", "div")).alias("text"))


@query("""WITH l AS (SELECT page_id, regexp_extract(html, '<html lang="([^"]*)"', 1) AS slug, unnest(regexp_extract_all(html, '(?i)<a[^>]*href="([^"]*)"', 1)) AS href FROM pages) SELECT page_id, href, count(*) AS n FROM l WHERE instr(href, slug) > 0 GROUP BY ALL""")
def slug_links(spark, d):
    """Links that hold their own page's slug, here its language."""
    pages = table(spark, d, "pages").select("page_id", F.regexp_extract("html", '<html lang="([^"]*)"', 1).alias("slug"), F.explode(H.links(F.col("html"))).alias("href"))
    return pages.where(F.col("href").contains(F.col("slug"))).groupBy("page_id", "href").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT p_partkey, label, trim(value) AS value FROM (SELECT p_partkey, 'Brand' AS label, p_brand AS value FROM part UNION ALL SELECT p_partkey, 'Made of', unnest(string_split(p_type, ' ')) FROM part UNION ALL SELECT p_partkey, 'A & B', p_size::VARCHAR FROM part)""")
def label_values(spark, d):
    """Parts written as pages with a table, and read again: labels with one or several values."""
    e = lambda *x: F.concat(*[F.lit(v) if isinstance(v, str) else v for v in x])
    page = e("<html><table class='attrs'><tr><th>Brand</th><td class=\"x\"> <b>", F.col("p_brand"), "</b> </td></tr>\n<tr><td>Made of</td><td>", F.translate("p_type", " ", "\n"), "\n</td></tr><tr><td>A &amp; B</td><td>", F.col("p_size").cast("string"), "</td></tr><tr><td>lonely</td></tr></table></html>")
    return table(spark, d, "part").select("p_partkey", F.inline(H.label_values(page)))


@query("SELECT DISTINCT s_suppkey || ':' || s_nationkey AS proxy FROM supplier WHERE s_suppkey % 3 = 0")
def proxy_rows(spark, d):
    s = table(spark, d, "supplier")
    cell = lambda c: F.concat(F.lit("<td>"), c, F.lit("</td>"))
    yes = F.when(F.col("s_suppkey") % 3 == 0, "yes").otherwise("no")
    row = F.concat(F.lit("<tr>"), *[cell(c) for c in (F.col("s_suppkey").cast("string"), F.col("s_nationkey").cast("string"), *[F.lit("-")] * 4, yes)], F.lit("</tr>"))
    return H.proxies(s.select(F.explode(H.cells(row)).alias("cells")))


@query("""SELECT page_id % 3 AS initial, k::INT AS page FROM pages, range(2, 8) t(k) WHERE page_id % 7 >= 2 AND k <= page_id % 7""")
def seed_pages(spark, d):
    pagers = table(spark, d, "pages").select((F.col("page_id") % 3).alias("initial"), F.concat(F.lit("/list?page="), (F.col("page_id") % 7).cast("string")).alias("last_link"))
    return H.seed_pages(pagers)


# ---- layouts


@query(_P + ", k AS (SELECT x, y, z, min(id) AS ord FROM p GROUP BY ALL) SELECT a.link, a.id AS edge, k.ord FROM p a JOIN k USING (x, y, z)")
def coordinate_index(spark, d):
    """The first node at exactly the coordinates of an end."""
    p = _points(spark, d)
    return p.join(p.groupBy(*L.XYZ).agg(F.min("id").alias("ord")), list(L.XYZ)).select("link", F.col("id").alias("edge"), "ord")


@query(_P + " SELECT max(n) AS fullest FROM (SELECT count(*) AS n FROM p GROUP BY floor(x / 0.05::DOUBLE), floor(y / 0.05::DOUBLE), floor(z / 0.05::DOUBLE))")
def fullest_bin(spark, d):
    return L.cells(_points(spark, d), 0.05).groupBy("cx", "cy", "cz").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("fullest"))


@query(_P + " SELECT id, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z, round(0.01::DOUBLE + 0.001::DOUBLE * (id % 10), 6) AS r FROM p")
def node_spheres(spark, d):
    return _f(L.spheres(_points(spark, d), 0.01 + 0.001 * (F.col("id") % 10)))


_S = _P + ", o AS (SELECT *, lead(id) OVER (PARTITION BY link ORDER BY id) AS nxt FROM p), s AS (SELECT o.id AS a, nxt AS b, o.x AS x1, o.y AS y1, o.z AS z1, q.x AS x2, q.y AS y2, q.z AS z2 FROM o JOIN p q ON q.id = nxt)"


@query(_S + " SELECT a AS link, k::INT AS seg, (a % 7 + 1)::BIGINT AS weight FROM s, range(5) t(k)")
def segment_attributes(spark, d):
    """Each link's attribute on all of its points."""
    s = cut(_segments(spark, d))
    return L.to_segments(L.polyline(s, 5), s.select("link", (F.col("link") % 7 + 1).alias("weight"))).select("link", "seg", "weight")


@query(_S + " SELECT a AS link, " + ", ".join(f"trunc({c}{k} * 1000)::BIGINT AS {c}{k}" for k in (1, 2) for c in "xyz") + ", round((a % 7 + 1) / 2.0::DOUBLE, 6) AS thickness FROM s")
def fuel_edges(spark, d):
    s = _segments(spark, d)
    return s.select("link", *[(F.col(f"{c}{k}") * 1000).cast("long").alias(f"{c}{k}") for k in (1, 2) for c in L.XYZ], F.round((F.col("link") % 7 + 1) / 2.0, 6).alias("thickness"))


# ---- round trips


def _fresh(spark) -> str:
    return f"{shared_dir(spark)}/quillnet-{uuid4().hex}"


@query("SELECT s_suppkey, s_name, s_acctbal::DOUBLE AS s_acctbal FROM supplier")
def source_tsv_roundtrip(spark, d):
    path = _fresh(spark)
    files.write_tsv(table(spark, d, "supplier").select("s_suppkey", "s_name", F.col("s_acctbal").cast("double").alias("s_acctbal")), path)
    return files.read_tsv(spark, path, "s_suppkey long, s_name string, s_acctbal double")


@query("SELECT lang, count(*) AS lines FROM documents WHERE length(text) > 40 GROUP BY lang")
def corpus_files(spark, d):
    """Every text as a line of its group's files, breaks as spaces, and the lines counted by folder."""
    from quillnet.operators import corpus as C

    path = _fresh(spark)
    docs = table(spark, d, "documents").withColumn("text", F.translate("text", "\n\r", "  "))
    C.write_corpus(C.corpus(docs, "lang", "doc_id", "text"), path)
    return spark.read.text(path).groupBy(F.col("group").alias("lang")).agg(F.count(F.lit(1)).alias("lines"))
