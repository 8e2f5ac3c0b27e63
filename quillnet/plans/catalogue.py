"""Registered queries: each operator over whole tables, and the same in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillnet.functions import html as H
from quillnet.functions import text as X
from quillnet.operators import corpus as C
from quillnet.operators import graph as G
from quillnet.operators import layout as L
from quillnet.operators import relational as R
from quillnet.session import cut, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


def _r(c: str, digits: int = 9):
    return F.round(F.col(c), digits).alias(c)


# ---- graphs over the tables

def _members(kind: str) -> str:
    return {
        "gs": "SELECT DISTINCT l_orderkey AS g, l_suppkey AS i FROM lineitem",
        "gp": "SELECT DISTINCT l_orderkey AS g, l_partkey AS i FROM lineitem",
        "gu": "SELECT DISTINCT date_trunc('hour', ts) AS g, user_id AS i FROM events",
    }[kind]


def _edges_sql(kind: str) -> str:
    return f"""m AS ({_members(kind)}), e0 AS (SELECT a.i AS src, b.i AS dst, count(*) AS weight FROM m a JOIN m b ON a.g = b.g AND a.i < b.i GROUP BY ALL)"""


GS = "WITH " + _edges_sql("gs") + ", e AS (SELECT * FROM e0)"
GU = "WITH " + _edges_sql("gu") + ", e AS (SELECT * FROM e0)"
GP = "WITH " + _edges_sql("gp") + ", e AS (SELECT * FROM e0)"
GP2 = "WITH RECURSIVE " + _edges_sql("gp") + ", e AS (SELECT * FROM e0 WHERE weight >= 2)"
ENDS = ", n AS (SELECT src AS id, dst AS other, weight FROM e UNION ALL SELECT dst, src, weight FROM e)"


def _hours(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(F.date_trunc("hour", "ts").alias("g"), "user_id")


def _graph(spark: SparkSession, d: str, kind: str) -> DataFrame:
    if kind == "gu":
        return G.cooccurrence(_hours(spark, d), "g", "user_id")
    return G.cooccurrence(table(spark, d, "lineitem"), "l_orderkey", {"gs": "l_suppkey", "gp": "l_partkey", "gsx": "l_suppkey", "gp2": "l_partkey"}[kind])


def _backbone(spark: SparkSession, d: str) -> DataFrame:
    """The edges that stand out at either end, for what is asked of backbones only."""
    return cut(G.backbone_cut(cut(_disparity(spark, d, "gs")[0]), 0.05, 1, keep="significant").select("src", "dst", "weight"))


def _strong(spark: SparkSession, d: str) -> DataFrame:
    return cut(_graph(spark, d, "gp").where("weight >= 2"))


def _nodes(e: DataFrame) -> DataFrame:
    return e.select(F.explode(F.array("src", "dst")).alias("id")).distinct()


@query(GS + ENDS + " SELECT id, count(*) AS degree, sum(weight)::BIGINT AS strength FROM n GROUP BY id ORDER BY strength DESC, id LIMIT 20")
def cooccur_top20(spark, d):
    s = G.degree_strength(_graph(spark, d, "gs")).drop("rss")
    return R.top_k(s, 20, [F.desc("strength"), F.col("id")])


@query(GS + " SELECT src, dst, weight FROM e")
def cooccur_edges(spark, d):
    return _graph(spark, d, "gs")


@query("""WITH m AS (SELECT l_orderkey AS g, 'S' || l_suppkey AS i FROM lineitem UNION SELECT l_orderkey, 'P' || l_partkey FROM lineitem
UNION SELECT o_orderkey, 'C' || o_custkey FROM orders) SELECT a.i AS src, b.i AS dst, count(*) AS weight FROM m a JOIN m b ON a.g = b.g AND a.i < b.i GROUP BY ALL""")
def cooccur_multirole(spark, d):
    # An item is its key times 4 and its role: numbers take less room than names while pairs meet.
    code = lambda c, role: F.shiftleft(F.col(c).cast("long"), 2) + role
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("g"), F.explode(F.array(code("l_suppkey", 0), code("l_partkey", 1))).alias("i"))
    e = G.cooccurrence(li.unionByName(table(spark, d, "orders").select(F.col("o_orderkey").alias("g"), code("o_custkey", 2).alias("i"))), "g", "i")
    name = lambda c: F.concat(F.substring(F.lit("SPC"), F.pmod(F.col(c), F.lit(4)).cast("int") + 1, F.lit(1)), F.shiftright(F.col(c), 2).cast("string"))
    return e.select(name("src").alias("a"), name("dst").alias("b"), "weight").select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst"), "weight")


@query(GU + " SELECT src, dst, weight FROM e")
def comembership_edges(spark, d):
    return _graph(spark, d, "gu")


@query(GS + ENDS + " SELECT id, count(*) AS degree, sum(weight)::BIGINT AS strength FROM n GROUP BY id")
def degree_strength(spark, d):
    return G.degree_strength(_graph(spark, d, "gs")).drop("rss")


@query(GP2 + ENDS + " SELECT id, round(sqrt(sum(weight * weight)), 9) AS rss FROM n GROUP BY id")
def rss_degree(spark, d):
    return G.degree_strength(_strong(spark, d)).select("id", _r("rss"))


@query(GP2 + ENDS + ", c AS (SELECT id, count(*) AS k FROM n GROUP BY id) SELECT id, round(k / ((SELECT count(*) FROM c) - 1)::DOUBLE, 9) AS centrality FROM c")
def degree_centrality(spark, d):
    e = _strong(spark, d)
    return G.degree_centrality(_nodes(e), e).select("id", _r("centrality"))


@query(GP + ENDS + ", k AS (SELECT id FROM n GROUP BY id HAVING count(*) >= 2) SELECT src, dst, weight FROM e WHERE weight >= 2 AND src IN (FROM k) AND dst IN (FROM k)")
def prune_degree_weight(spark, d):
    return G.prune(cut(_graph(spark, d, "gp"))).select("src", "dst", "weight")


def _rank_sql(weight: str, rounds: int) -> str:
    first = f""", v AS (SELECT id, sum({weight})::DOUBLE AS s FROM n GROUP BY id), p AS (SELECT n.id, other, {weight}::DOUBLE / s AS p FROM n JOIN v ON n.id = v.id),
c AS (SELECT count(*)::DOUBLE AS n FROM v), r0 AS (SELECT id, 1 / n AS r FROM v, c)"""
    steps = [f", r{k} AS MATERIALIZED (SELECT v.id, 0.85::DOUBLE * coalesce(sum(q.r * p.p), 0) + 0.15::DOUBLE / any_value(n) AS r FROM v CROSS JOIN c LEFT JOIN p ON p.other = v.id LEFT JOIN r{k - 1} q ON q.id = p.id GROUP BY v.id)" for k in range(1, rounds + 1)]
    return first + "".join(steps)


def _ranked(e: DataFrame, weighted: bool, rounds: int = 20) -> DataFrame:
    e = cut(e)
    return G.pagerank(_nodes(e), e, weighted=weighted, fixed_iters=rounds)


@query(GS + ENDS + _rank_sql("weight", 20) + " SELECT id, round(r, 9) AS rank FROM r20")
def pagerank_weighted_k20(spark, d):
    return _ranked(_graph(spark, d, "gs"), True).select("id", _r("rank"))


@query(GS + ENDS + _rank_sql("1", 20) + " SELECT id, round(r, 9) AS rank FROM r20")
def pagerank_unweighted_k20(spark, d):
    return _ranked(_graph(spark, d, "gs"), False).select("id", _r("rank"))


@query(GP2 + ENDS + _rank_sql("weight", 20) + """, s AS (SELECT id, round(r, 12) AS r FROM r20), b AS (SELECT min(r) AS lo, max(r) AS hi FROM s)
SELECT id, round((r - lo) / (hi - lo) * 4 + 1, 5) AS scaled FROM s, b ORDER BY r DESC, id LIMIT 400""")
def pagerank_top_scaled(spark, d):
    r = _ranked(_strong(spark, d), True).select("id", F.round("rank", 12).alias("r"))
    s = R.minmax(cut(r.withColumn("scaled", F.col("r"))), ["scaled"], 1.0, 5.0)
    return R.top_k(s, 400, [F.desc("r"), F.col("id")]).select("id", F.round("scaled", 5).alias("scaled"))


# Components by label minima carried along edges; rounds are bounded by the number of nodes.
_CC = ENDS + """, l(id, c) USING KEY (id) AS (SELECT id, min(least(id, other)) FROM n GROUP BY id
UNION SELECT n.id, min(q.c) FROM l q JOIN n ON n.other = q.id JOIN recurring.l o ON o.id = n.id GROUP BY n.id, o.c HAVING min(q.c) < o.c)"""
_GP2CC = "WITH RECURSIVE " + _edges_sql("gp") + ", e AS (SELECT * FROM e0 WHERE weight >= 2)" + _CC


@query(_GP2CC + " SELECT id, c AS component FROM l")
def components(spark, d):
    e = _strong(spark, d)
    return G.components(_nodes(e), e)


@query(_GP2CC + ", big AS (SELECT c FROM l GROUP BY c ORDER BY count(*) DESC, c LIMIT 1) SELECT id FROM l WHERE c IN (FROM big)")
def giant_component(spark, d):
    e = _strong(spark, d)
    return G.giant(_nodes(e), e)


@query(_GP2CC + ", big AS (SELECT c FROM l GROUP BY c ORDER BY count(*) DESC, c LIMIT 1), g AS (SELECT id FROM l WHERE c IN (FROM big)) SELECT src, dst, weight FROM e WHERE src IN (FROM g) AND dst IN (FROM g)")
def induced_edges(spark, d):
    e = _strong(spark, d)
    return G.induced(cut(G.giant(_nodes(e), e)), e).select("src", "dst", "weight")


_ALPHA = ENDS + """, ds AS (SELECT id, count(*) AS degree, sum(weight)::DOUBLE AS s FROM n GROUP BY id),
a AS (SELECT n.id, other, weight, degree, CASE WHEN degree > 1 THEN round(pow(1 - CASE WHEN weight / s >= 1 THEN 0.9999::DOUBLE ELSE weight / s END, degree - 1), 12) ELSE 0::DOUBLE END AS alpha FROM n JOIN ds ON n.id = ds.id),
pop AS (SELECT alpha FROM a WHERE degree > 1),
la AS (SELECT least(id, other) AS src, greatest(id, other) AS dst, any_value(weight) AS weight, arg_max(alpha, id) AS alpha FROM a GROUP BY ALL),
h AS (SELECT v AS alpha, sum(k) OVER (ORDER BY v) - k AS less, k FROM (SELECT v, sum(k) AS k FROM (SELECT alpha AS v, count(*) AS k FROM pop GROUP BY ALL UNION ALL SELECT DISTINCT alpha, 0 FROM la) GROUP BY v)),
sc AS (SELECT src, dst, weight, la.alpha, (2 * less + k + CASE WHEN k > 0 THEN 1 ELSE 0 END) * 50.0::DOUBLE / (SELECT count(*) FROM pop) / 100 AS alpha_ptile FROM la JOIN h ON la.alpha = h.alpha)"""


def _disparity(spark, d, kind):
    e = cut(_graph(spark, d, kind))
    return G.disparity(_nodes(e), e)


@query(GS + _ALPHA + " SELECT src, dst, weight, round(alpha, 9) AS alpha FROM sc")
def disparity_alpha(spark, d):
    return _disparity(spark, d, "gs")[0].select("src", "dst", "weight", _r("alpha"))


@query(GS + _ALPHA + ", o AS (SELECT alpha, row_number() OVER (ORDER BY alpha) - 1 AS i FROM pop) SELECT k::INT AS k, round(alpha, 9) AS value FROM range(10) t(k) JOIN o ON o.i = round_even(k / 9.0::DOUBLE * ((SELECT count(*) FROM pop) - 1), 0)")
def alpha_quantiles(spark, d):
    return R.quantiles_nearest(_disparity(spark, d, "gs")[1], "alpha", 10).select("k", _r("value"))


@query(GU + _ALPHA + " SELECT src, dst, round(alpha_ptile, 9) AS alpha_ptile FROM sc")
def alpha_percentile(spark, d):
    return G.member_percentiles(_hours(spark, d), "g", "user_id")


@query(GU + _ALPHA + """, x AS (SELECT * FROM sc WHERE alpha_ptile >= 0.5), k AS (SELECT id FROM (SELECT src AS id FROM x UNION ALL SELECT dst FROM x) GROUP BY id HAVING count(*) >= 10)
SELECT src, dst, weight FROM x WHERE src IN (FROM k) AND dst IN (FROM k)""")
def backbone_cut(spark, d):
    return G.member_backbone(_hours(spark, d), "g", "user_id", 0.5, 10)


_EGO = ENDS + """, top AS (SELECT id FROM n GROUP BY id ORDER BY count(*) DESC, id LIMIT 60),
mem AS (SELECT id AS ego, other AS id FROM n WHERE id IN (FROM top) UNION SELECT id, id FROM top)"""


def _egos(spark, d):
    e = _strong(spark, d)
    top = R.top_k(G.degree_strength(e), 60, [F.desc("degree"), F.col("id")]).select("id")
    return e, cut(G.ego_members(e, cut(top)))


@query(GP2 + _EGO + " SELECT ego, id FROM mem")
def ego_members(spark, d):
    return _egos(spark, d)[1]


@query(GP2 + _EGO + " SELECT a.ego, src, dst, weight FROM e JOIN mem a ON a.id = src JOIN mem b ON b.id = dst AND a.ego = b.ego")
def ego_edges(spark, d):
    return G.ego_edges(*_egos(spark, d))


@query(GP2 + _EGO + ", at AS (SELECT ego, id, row_number() OVER (PARTITION BY ego ORDER BY id) - 1 AS k FROM mem) SELECT a.ego, a.k::INT AS source, b.k::INT AS target, weight AS value FROM e JOIN \"at\" a ON a.id = src JOIN \"at\" b ON b.id = dst AND a.ego = b.ego".replace(", at AS", ', "at" AS'))
def ego_links(spark, d):
    return G.ego_links(*_egos(spark, d))


@query(GP2 + _EGO + """, at AS (SELECT ego, id, row_number() OVER (PARTITION BY ego ORDER BY id) - 1 AS k FROM mem), l AS (SELECT a.ego, a.k AS s, b.k AS t, weight FROM e JOIN "at" a ON a.id = src JOIN "at" b ON b.id = dst AND a.ego = b.ego),
nj AS (SELECT ego, string_agg('{"name":' || id || '}', ',' ORDER BY id) AS n FROM mem GROUP BY ego), lj AS (SELECT ego, string_agg('{"source":' || s || ',"target":' || t || ',"value":' || weight || '}', ',' ORDER BY s, t) AS l FROM l GROUP BY ego)
SELECT ego, '{"nodes":[' || n || '],"links":[' || l || ']}' AS json FROM nj LEFT JOIN lj USING (ego)""".replace(", at AS", ', "at" AS'))
def ego_json(spark, d):
    return G.ego_json(*_egos(spark, d))


def _fifths(e: DataFrame) -> DataFrame:
    return _nodes(e).select("id", (F.col("id") % 5).alias("community"))


@query(GS + ENDS + ", o AS (SELECT id, id % 5 AS c, row_number() OVER (ORDER BY id % 5, id) - 1 AS k FROM (SELECT DISTINCT id FROM n)) SELECT a.k AS i, b.k AS j, weight, a.c = b.c AS same FROM e JOIN o a ON a.id = src JOIN o b ON b.id = dst")
def adjacency_coo(spark, d):
    e = cut(_graph(spark, d, "gs"))
    return G.adjacency_coo(e, _fifths(e))


@query(GS + ENDS + """, t AS (SELECT id % 5 AS c, sum(weight)::DOUBLE AS d FROM n GROUP BY ALL), i AS (SELECT src % 5 AS c, sum(weight)::DOUBLE AS l FROM e WHERE src % 5 = dst % 5 GROUP BY ALL),
mm AS (SELECT sum(weight)::DOUBLE AS m FROM e) SELECT round(sum(coalesce(l, 0) / m - pow(d / (2 * m), 2)), 9) AS modularity FROM t LEFT JOIN i USING (c), mm""")
def modularity_fixed_partition(spark, d):
    e = cut(_graph(spark, d, "gs"))
    return G.modularity(e, _fifths(e)).select(_r("modularity"))


@query()
def louvain(spark, d):
    e = cut(_graph(spark, d, "gs"))
    return G.louvain(_nodes(e), e)


@query()
def betweenness(spark, d):
    e = _backbone(spark, d)
    return G.betweenness(_nodes(e), e)


@query()
def spring_layout(spark, d):
    return L.spring_layout(G.ego_edges(*_egos(spark, d)), "ego")


# ---- tables

@query("SELECT (year(o_orderdate) // 10 * 10)::INT AS decade, count(*) AS n FROM orders WHERE year(o_orderdate) > 0 AND year(o_orderdate) < 2021 GROUP BY ALL")
def decade_histogram(spark, d):
    y = F.year("o_orderdate")
    return table(spark, d, "orders").where((y > 0) & (y < 2021)).groupBy(X.decade(y).alias("decade")).agg(F.count(F.lit(1)).alias("n"))


_TITLE = r"array_to_string(list_transform(regexp_extract_all({c}, '\p{{L}}+|[^\p{{L}}]+'), lambda x: replace(upper(x[1]), 'ẞ', 'Ss') || lower(x[2:])), '')"


@query(f"SELECT {_TITLE.format(c='p_name')} AS key, min(p_partkey) AS value FROM part WHERE NOT contains({_TITLE.format(c='p_name')}, 'Red ') GROUP BY ALL")
def first_wins_names(spark, d):
    return R.first_wins(table(spark, d, "part"), X.title_case(F.col("p_name")), "p_partkey", exclude="Red ")


@query("SELECT p_name, max_by(p_brand, p_partkey) AS p_brand FROM part GROUP BY p_name")
def last_wins_brand(spark, d):
    return R.last_wins(table(spark, d, "part"), "p_name", "p_brand", "p_partkey")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') AND l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)")
def referential_filter(spark, d):
    o = table(spark, d, "orders").where("o_orderstatus = 'F'")
    s = table(spark, d, "supplier").where("s_acctbal > 0")
    return R.referential_filter(table(spark, d, "lineitem"), ("l_orderkey", o, "o_orderkey"), ("l_suppkey", s, "s_suppkey")).select("l_orderkey", "l_linenumber")


@query("""WITH t AS (SELECT min(p_partkey) AS id, p_name AS name FROM part WHERE p_size <= 25 GROUP BY p_name), n AS (SELECT DISTINCT p_name AS name FROM part WHERE p_name NOT IN (SELECT name FROM t))
SELECT id, name FROM t UNION ALL SELECT (SELECT max(id) FROM t) + row_number() OVER (ORDER BY name), name FROM n""")
def get_or_create(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), "p_size")
    return R.get_or_create(p.where("p_size <= 25").groupBy("name").agg(F.min("id").alias("id")), p, "name", "id")


@query("SELECT DISTINCT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def seen_set_anti(spark, d):
    seen = table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").join(seen, "c_custkey", "left_anti").select("c_custkey").distinct()


_SQ = r"trim(regexp_replace({c}, '[\s\p{{Z}}]+', ' ', 'g'))"


@query(f"SELECT doc_id, sha256({_TITLE.format(c='text')}) AS titled FROM documents")
def title_case(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2(X.title_case(F.col("text")), 256).alias("titled"))


@query(f"SELECT page_id, {_SQ.format(c='html')} AS squashed FROM pages")
def squash_ws(spark, d):
    return table(spark, d, "pages").select("page_id", X.squash_ws(F.col("html")).alias("squashed"))


@query(r"SELECT doc_id, sha256(regexp_replace(text, '[^\p{L}\p{N}_]+', '', 'g')) AS word FROM documents")
def strip_nonword(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2(X.strip_nonword(F.col("text")), 256).alias("word"))


_RAW = "CASE p_partkey % 3 WHEN 0 THEN p_name WHEN 1 THEN p_name || ' (' || p_brand || ')  x' ELSE p_name || ' (' || p_brand END"


@query(f"""WITH r AS (SELECT p_partkey, {_RAW} AS c FROM part), i AS (SELECT *, regexp_extract(c, '[(]([^)]*)[)]', 1) AS aka FROM r)
SELECT p_partkey, trim(regexp_replace(CASE WHEN aka = '' THEN c ELSE replace(replace(replace(c, '(', ''), ')', ''), aka, '') END, ' +', ' ', 'g')) AS name, CASE WHEN aka = '' THEN 'None' ELSE aka END AS aka FROM i""")
def alias_split(spark, d):
    named = table(spark, d, "part").select("p_partkey", X.split_alias(F.expr(_RAW)).alias("s"))
    return named.select("p_partkey", "s.name", "s.aka")


_TOK = r"list_filter(regexp_split_to_array(lower(text), '\s+'), lambda w: w <> '')"
_TERMS = f"WITH t AS (SELECT lang AS \"group\", unnest({_TOK}) AS term FROM documents), c AS (SELECT \"group\", term, count(*) AS n FROM t GROUP BY ALL)"


@query(_TERMS + " SELECT \"group\", term, n FROM c WHERE n > 2 QUALIFY row_number() OVER (PARTITION BY \"group\" ORDER BY n DESC, term) <= 200")
def term_freq_top200(spark, d):
    return C.term_freq(table(spark, d, "documents"), "lang", "text")


@query(_TERMS + " SELECT \"group\", term, n FROM c WHERE n > 2 AND term NOT IN ('the', 'of', 'and', 'de', 'la', 'der', 'die') QUALIFY row_number() OVER (PARTITION BY \"group\" ORDER BY n DESC, term) <= 50")
def word_cloud_terms(spark, d):
    return C.term_freq(table(spark, d, "documents"), "lang", "text", k=50, stop=["the", "of", "and", "de", "la", "der", "die"])


@query(_TERMS + " SELECT \"group\", sum(n)::BIGINT AS n FROM c WHERE length(term) > 2 GROUP BY ALL")
def min_len_filter(spark, d):
    return C.term_counts(table(spark, d, "documents"), "lang", "text", min_len=3).groupBy("group").agg(F.sum("n").alias("n"))


_SKIP = f"""WITH d AS (SELECT {_TOK} AS w FROM documents), sp AS (SELECT w[i] AS a, w[i + k] AS b FROM (SELECT w, unnest(range(1, len(w))) AS i FROM d), range(1, 5) t(k) WHERE i + k <= len(w)),
s AS (SELECT a, b, count(*) AS n FROM sp GROUP BY ALL HAVING count(*) > 2)"""


@query(_SKIP + " SELECT a, b, n FROM s")
def skipgram_counts(spark, d):
    return C.skipgrams(table(spark, d, "documents"), "text")


@query(_SKIP + ", e AS (SELECT least(a, b) AS src, greatest(a, b) AS dst, sum(n) AS weight FROM s WHERE a <> b GROUP BY ALL)" + ENDS + _rank_sql("weight", 10) + " SELECT id, round(r, 9) AS rank FROM r10")
def word_graph_pagerank_k10(spark, d):
    pairs = cut(C.skipgrams(table(spark, d, "documents"), "text"))
    return C.word_pagerank(pairs, fixed_iters=10).select("id", _r("rank"))


@query(_TERMS + """, f AS (SELECT term, sum(n) AS f FROM c GROUP BY term), g AS (SELECT "group", sum(n) AS g FROM c GROUP BY ALL)
SELECT "group", term, n, round(log2((n / g::DOUBLE) / (f / (SELECT sum(n) FROM c)::DOUBLE)), 9) AS score FROM c JOIN f USING (term) JOIN g USING ("group")""")
def keyness_logratio(spark, d):
    return C.keyness(C.term_counts(table(spark, d, "documents"), "lang", "text")).select("group", "term", "n", _r("score"))


@query(f"WITH t AS (SELECT DISTINCT doc_id, unnest({_TOK}) AS term FROM documents) SELECT term, count(*) AS df FROM t GROUP BY term HAVING count(*) >= 2")
def vocab_bow(spark, d):
    return C.vocabulary_bags(table(spark, d, "documents"), "doc_id", "text")[0].select("term", "df")


@query("SELECT lang AS \"group\", doc_id AS ord, md5(text) AS digest FROM documents WHERE length(text) > 40")
def corpus_by_group(spark, d):
    return C.corpus(table(spark, d, "documents"), "lang", "doc_id", "text").select("group", "ord", F.md5("text").alias("digest"))


@query()
def lda_topics(spark, d):
    return C.lda_topics(table(spark, d, "documents"), "doc_id", "text")


_LINKS = """WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, '(?i)<a[^>]*href="([^"]*)"', 1)) AS href FROM pages)"""


@query(_LINKS + " SELECT page_id, href, count(*) AS n FROM l GROUP BY ALL")
def page_links(spark, d):
    return table(spark, d, "pages").select("page_id", F.explode(H.links(F.col("html"))).alias("href")).groupBy("page_id", "href").agg(F.count(F.lit(1)).alias("n"))


@query(rf"SELECT page_id, {_SQ.format(c='''regexp_extract(html, '(?i)<title>([^<]*)</title>', 1)''')} AS title FROM pages")
def page_titles(spark, d):
    return table(spark, d, "pages").select("page_id", H.title(F.col("html")).alias("title"))


@query(_LINKS + " SELECT DISTINCT href FROM l WHERE starts_with(href, '/') AND NOT ends_with(href, '.html') AND length(href) > 3")
def link_filter_frontier(spark, d):
    links = table(spark, d, "pages").select(F.explode(H.links(F.col("html"))).alias("href"))
    return links.where(F.col("href").startswith("/") & ~F.col("href").endswith(".html") & (F.length("href") > 3)).distinct()


@query("SELECT event_id, (props->>'$.k')::BIGINT AS k FROM events")
def event_props_json(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query(r"SELECT conv_id, string_agg(role || ': ' || trim(text), chr(10) ORDER BY turn, role, text) AS dialogue FROM conversations GROUP BY conv_id")
def dialogues(spark, d):
    c = table(spark, d, "conversations").select("conv_id", F.struct("turn", "role", "text").alias("t"))
    parts = F.transform(F.sort_array(F.collect_list("t")), lambda t: F.concat(t["role"], F.lit(": "), F.trim(t["text"])))
    return c.groupBy("conv_id").agg(F.array_join(parts, "\n").alias("dialogue"))


@query("""WITH u AS (SELECT event_type AS g, user_id FROM events), t AS (SELECT g, count(*) AS n FROM u GROUP BY ROLLUP (g)) SELECT coalesce(g, 'all') AS g, n FROM t""")
def merged_counts_rollup(spark, d):
    return table(spark, d, "events").rollup(F.col("event_type").alias("g")).agg(F.count(F.lit(1)).alias("n")).select(F.coalesce("g", F.lit("all")).alias("g"), "n")


# ---- layout

def _points(spark, d) -> DataFrame:
    e = table(spark, d, "embeddings")
    return e.select(F.col("vec_id").alias("id"), F.col("label").alias("link"), *[F.col("embedding")[k].cast("double").alias(c) for k, c in enumerate(L.XYZ)])


_P = "WITH p AS (SELECT vec_id AS id, label AS link, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z FROM embeddings)"
_PAIRS = _P + """, q AS (SELECT a.id AS i, b.id AS j, a.x - b.x AS dx, a.y - b.y AS dy, a.z - b.z AS dz FROM p a JOIN p b ON a.id <> b.id),
d AS (SELECT *, sqrt(dx * dx + dy * dy + dz * dz) AS d FROM q WHERE sqrt(dx * dx + dy * dy + dz * dz) <= 0.03::DOUBLE)"""
_SCALE = ", ".join(f"round(({c} - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER ()) * 1000 - 500, 6) AS {c}" for c in "xyz")


def _f(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@query(_P + f" SELECT id, {_SCALE} FROM p")
def rescale_coords(spark, d):
    return _f(R.minmax(_points(spark, d), list(L.XYZ), -500.0, 500.0).drop("link"))


@query(GS + " SELECT src, dst, round((weight - min(weight) OVER ()) / (max(weight) OVER () - min(weight) OVER ())::DOUBLE * 4 + 1, 9) AS weight FROM e")
def minmax_1_5(spark, d):
    return R.minmax(cut(_graph(spark, d, "gs").withColumn("weight", F.col("weight").cast("double"))), ["weight"], 1.0, 5.0).select("src", "dst", _r("weight"))


@query(_PAIRS + " SELECT i, j, round(d, 6) AS d FROM d")
def pair_distance(spark, d):
    return _f(L.pairs_within(_points(spark, d), 0.03).select("i", "j", "d"))


@query(_PAIRS.replace("0.03", "0.06") + ", f AS (SELECT *, 300 * pow(d / 0.02::DOUBLE, 0) * exp(-pow(d / 0.02::DOUBLE, 2)) / 0.02::DOUBLE AS f FROM d) SELECT i AS id, round(sum(f * dx), 6) AS fx, round(sum(f * dy), 6) AS fy, round(sum(f * dz), 6) AS fz FROM f GROUP BY i")
def repulsion_short(spark, d):
    return _f(L.repulsion(L.pairs_within(_points(spark, d), 0.06), 300.0, 2.0, 0.02))


_CHAIN = _P + ", o AS (SELECT *, lead(id) OVER (PARTITION BY link ORDER BY id) AS nxt FROM p), e AS (SELECT id AS src, nxt AS dst FROM o WHERE nxt IS NOT NULL)"


_chain = L.chain


@query(_CHAIN + """, n AS (SELECT src AS i, dst AS j FROM e UNION ALL SELECT dst, src FROM e) SELECT i AS id, round(sum(-50 * (a.x - b.x)), 6) AS fx, round(sum(-50 * (a.y - b.y)), 6) AS fy, round(sum(-50 * (a.z - b.z)), 6) AS fz
FROM n JOIN p a ON a.id = i JOIN p b ON b.id = j GROUP BY i""")
def spring_force(spark, d):
    p = _points(spark, d)
    return _f(L.springs(p, _chain(p), 50.0))


_CELL = _P + ", c AS (SELECT *, floor(x / 0.05::DOUBLE)::BIGINT AS cx, floor(y / 0.05::DOUBLE)::BIGINT AS cy, floor(z / 0.05::DOUBLE)::BIGINT AS cz FROM p)"


@query(_CELL + " SELECT id, cx, cy, cz FROM c")
def bin_points(spark, d):
    return L.cells(_points(spark, d), 0.05).select("id", "cx", "cy", "cz")


@query(_CELL + " SELECT a.id AS i, b.id AS j FROM c a JOIN c b USING (cx, cy, cz) WHERE a.link <> b.link AND a.id < b.id")
def bin_pairs(spark, d):
    return L.bin_pairs(_points(spark, d), 0.05)


@query(_CELL + " SELECT cx, cy, cz, count(DISTINCT link) AS links, count(*) AS points FROM c GROUP BY ALL HAVING count(DISTINCT link) > 1")
def multi_link_bins(spark, d):
    return L.multi_link_bins(_points(spark, d), 0.05)


def _segments(spark, d) -> DataFrame:
    p = _points(spark, d)
    e = _chain(p)
    end = lambda k, s: p.select(F.col("id").alias(k), *[F.col(c).alias(f"{c}{s}") for c in L.XYZ])
    return e.join(end("src", 1), "src").join(end("dst", 2), "dst").withColumnRenamed("src", "link")


_SEG = _CHAIN + ", s AS (SELECT src AS link, a.x AS x1, a.y AS y1, a.z AS z1, b.x AS x2, b.y AS y2, b.z AS z2 FROM e JOIN p a ON a.id = src JOIN p b ON b.id = dst)"


@query(_SEG + ", q AS (SELECT link, k AS seg, x1 + (x2 - x1) * (k / 4.0::DOUBLE) AS x, y1 + (y2 - y1) * (k / 4.0::DOUBLE) AS y, z1 + (z2 - z1) * (k / 4.0::DOUBLE) AS z FROM s, range(5) t(k)) SELECT link, seg::INT AS seg, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z FROM q")
def polyline_init(spark, d):
    return _f(L.polyline(_segments(spark, d), 5))


@query(_P + """ SELECT link, id AS seg, round(50 * (coalesce(lag(x) OVER w - x, 0) + coalesce(lead(x) OVER w - x, 0)), 6) AS fx, round(50 * (coalesce(lag(y) OVER w - y, 0) + coalesce(lead(y) OVER w - y, 0)), 6) AS fy,
round(50 * (coalesce(lag(z) OVER w - z, 0) + coalesce(lead(z) OVER w - z, 0)), 6) AS fz FROM p WINDOW w AS (PARTITION BY link ORDER BY id)""")
def link_spring(spark, d):
    return _f(L.link_springs(_points(spark, d).withColumnRenamed("id", "seg"), 50.0))


@query(_SEG + ", q AS (SELECT *, sqrt((x2-x1)*(x2-x1) + (y2-y1)*(y2-y1) + (z2-z1)*(z2-z1)) AS n FROM s) SELECT link, round((x1 + x2) / 2, 6) AS x, round((y1 + y2) / 2, 6) AS y, round((z1 + z2) / 2, 6) AS z, round(n, 6) AS length, round(atan2(y2 - y1, x2 - x1), 6) AS phi, round(acos((z2 - z1) / n), 6) AS theta FROM q")
def cylinder_geometry(spark, d):
    return _f(L.cylinders(_segments(spark, d)))


@query(_P + " SELECT id, trunc(x * 1000)::BIGINT AS x, trunc(y * 1000)::BIGINT AS y, trunc(z * 1000)::BIGINT AS z FROM p")
def truncate_coords(spark, d):
    return _points(spark, d).select("id", *[(F.col(c) * 1000).cast("long").alias(c) for c in L.XYZ])


@query(_SEG + " SELECT round(sum(sqrt((x2-x1)*(x2-x1) + (y2-y1)*(y2-y1) + (z2-z1)*(z2-z1))), 6) AS length FROM s")
def total_link_length(spark, d):
    p = _points(spark, d)
    return _f(L.link_length(p, _chain(p)))


_TRACE = """WITH t AS (SELECT event_type, date_trunc('day', ts) AS day, sum(abs(value)) AS s FROM events GROUP BY ALL), u AS (SELECT event_type, day AS it, sum(s) OVER (PARTITION BY event_type ORDER BY day) + 1 AS v FROM t),
y AS (SELECT *, ln(v) AS y FROM u), g AS (SELECT *, CASE WHEN lag(y) OVER w IS NULL THEN lead(y) OVER w - y WHEN lead(y) OVER w IS NULL THEN y - lag(y) OVER w ELSE (lead(y) OVER w - lag(y) OVER w) / 2 END AS d1 FROM y WINDOW w AS (PARTITION BY event_type ORDER BY it)),
k AS (SELECT *, CASE WHEN lag(d1) OVER w IS NULL THEN lead(d1) OVER w - d1 WHEN lead(d1) OVER w IS NULL THEN d1 - lag(d1) OVER w ELSE (lead(d1) OVER w - lag(d1) OVER w) / 2 END AS d2 FROM g WINDOW w AS (PARTITION BY event_type ORDER BY it))"""


def _trace(spark, d) -> DataFrame:
    from pyspark.sql import Window as W

    day = table(spark, d, "events").groupBy("event_type", F.date_trunc("day", "ts").alias("it")).agg(F.sum(F.abs("value")).alias("s"))
    return day.select("event_type", "it", (F.sum("s").over(W.partitionBy("event_type").orderBy("it")) + 1).alias("v"))


@query(_TRACE + " SELECT event_type, it, round(d1, 6) AS d1, round(d2, 6) AS d2 FROM k")
def trace_gradient(spark, d):
    return _f(L.trace_gradient(_trace(spark, d), part="event_type").drop("v"))


@query(_TRACE + ", h AS (SELECT *, ntile(2) OVER (PARTITION BY event_type ORDER BY it) AS h FROM k), a AS (SELECT event_type, avg(d1) AS grad, avg(d2) AS curve, avg(d1) FILTER (h = 1) AS first, avg(d1) FILTER (h = 2) AS second FROM h GROUP BY event_type) SELECT event_type, round(grad, 6) AS grad, round(curve, 6) AS curve, round(first, 6) AS first, round(second, 6) AS second, abs(grad) < 0.02 AND abs(first) < 0.04 AND abs(second) < 0.04 AS converged FROM a")
def convergence_check(spark, d):
    return _f(L.converged(L.trace_gradient(_trace(spark, d), part="event_type"), 0.02, "event_type"))


@query()
def ellipsoid_forces(spark, d):
    s = _segments(spark, d)
    p = s.select(F.col("link").alias("id"), F.col("link"), *[((F.col(f"{c}1") + F.col(f"{c}2")) / 2).alias(c) for c in L.XYZ], *[(F.col(f"{c}2") - F.col(f"{c}1")).alias(f"t{c}") for c in L.XYZ])
    return L.ellipsoid_forces(p, 0.05)


@query()
def force_simulation(spark, d):
    p = _points(spark, d)
    return L.simulate(p, _chain(p), rounds=3, k=0.01, amplitude=0.001, radius=0.02)[0]


@query("SELECT date_trunc('hour', ts) AS hour, count(DISTINCT user_id) AS users, count(*) AS events FROM events GROUP BY ALL")
def hourly_users(spark, d):
    from quillnet.streaming.cooccurrence import hourly_users as hourly

    return hourly(table(spark, d, "events"))


from quillnet.plans import exports, forces, languages, pages, records, wordlists  # noqa: E402, F401
