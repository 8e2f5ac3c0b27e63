import html as html_lib
import random
from html.parser import HTMLParser

import pytest
from oracle import rows_of, sql_rows
from pyspark.sql import functions as F

from quillnet.functions import elements as E
from quillnet.functions import surface
from quillnet.operators import frontier
from quillnet.plans.catalogue import ORACLES, QUERIES


class Events(HTMLParser):
    """What the standard library's reader sees."""

    def __init__(self, page):
        super().__init__(convert_charrefs=True)
        self.seen = []
        self.feed(page)
        self.close()

    def handle_starttag(self, tag, attrs):
        first = {}
        for k, v in attrs:
            first.setdefault(k, v)
        self.seen.append(("start", tag, first))

    def handle_endtag(self, tag):
        self.seen.append(("end", tag, None))

    def handle_data(self, data):
        self.seen.append(("text", data, None))


def merged(events):
    out = []
    for kind, value, attrs in events:
        kind = "text" if kind == "raw" else kind
        if kind == "text" and out and out[-1][0] == "text":
            out[-1] = ("text", out[-1][1] + value, None)
        else:
            out.append((kind, value, attrs))
    return out


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_reader_equals_the_standard_librarys_on_every_page(spark, sf):
    pages = [r[0] for r in spark.read.parquet(f"/root/testdata/{sf}/pages.parquet").select("html").collect()]
    assert len(pages) >= 50
    for p in pages:
        assert merged(E.markup(p)) == merged(Events(p).seen)


def test_reader_on_odd_markup():
    for p in (
        "<a href='x'>1</a><a href=y>2</a><a href = \"z&amp;q\">3</a><a HREF>4</a>",
        "<p title='a > b' class=\"c\nd\">t &lt;b&gt; &eacute;&#233;&#x e9;</p><br>x",
        "<!-- <a href=no> --><!DOCTYPE html><script>if (a < b) '</p>'</script><style>p > a {}</style>end",
        "a < b and 1 <2 & 3 <", "<div id=1 id=2 data-x='\"'></div ><p",
    ):
        mine = [(k, v, a) for k, v, a in merged(E.markup(p)) if k != "text"]
        theirs = [(k, v, a) for k, v, a in merged(Events(p).seen) if k != "text"]
        assert mine == theirs, p


def test_every_way_of_quoting_nesting_and_no_page(spark):
    df = spark.createDataFrame([(1, "<div class='ad x'>a<div>b<p>c</div>d</div><a href=q>k</a><A HREF='z&amp;1'>l <b>m</A>n"), (2, None), (3, ""), (4, "</a></div>x<b>")], "id long, html string")
    e = E.elements(df, "html")
    assert sorted((r["id"], r["href"], r["text"]) for r in E.links(e).collect()) == [(1, "q", "k"), (1, "z&1", "l m")]
    assert [(r["id"], r["text"]) for r in E.class_texts(e, "ad", "div").collect()] == [(1, "a b c d")]
    assert {r["id"] for r in e.collect()} == {1, 4}
    assert sorted((r["tag"], r["depth"]) for r in e.where("id = 1").collect()) == [("a", 0), ("a", 0), ("b", 1), ("div", 0), ("div", 1), ("p", 2)]


def test_tables(spark):
    page = "<table><tr><th>A b:<td class='x'>1<br>\n2</td><tr><td CLASS=\"y attrLabels\">C</td><td>v <table><tr><td>in</table> w<tr><td>no<td>z</table>"
    e = E.elements(spark.createDataFrame([(1, page)], "id long, html string"), "html")
    assert sorted((r["label"], r["value"]) for r in E.label_values(e, ["id"]).collect()) == [("Ab", "1"), ("Ab", "2"), ("C", "v in w")]
    assert sorted(r["cells"] for r in E.table_rows(e, ["id"]).collect()) == [["A b:", "1 2"], ["C", "v in w"], ["in"], ["no", "z"]]


def test_titles_lose_one_suffix(spark):
    df = spark.createDataFrame([(1, "<title> A  song - Site\n</title><title>b</title>"), (2, "<title>- Site</title>"), (3, "<p>")], "id long, html string")
    got = {r["id"]: r["title"] for r in E.titles(E.elements(df, "html", ("title",)), ["id"], (" - Site", "Site")).collect()}
    assert got == {1: "A song", 2: "-"}


def test_random_text_comes_back(spark):
    rng = random.Random(2)
    texts = ["".join(rng.choice("ab <>&\"'é\n/=") for _ in range(rng.randrange(1, 40))) for _ in range(200)]
    df = spark.createDataFrame([(i, f"<x><q t=\"{html_lib.escape(t)}\">{html_lib.escape(t)}</q>") for i, t in enumerate(texts)], "id long, html string")
    rows = E.elements(df, "html", ("q",)).select("id", E.attribute("t").alias("t"), "text").collect()
    assert {r["id"]: (r["t"], r["text"]) for r in rows} == {i: (t, t) for i, t in enumerate(texts)}


def test_functions_by_name(spark):
    assert "decade" in surface.register(spark) and surface.register(spark)
    r = spark.sql("""SELECT decade(1987) a, decade(87) b, decade(NULL) c, pos_class('[/V]Past|N') d, pos_class('Adj_x') e, pos_class('N_Sg') f, disparity_significance(0.25D, 3D) g,
        disparity_significance(1D, 3D) h, disparity_significance(0.5D, 1D) i, vec_len(array(3D, 4D)) j, cylinder(0, 0, 0, 3, 4, 0).length k, clamp_distance(130, 100) l, squash_ws(' a \n b') m""").first()
    assert tuple(r) == (1980, 0, 0, "V", "Adj", "N", pytest.approx(0.5625), None, None, pytest.approx(5), 5.0, 30.0, "a b")
    assert spark.sql("SELECT count(*), sum(x + y + z), count(DISTINCT id) FROM lattice(3)").first()[:] == (27, 81, 27)
    words = spark.createDataFrame([("V_x",), ("Adv",)], "t string")
    assert [x[0] for x in spark.sql("SELECT pos_class(t) FROM {w}", w=words).collect()] == ["V", "Adv"]


def test_reach_by_brute_force(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(90)] + [(None, 3), (4, None), (5, 5)]
    barred, seeds = {7, 8, 1}, {0, 1, 2}
    depth, now, k = {s: 0 for s in seeds - barred}, seeds - barred, 0
    while now:
        k += 1
        now = {b for a, b in edges if a in now and b is not None} - barred - set(depth)
        depth |= dict.fromkeys(now, k)
    df = frontier.reach(spark.createDataFrame([(s,) for s in [*seeds, *seeds, None]], "id long"), spark.createDataFrame(edges, "src long, dst long"), stop=spark.createDataFrame([(b,) for b in barred], "x long"))
    assert {r["id"]: r["depth"] for r in df.collect()} == depth and df.count() == len(depth)


def test_bitmap_never_calls_a_seen_key_new(spark):
    seen = spark.range(0, 3000, 3)
    held = frontier.bitmap(seen, "id", 12)
    marked = frontier.surely_new(spark.range(3000), "id", held, 12)
    assert marked.where("_new AND id % 3 = 0").count() == 0 and marked.where("_new").count() > 1000


@pytest.mark.parametrize("name", ["html_links", "html_tags", "html_items", "html_titles", "crawl_frontier"])
def test_larger_table(spark, name):
    df = QUERIES[name](spark, "/root/testdata/sf0.01")
    assert rows_of(df) == sql_rows(ORACLES[name], "/root/testdata/sf0.01", df.columns)
    assert df.select(F.count(F.lit(1))).first()[0] > 20


def test_titles_read_only_whole_references(spark, tmp_path):
    """A title that was cut inside a reference, one with a tag, an empty page and none: as the query's SQL has them."""
    heads = ["a &amp;&amp", "b &am", "c &lt;x&gt; <b>d</b> that.", "e &amp;lt; &eacute; &copy.", ""]
    pages = [(k, "u", f"<html><head><title>{t}</title></head><p>x &amp y</p></html>") for k, t in enumerate(heads)] + [(10, "u", "<p>no title</p>"), (11, "u", ""), (12, "u", None)]
    spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    df = QUERIES["html_titles"](spark, str(tmp_path))
    assert rows_of(df) == sql_rows(ORACLES["html_titles"], str(tmp_path), df.columns)
    assert [r["text"] for r in E.elements(df.select(F.lit("<p>x &amp y").alias("h")).limit(1), "h").collect()] == ["x & y"]
