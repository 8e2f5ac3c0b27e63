"""The template tree: depth, merged branches, a rejected template; whole results against SQL over the same pages."""

from oracle import sql_rows
from pyspark.sql import functions as F

from quillnet.llm.sql import OP8
from quillnet.llm.urls import Rule, _in_common, filter_urls


def _pages(spark, urls):
    return spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")


def _tree(spark):
    urls = [f"http://shop.example/a/b/spam/x{k % 7}/deal/{k}" for k in range(60)]
    urls += [f"http://shop.example/a/b/books/x{k % 7}/deal/{k}" for k in range(60)]
    urls += [f"http://shop.example/a/b/tools/x{k % 7}/deal/{k}" for k in range(60)]
    urls += [f"http://shop.example/users/name{'abcdefghijklmnopqrstuvwxyz'[k % 26]}{'qrstuv'[k % 6]}/photos" for k in range(80)]
    return _pages(spark, urls)


def test_deep_templates_merge_and_are_rejected(spark):
    rules = [Rule("block", "shop.example", f"/a/b/spam/x{k}/") for k in range(5)] + [Rule("allow", "shop.example", p) for p in ("/a/b/books/x1", "/a/b/tools/x1")]
    rows = filter_urls(_tree(spark), rules).collect()
    by = {}
    for r in rows:
        by.setdefault(r["template"], []).append(r)
    assert len(rows) == 260
    spam = [r for r in rows if "/spam/" in r["url"] and r["rule"] is None]
    assert spam and all(r["verdict"] == "block" and r["purity"] >= 0.8 for r in spam)  # by their template alone
    others = [r for r in rows if "/spam/" not in r["url"]]
    assert all(r["verdict"] == "allow" for r in others)
    assert any("{books|tools}" in t for t in by)  # alike branches are one
    assert "shop.example/users/*/photos" in by and len(by["shop.example/users/*/photos"]) == 80


def test_tree_equals_sql(spark, tmp_path):
    urls = [f"https://a{k % 3}.example.org/{'en' if k % 4 else 'es'}/{k % 30}/p{k % 5}" for k in range(300)]
    urls += [f"http://b{k % 4}.example.com/{('de', 'fr', 'en')[k % 3]}/t{k % 14}/{k}/end" for k in range(300)]
    urls += [f"http://c.com/{'s%02d' % (k % 25)}/{'de'}/{k}" for k in range(100)] + ["x", None, "http://d.com", "http://d.com/de/", "http://d.com/de/a//b/"]
    _pages(spark, urls).write.parquet(f"{tmp_path}/pages.parquet")
    got = filter_urls(spark.read.parquet(f"{tmp_path}/pages.parquet")).select("page_id", "host", "path", "rule", "verdict")
    assert sorted(repr(tuple(r[c] for c in sorted(got.columns))) for r in got.collect()) == sql_rows(OP8, str(tmp_path), got.columns)


def test_clashing_names_long_and_repeated_urls(spark):
    long = "http://e.org/" + "/".join(f"s{k}" for k in range(3000))
    d = _pages(spark, [long, long, "http://e.org/a"]).select("*", *[F.lit(1).alias(c) for c in ("_m", "_url", "found", "segments", "child", "chain", "page", "Host", "n")])
    rows = filter_urls(d).collect()
    assert len(rows) == 3 and {r["found"] for r in rows} == {1} and {r["host"] for r in rows} == {"e.org"}
    assert [r["path"] for r in rows].count(long[12:]) == 2
    assert filter_urls(_pages(spark, ["http://e.org/a"]), []).first()["purity"] == 0


def _deep(k):
    return "/".join(f"s{i}" for i in range(k))


def test_depth_is_no_bound(spark):
    # Forty pages that differ in the forty-second segment, as a driver's own probe had them: two templates, and two verdicts.
    urls = [f"http://e.org/{_deep(40)}/{('spam', 'ok')[k % 2]}/{'abcdefghijklmnopqrst'[k // 2]}" for k in range(40)]
    rules = [Rule("block", "e.org", f"/{_deep(40)}/spam/{c}") for c in "abcdefghijklmno"] + [Rule("allow", "e.org", f"/{_deep(40)}/ok/{c}") for c in "abcdefghijklmno"]
    rows = filter_urls(_pages(spark, urls), rules).collect()
    free = [r for r in rows if r["rule"] is None]
    assert len(free) == 10 and all((r["verdict"] == "block") == ("/spam/" in r["url"]) for r in free)
    assert {("spam" in r["template"], "ok" in r["template"]) for r in rows} == {(True, False), (False, True)}


def test_deep_tree_equals_sql(spark, tmp_path):
    from quillnet.llm.sql import op8_sql

    urls = [f"http://a.example.org/es/{_deep(10 + k % 3)}/{('x', 'y', 'z')[k % 3]}/{_deep(5)}/p{k % 13}" for k in range(120)]
    urls += [f"http://b.example.com/de/{_deep(18)}", f"http://b.example.com/de/{_deep(17)}", f"http://b.example.com/fr/{_deep(18)}/", "http://b.example.com//", "http://b.example.com"]
    _pages(spark, urls).write.parquet(f"{tmp_path}/pages.parquet")
    got = filter_urls(spark.read.parquet(f"{tmp_path}/pages.parquet")).select("page_id", "host", "path", "rule", "verdict")
    assert sorted(repr(tuple(r[c] for c in sorted(got.columns))) for r in got.collect()) == sql_rows(op8_sql(22), str(tmp_path), got.columns)


def test_what_paths_have_in_common(spark):
    df = spark.createDataFrame([(["a", "b"], ["a", "b", "c"]), (["a"], ["b"]), (["a", "x"], ["a", "y"]), (["q"], ["q"]), (["*", "a"], ["*", "b"])], "l array<string>, m array<string>")
    assert [r[0] for r in df.select(_in_common(F.col("l"), F.col("m"))).collect()] == [2, 0, 1, 1, 1]
