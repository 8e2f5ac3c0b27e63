"""Pages as rows of elements: one pass over a page with a stack of open elements, as a table function.

``elements`` joins it laterally; what is asked of a page (links, classes, tables, lists) is then asked of its rows in Spark.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from quillnet.functions.text import py_strip, squash_ws, strip_nonword

# Fixed values of the HTML standard: elements without content, of raw text, and what an opening tag closes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style".split())
BLOCKS = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "tr": {"tr"}, "td": {"td", "th"}, "th": {"td", "th"},
    "tbody": {"thead", "tbody"}, "tfoot": {"thead", "tbody"}, **{b: {"p"} for b in BLOCKS},
}
BARRIERS = frozenset("article body div dl footer html main nav ol section select table td th ul".split())

_MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|</([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)|<([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)(>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s/=>\"'][^\s/=>]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>][^\s>]*)))?", re.S)


def markup(page: str, written: bool = False) -> Iterator[tuple[str, str, dict | None]]:
    """("text", text, None), ("raw", text, None), ("start", tag, attributes) and ("end", tag, None), in order. written: texts keep their references."""
    at, raw = 0, None
    while at < len(page):
        if raw:
            close = re.compile(rf"</{raw}(?=[\s/>]|\Z)", re.I).search(page, at)
            end = close.start() if close else len(page)
            if end > at:
                yield "raw", page[at:end], None
            at, raw = end, None
            continue
        found = _MARKUP.search(page, at)
        end = found.start() if found else len(page)
        if end > at:
            yield "text", page[at:end] if written else unescape(page[at:end]), None
        if not found:
            return
        at = found.end()
        if found[1]:
            yield "end", found[1].lower(), None
        elif found[2] and found[4]:
            tag, attributes = found[2].lower(), {}
            for m in _ATTRIBUTE.finditer(found[3]):
                value = next((v for v in m.groups()[1:] if v is not None), None)
                attributes.setdefault(m[1].lower(), None if value is None else unescape(value))
            yield "start", tag, attributes
            raw = tag if tag in RAW else None


ELEMENT = "ord int, parent int, depth int, tag string, attrs map<string,string>, text string"


@udtf(returnType=ELEMENT, useArrow=True)
class HtmlElements:
    """Elements of a page: number in order of their opening tags from 0, parent's number (null at the top), depth, attributes, text.

    text: all text inside, that of scripts and styles only in their own; a space stands where a tag was. ``only``: tags, separated by
    commas; others are followed but not returned. An opening tag closes what the standard says it closes; an end tag without an
    open element is passed over, and what is open at the end closes there. Null gives no rows. ``written``: texts keep their references
    (``&amp;`` and such) as they are written.
    """

    def eval(self, page: str, only: str | None = None, written: bool = False):
        if page is None:
            return
        wanted = set(only.lower().split(",")) if only else None
        open_, pieces, n = [], [], 0

        def close(down_to: int):
            while len(open_) > down_to:
                k, parent, depth, tag, attributes, begin = open_.pop()
                if wanted is None or tag in wanted:
                    yield k, parent, depth, tag, attributes, " ".join(pieces[begin:])

        for kind, value, attributes in markup(page, bool(written)):
            if kind == "text":
                pieces.append(value)
            elif kind == "raw":
                if open_ and open_[-1][3] in RAW:
                    *head, _ = open_.pop()
                    if wanted is None or head[3] in wanted:
                        yield (*head, value)
            elif kind == "end":
                k = next((i for i in range(len(open_) - 1, -1, -1) if open_[i][3] == value), None)
                if k is not None:
                    yield from close(k)
            else:
                gone = CLOSES.get(value, ())
                for i in range(len(open_) - 1, -1, -1):
                    if open_[i][3] in gone:
                        yield from close(i)
                        break
                    if open_[i][3] in BARRIERS and not (value in ("tr", "tbody", "tfoot") and open_[i][3] in ("td", "th")):
                        break
                open_.append((n, open_[-1][0] if open_ else None, len(open_), value, attributes, len(pieces)))
                n += 1
                if value in VOID:
                    yield from close(len(open_) - 1)
        yield from close(0)


# One page always gives the same rows, which lets Spark use the function inside lateral subqueries.
HtmlElements = HtmlElements.asDeterministic()


def elements(pages: DataFrame, html: str, only: tuple[str, ...] = (), written: bool = False) -> DataFrame:
    """pages less the html column, a row for each element (of the tags in ``only``, or of all); written: texts keep their references."""
    return pages.lateralJoin(HtmlElements(F.col(html).outer(), F.lit(",".join(only) or None).cast("string"), F.lit(written))).drop(html)


def attribute(name: str) -> Column:
    """An attribute of an element; null where it has none, empty where it has no value."""
    attrs = F.col("attrs")
    return F.when(F.map_contains_key(attrs, name), F.coalesce(F.try_element_at(attrs, F.lit(name)), F.lit("")))


def has_class(name: str) -> Column:
    return F.coalesce(F.array_contains(F.split(F.coalesce(attribute("class"), F.lit("")), r"\s+"), name), F.lit(False))


def links(found: DataFrame) -> DataFrame:
    """Anchors with an href: href and text beside the other columns."""
    rest = [c for c in found.columns if c not in ("attrs", "text", "tag", "parent", "depth")]
    return found.where((F.col("tag") == "a") & attribute("href").isNotNull()).select(*rest, attribute("href").alias("href"), squash_ws(F.col("text")).alias("text"))


def class_texts(found: DataFrame, name: str, tag: str | None = None) -> DataFrame:
    """Texts of the elements of a class (and tag), nested ones too."""
    rest = [c for c in found.columns if c not in ("attrs", "text", "tag", "parent", "depth")]
    of_tag = F.col("tag") == tag if tag else F.lit(True)
    return found.where(of_tag & has_class(name)).select(*rest, squash_ws(F.col("text")).alias("text"))


def titles(found: DataFrame, keys: list[str], suffixes: tuple[str, ...] = ()) -> DataFrame:
    """keys and the first title of each page, less the first of the suffixes that it ends in."""
    first = found.where("tag = 'title'").groupBy(*keys).agg(F.min_by("text", "ord").alias("title"))
    title = squash_ws(F.col("title"))
    bare = F.lit(None).cast("string")
    for s in reversed(suffixes):
        bare = F.when(title.endswith(s), F.substring(title, F.lit(1), F.length(title) - len(s))).otherwise(bare)
    return first.select(*keys, py_strip(F.coalesce(bare, title)).alias("title"))


def label_values(found: DataFrame, keys: list[str], label: Column | None = None) -> DataFrame:
    """keys, ord, label, value: each label cell of a table with every line, that is not empty, of the cell beside it.

    A label is a th, or a td of class ``attrLabels``, or what ``label`` says; the cell beside it is the next td or th of its row.
    A label is written with its word characters only.
    """
    is_label = label if label is not None else (F.col("tag") == "th") | has_class("attrLabels")
    cells = found.where(F.col("tag").isin("td", "th")).select(*keys, "parent", F.struct("ord", is_label.alias("label"), "text").alias("cell"))
    rows = cells.groupBy(*keys, "parent").agg(F.sort_array(F.collect_list("cell")).alias("cells"))
    pairs = F.transform(F.slice("cells", F.lit(1), F.size("cells") - 1), lambda c, i: F.struct(c.alias("label"), F.col("cells")[i + 1].alias("value")))
    beside = rows.select(*keys, F.explode(F.filter(pairs, lambda p: p["label"]["label"])).alias("p"))
    lines = beside.select(*keys, F.col("p.label.ord").alias("ord"), strip_nonword(F.col("p.label.text")).alias("label"), F.explode(F.split("p.value.text", "\n")).alias("value"))
    return lines.select(*keys, "ord", "label", squash_ws(F.col("value")).alias("value")).where("value <> ''")


def table_rows(found: DataFrame, keys: list[str]) -> DataFrame:
    """keys, ord and cells (texts in order) of every table row."""
    cells = found.where(F.col("tag").isin("td", "th")).groupBy(*keys, F.col("parent").alias("ord")).agg(F.sort_array(F.collect_list(F.struct("ord", "text"))).alias("c"))
    return cells.select(*keys, "ord", F.transform("c", lambda c: squash_ws(c["text"])).alias("cells"))
