"""Columns that read raw pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillnet.functions.text import squash_ws


def links(html: Column) -> Column:
    """The href of every anchor, in order."""
    return F.regexp_extract_all(html, F.lit(r'(?i)<a[^>]*href="([^"]*)"'), F.lit(1))


def title(html: Column) -> Column:
    return squash_ws(F.regexp_extract(html, r"(?i)<title>([^<]*)</title>", 1))


def plain(fragment: Column) -> Column:
    """The text of a fragment: tags go, the usual entities are read, white space is one space."""
    out = F.regexp_replace(fragment, r"(?s)<[^>]*>", " ")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return squash_ws(out)


def link_texts(html: Column) -> Column:
    """array<struct<href, text>>: every anchor with its text, in order."""
    found = F.regexp_extract_all(html, F.lit(r'(?is)(<a[^>]*href="[^"]*"[^>]*>.*?</a>)'), F.lit(1))
    return F.transform(found, lambda a: F.struct(F.regexp_extract(a, r'(?is)^<a[^>]*href="([^"]*)"', 1).alias("href"), plain(a).alias("text")))


def by_class(html: Column, name: str, tag: str = "[a-z0-9]+") -> Column:
    """Texts of the elements of a class (and tag) that hold no element of the same tag."""
    pattern = rf'(?is)<({tag})\b[^>]*class="(?:[^"]*\s)?{name}(?:\s[^"]*)?"[^>]*>(.*?)</\1>'
    return F.transform(F.regexp_extract_all(html, F.lit(pattern), F.lit(2)), plain)


def cells(html: Column) -> Column:
    """array<array<string>>: the cells of every table row, as they are written."""
    rows = F.regexp_extract_all(html, F.lit(r"(?is)<tr\b[^>]*>(.*?)</tr>"), F.lit(1))
    return F.transform(rows, lambda r: F.regexp_extract_all(r, F.lit(r"(?is)<t[dh]\b[^>]*>(.*?)</t[dh]>"), F.lit(1)))


def label_values(html: Column) -> Column:
    """array<struct<label, value>> of every table row: its first cell, and each line of its second that is not empty."""
    rows = F.filter(cells(html), lambda r: F.size(r) >= 2)
    pairs = F.transform(rows, lambda r: F.transform(F.split(r[1], "\n"), lambda v: F.struct(plain(r[0]).alias("label"), plain(v).alias("value"))))
    return F.filter(F.flatten(pairs), lambda p: p["value"] != "")


def proxies(rows: DataFrame, cells: str = "cells") -> DataFrame:
    """ip:port of the table rows whose seventh cell says yes."""
    c = F.col(cells)
    return rows.where(F.try_element_at(c, F.lit(7)).contains("yes")).select(F.concat_ws(":", c[0], c[1]).alias("proxy")).distinct()


def seed_pages(pagers: DataFrame, initial: str = "initial", last_link: str = "last_link") -> DataFrame:
    """One row for each further index page: 2 to the number at the end of the pager's last link."""
    last = F.regexp_extract(F.col(last_link), r"=(\d+)$", 1).try_cast("int")
    return pagers.withColumn("last", last).where("last >= 2").select(initial, F.explode(F.sequence(F.lit(2), "last")).alias("page"))
