"""String columns: cleaning, naming and bucketing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPACE = r"[\s\p{Z}]+"


def py_strip(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, rf"^{_SPACE}|{_SPACE}$", "")


def squash_ws(c: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(c, _SPACE, " "))


def title_case(c: Column) -> Column:
    """A capital after everything that is not a letter, small letters elsewhere."""
    return F.array_join(F.transform(F.regexp_extract_all(c, F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1)), F.initcap), "")


def strip_nonword(c: Column) -> Column:
    return F.regexp_replace(c, r"[^\p{L}\p{N}_]+", "")


def split_alias(c: Column) -> Column:
    """struct(name, aka): the text in the first parentheses, and the name without them and without that text; else "None"."""
    a, z = F.instr(c, "("), F.instr(c, ")")
    aka = F.substring(c, a + 1, z - a - 1)
    bare = F.replace(F.replace(F.replace(c, F.lit("(")), F.lit(")")), aka)
    ok = (a > 0) & (z > a)
    return F.struct(
        squash_ws(F.when(ok & (aka != ""), bare).when(ok, F.replace(F.replace(c, F.lit("(")), F.lit(")"))).otherwise(c)).alias("name"),
        F.when(ok, squash_ws(aka)).otherwise("None").alias("aka"),
    )


def decade(year: Column) -> Column:
    """The decade of a four-digit year, else 0."""
    y = year.cast("int")
    return F.when(F.length(y.cast("string")) == 4, y - F.pmod(y, F.lit(10))).otherwise(0)


def tokens(c: Column) -> Column:
    """White-space tokens."""
    return F.filter(F.split(c, r"\s+"), lambda w: w != "")


def py_split(c: Column) -> Column:
    """Words between white space of any kind: no-break and other wide spaces, and the separators 1C to 1F and 85, too."""
    return F.filter(F.split(c, r"[\s\x1C-\x1F\x85\p{Z}]+"), lambda w: w != "")


def pos_class(tag: Column) -> Column:
    """V..., Adj..., Adv... as their class, else what stands before an underscore; brackets go, only the first reading counts."""
    t = F.split_part(F.translate(tag, "/[]", ""), F.lit("|"), F.lit(1))
    return F.when(t.startswith("V"), "V").when(t.startswith("Adj"), "Adj").when(t.startswith("Adv"), "Adv").otherwise(F.split_part(t, F.lit("_"), F.lit(1)))


def clean_text(c: Column) -> Column:
    """Typographic quotes and dashes as ASCII, control characters and no-break spaces as spaces; case and accents stay."""
    plain = F.translate(c, "‘’‚“”„–— ", "'''\"\"\"-- ")
    return F.trim(F.regexp_replace(F.regexp_replace(plain, r"[\p{Cntrl}&&[^\n]]", " "), r"[ ]{2,}", " "))


def without_suffix(c: Column, n: int) -> Column:
    """Without its last n characters; empty if it has no more."""
    return F.substring(c, F.lit(1), F.greatest(F.length(c) - n, F.lit(0)))


def clamp_distance(c: Column, at: float = 100) -> Column:
    """The distance from ``at``, no more than that."""
    return F.least(F.abs(F.lit(at) - c), F.lit(at))
