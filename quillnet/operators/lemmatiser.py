"""A lemmatiser learned from (form, lemma, tag) rows: rules by suffix, the longest known suffix of a form decides.

A rule says how many letters go from the end, what comes in their place, and the tag. Each suffix of each form votes for what its
own form needs; the rules of all suffixes together are a trie read from the end, held as a table keyed by suffix.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillnet.functions.text import pos_class, tokens
from quillnet.operators.corpus import without_stop
from quillnet.operators.relational import join_checked


def learn(rows: DataFrame, longest: int = 6) -> DataFrame:
    """(suffix, cut, add, tag) from rows (form, lemma, tag): for each suffix of at most ``longest`` letters, the empty one included, its best rule.

    Of rules with as many votes the one that cuts less wins, then the lesser ending and tag. A suffix votes only for rules that cut no more than itself.
    """
    f, m = F.col("form"), F.col("lemma")
    clean = rows.where("form IS NOT NULL AND form <> '' AND lemma IS NOT NULL AND tag IS NOT NULL")
    same = F.size(F.filter(F.sequence(F.lit(0), F.least(F.length(f), F.length(m))), lambda i: F.substring(f, F.lit(1), i) == F.substring(m, F.lit(1), i))) - 1
    rule = clean.select("form", "tag", same.alias("same"), "lemma").select("form", "tag", (F.length(f) - F.col("same")).alias("cut"), F.substring(m, F.col("same") + 1, F.length(m)).alias("add"))
    lengths = F.sequence(F.lit(0), F.least(F.length(f), F.lit(longest)))
    votes = rule.select("cut", "add", "tag", F.explode(F.transform(lengths, lambda k: F.struct(k.alias("k"), F.substring(f, F.length(f) - k + 1, k).alias("suffix")))).alias("s")).where("s.k >= cut")
    counted = votes.groupBy(F.col("s.suffix").alias("suffix"), "cut", "add", "tag").agg(F.count(F.lit(1)).alias("n"))
    best = counted.groupBy("suffix").agg(F.min_by(F.struct("cut", "add", "tag"), F.struct(-F.col("n"), "cut", "add", "tag")).alias("r"))
    return best.select("suffix", "r.cut", "r.add", "r.tag")


def lemmatise(forms: DataFrame, rules: DataFrame, form: str = "form", longest: int = 6) -> DataFrame:
    """(form, lemma, tag) of each distinct form; null lemma and tag where no suffix is known (the empty one always is, if anything was learned)."""
    distinct = forms.select(F.col(form).alias("form")).where("form IS NOT NULL").distinct()
    f = F.col("form")
    ends = F.transform(F.sequence(F.lit(0), F.least(F.length(f), F.lit(longest))), lambda k: F.substring(f, F.length(f) - k + 1, k))
    met = join_checked(distinct.select("form", F.explode(ends).alias("suffix")), rules, "suffix", "left")
    longest_known = F.max_by(F.when(F.col("cut").isNotNull(), F.struct("cut", "add", "tag")), F.when(F.col("cut").isNotNull(), F.length("suffix")))
    found = met.groupBy("form").agg(longest_known.alias("r"))
    return found.select("form", F.concat(F.substring(f, F.lit(1), F.length(f) - F.col("r.cut")), F.col("r.add")).alias("lemma"), F.col("r.tag").alias("tag"))


def lemma_lines(docs: DataFrame, doc_id: str, text: str, rules: DataFrame, keep: tuple[str, ...] = ("Adj", "V", "Adv", "N"), min_len: int = 3, stop: list[str] | DataFrame | None = None, longest: int = 6) -> DataFrame:
    """(doc, line, lemma) of the words of kept classes, in lower case. Each distinct word is lemmatised once."""
    lines = docs.select(F.col(doc_id).alias("doc"), F.posexplode(F.split(F.lower(text), "\n")).alias("line", "text"))
    words = lines.select("doc", "line", F.explode(tokens(F.col("text"))).alias("form"))
    known = lemmatise(words, rules, longest=longest).where(pos_class(F.col("tag")).isin(*keep) & (F.length("lemma") >= min_len)).select("form", "lemma")
    return join_checked(words, without_stop(known, "lemma", stop), "form", "inner").select("doc", "line", "lemma")
