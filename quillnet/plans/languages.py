"""Registered queries of languages, learned lemmas, repaired text and stop-word tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillnet.functions import text as X
from quillnet.functions.repair import repaired
from quillnet.operators import corpus as C
from quillnet.operators import lemmatiser as M
from quillnet.plans.catalogue import _TERMS, _TOK, _r, query
from quillnet.session import cut, table

_MODEL = """WITH k AS (SELECT lang, unnest(list_transform(range(1, length(text) - 1), lambda i: lower(text)[i:i + 2])) AS gram FROM documents WHERE lang IS NOT NULL AND length(text) > 2),
c AS (SELECT lang, gram, count(*) AS n FROM k GROUP BY ALL), names AS (SELECT DISTINCT lang FROM c), v AS (SELECT count(DISTINCT gram) AS v FROM c), t AS (SELECT lang, sum(n) AS t FROM c GROUP BY lang),
model AS (SELECT gram, lang, ln((coalesce(n, 0) + 1) / (t + v)::DOUBLE) AS p FROM (SELECT DISTINCT gram FROM c) CROSS JOIN t CROSS JOIN v LEFT JOIN c USING (gram, lang)),
lines AS (SELECT doc_id AS doc, l - 1 AS line, x[l] AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS x, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS l FROM documents) WHERE length(x[l]) > 2),
g AS (SELECT doc, line, unnest(list_transform(range(1, length(text) - 1), lambda i: lower(text)[i:i + 2])) AS gram FROM lines),
s AS (SELECT doc, line, t.lang, sum(coalesce(p, ln(1 / (t + v)::DOUBLE))) AS s FROM g CROSS JOIN t CROSS JOIN v LEFT JOIN model ON model.gram = g.gram AND model.lang = t.lang GROUP BY ALL),
p AS (SELECT doc, line, 1 / sum(exp(least(s - own, 700))) AS p FROM (SELECT *, max(s) FILTER (lang = 'de') OVER (PARTITION BY doc, line) AS own FROM s) GROUP BY ALL),
kept AS (SELECT lines.* FROM lines JOIN p USING (doc, line) WHERE p > 0.8::DOUBLE)"""


@query(_MODEL + " SELECT doc, line::INT AS line, text FROM kept")
def language_filter(spark, d):
    return C.language_filter(table(spark, d, "documents"), "doc_id", "text", "lang", "de")


_QUOTES = "'" + "''" * 3 + '"""-- ' + "'"


@query(_MODEL + rf""", w AS (SELECT doc, string_agg(text, chr(10) ORDER BY line) AS text FROM kept GROUP BY doc), y AS (SELECT o_orderkey AS doc, year(o_orderdate) AS y FROM orders),
z AS (SELECT doc, (y // 10 * 10)::INT AS "group", trim(regexp_replace(regexp_replace(translate(nfc_normalize(text), '‘’‚“”„–—' || chr(160), {_QUOTES}), '[\x00-\x09\x0b-\x1f\x7f-\x{{9f}}]', ' ', 'g'), '[ ]{{2,}}', ' ', 'g')) AS text FROM w JOIN y USING (doc) WHERE y BETWEEN 1 AND 2020)
SELECT "group", doc AS ord, sha256(text) AS digest FROM z WHERE length(text) > 40""")
def corpus_of_language(spark, d):
    """A corpus by decade of German lines, cleaned and put together again."""
    years = table(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), F.year("o_orderdate").alias("year"))
    rows = C.language_corpus(table(spark, d, "documents"), years, "doc_id", "year", "text", "lang", "de")
    return rows.select("group", "ord", F.sha2("text", 256).alias("digest"))


@query("SELECT doc_id, sha256(nfc_normalize(text)) AS digest FROM documents")
def text_repair(spark, d):
    """Texts of which a third was read as Latin-1, some of them twice, and a third was decomposed: all as they were."""
    wrong = lambda c: F.decode(F.encode(c, "UTF-8"), "ISO-8859-1")
    t, i = F.col("text"), F.col("doc_id")
    spoiled = F.when(i % 6 == 0, wrong(wrong(t))).when(i % 3 == 0, wrong(t)).when(i % 3 == 1, F.replace(F.replace(t, F.lit("é"), F.lit("é")), F.lit("ü"), F.lit("ü"))).otherwise(t)
    return table(spark, d, "documents").select("doc_id", F.sha2(repaired(spoiled), 256).alias("digest"))


_GOLD = """CASE WHEN form LIKE '%ing' THEN struct_pack(lemma := left(form, length(form) - 3), tag := 'V') WHEN form LIKE '%ies' THEN struct_pack(lemma := left(form, length(form) - 3) || 'y', tag := 'N')
WHEN form LIKE '%ed' THEN struct_pack(lemma := left(form, length(form) - 2) || 'e', tag := 'V') WHEN form LIKE '%ly' THEN struct_pack(lemma := left(form, length(form) - 2), tag := 'Adv')
WHEN form LIKE '%s' THEN struct_pack(lemma := left(form, length(form) - 1), tag := 'N') ELSE struct_pack(lemma := form, tag := 'Adj') END"""
_RULES = f"""WITH w AS (SELECT DISTINCT form FROM (SELECT unnest({_TOK}) AS form FROM documents) WHERE regexp_full_match(form, '[a-z]{{{{4,}}}}')), gold AS (SELECT form, {_GOLD} AS g FROM w), q AS (SELECT form, g.lemma AS lemma, g.tag AS tag FROM gold WHERE ascii(form[2]) % 3 <> 0),
r AS (SELECT form, tag, lemma, len(list_filter(range(0, least(length(form), length(lemma)) + 1), lambda i: left(form, i) = left(lemma, i))) - 1 AS same FROM q),
u AS (SELECT form, tag, length(form) - same AS cut, lemma[same + 1:] AS add, unnest(range(0, least(length(form), 6) + 1)) AS k FROM r),
votes AS (SELECT right(form, k) AS suffix, cut, add, tag, count(*) AS n FROM u WHERE k >= cut GROUP BY ALL),
rules AS (SELECT suffix, cut, add, tag FROM votes QUALIFY row_number() OVER (PARTITION BY suffix ORDER BY n DESC, cut, add, tag) = 1),
found AS (SELECT form, left(form, length(form) - cut) || add AS lemma, tag FROM (SELECT form, right(form, k) AS suffix FROM (SELECT form, unnest(range(0, least(length(form), 6) + 1)) AS k FROM {{forms}})) JOIN rules USING (suffix)
QUALIFY row_number() OVER (PARTITION BY form ORDER BY length(suffix) DESC) = 1)"""


def _gold(spark, d):
    """Words of the documents with lemmas and tags that follow a few planted rules; a part of them to learn from."""
    words = table(spark, d, "documents").select(F.explode(X.tokens(F.lower("text"))).alias("form")).where(F.col("form").rlike("^[a-z]{4,}$")).distinct()
    f, n = F.col("form"), F.length("form")
    rule = lambda cut, add, tag: F.struct(F.concat(F.substring(f, F.lit(1), n - cut), F.lit(add)).alias("lemma"), F.lit(tag).alias("tag"))
    g = F.when(f.endswith("ing"), rule(3, "", "V")).when(f.endswith("ies"), rule(3, "y", "N")).when(f.endswith("ed"), rule(2, "e", "V")).when(f.endswith("ly"), rule(2, "", "Adv")).when(f.endswith("s"), rule(1, "", "N")).otherwise(rule(0, "", "Adj"))
    words = cut(words.select("form", g.alias("g")).select("form", "g.lemma", "g.tag"))
    return words, words.where(F.ascii(F.substring("form", 2, 1)) % 3 != 0)


@query(_RULES.format(forms="w") + " SELECT form, lemma, tag FROM found")
def learned_lemmas(spark, d):
    """All words, those never learned from included."""
    words, taught = _gold(spark, d)
    return M.lemmatise(words, cut(M.learn(taught)))


@query(_RULES.format(forms="(SELECT DISTINCT form FROM t)").replace("WITH w AS", f"WITH t AS (SELECT doc, line, unnest(list_filter(regexp_split_to_array(x, '\\s+'), lambda w: w <> '')) AS form FROM (SELECT doc_id AS doc, l - 1 AS line, string_split(lower(text), chr(10))[l] AS x FROM (SELECT doc_id, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS l FROM documents))), w AS")
    + " SELECT doc, line::INT AS line, lemma, count(*) AS n FROM t JOIN found USING (form) WHERE tag IN ('V', 'N') AND length(lemma) > 2 AND lemma NOT IN ('this', 'the') GROUP BY ALL")
def lemma_lines(spark, d):
    rules = cut(M.learn(_gold(spark, d)[1]))
    found = M.lemma_lines(table(spark, d, "documents"), "doc_id", "text", rules, keep=("V", "N"), stop=["this", "the"])
    return found.groupBy("doc", "line", "lemma").agg(F.count(F.lit(1)).alias("n"))


_STOPS = _TERMS + ", stop AS (SELECT term FROM c GROUP BY term HAVING count(DISTINCT \"group\") >= 3)"


def _shared_terms(counts):
    """Terms of three languages or more: a table of stop-words that the corpus itself gives."""
    return counts.where("`group` IS NOT NULL").groupBy("term").agg(F.count_distinct("group").alias("k")).where("k >= 3").select("term")


@query(_STOPS + " SELECT \"group\", term, n FROM c WHERE n > 2 AND term NOT IN (FROM stop) QUALIFY row_number() OVER (PARTITION BY \"group\" ORDER BY n DESC, term) <= 200")
def term_freq_stop_table(spark, d):
    docs = table(spark, d, "documents")
    return C.term_freq(docs, "lang", "text", stop=cut(_shared_terms(C.term_counts(docs, "lang", "text"))))


@query(_STOPS + """, f AS (SELECT replace(term, '-', '#') AS term, sum(n) AS f FROM c WHERE replace(term, '-', '#') NOT IN (FROM stop) GROUP BY ALL), o AS (SELECT "group", replace(term, '-', '#') AS term, sum(n) AS n FROM c WHERE term NOT IN (FROM stop) GROUP BY ALL),
g AS (SELECT "group", sum(n) AS g FROM o GROUP BY ALL), s AS (SELECT "group", term, n::BIGINT AS n, round(log2((n / g::DOUBLE) / (f / (SELECT sum(f) FROM f)::DOUBLE)), 9) AS score FROM o JOIN f USING (term) JOIN g USING ("group"))
SELECT "group", term, n, score FROM s QUALIFY row_number() OVER (PARTITION BY "group" ORDER BY score DESC, term) <= 100""")
def keywords_stop_table(spark, d):
    docs = table(spark, d, "documents")
    stop = cut(_shared_terms(C.term_counts(docs, "lang", "text")))
    return C.keywords(docs, "lang", "text", stop, 100).select("group", "term", "n", _r("score"))


@query(r"SELECT doc_id, len(list_filter(regexp_split_to_array(text, '[\s\x0b\x1c-\x1f\x{85}\p{Z}]+'), lambda w: w <> ''))::BIGINT AS n FROM documents")
def unicode_tokens(spark, d):
    return table(spark, d, "documents").select("doc_id", F.size(X.py_split(F.col("text"))).cast("long").alias("n"))


@query(f"WITH t AS (SELECT DISTINCT doc_id, unnest({_TOK}) AS term FROM documents), v AS (SELECT term, count(*) AS df FROM t GROUP BY term HAVING count(*) >= 2) SELECT term, row_number() OVER (ORDER BY term) - 1 AS at, df FROM v")
def term_dictionary(spark, d):
    return C.term_dictionary(table(spark, d, "documents"), "text")
