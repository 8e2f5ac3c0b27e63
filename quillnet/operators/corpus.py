"""Text analytics by group: corpora, frequencies, skip-grams, keyness, word graphs, topics, language filter."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillnet.functions.text import clean_text, decade, pos_class, tokens
from quillnet.operators.graph import pagerank
from quillnet.functions.repair import repaired
from quillnet.operators.relational import join_checked, rank_all, top_k
from quillnet.session import cut


def corpus(docs: DataFrame, group: str, order: str, text: str, min_len: int = 40, placeholder: str | None = None, years: bool = False) -> DataFrame:
    """(group, ord, text): documents longer than min_len, less the placeholder. With years, groups are decades of 1 to 2020.

    A group stays rows; ``write_corpus`` writes it as ordered lines.
    """
    rows = docs.where((F.col(group) > 0) & (F.col(group) < 2021)) if years else docs
    key = decade(F.col(group)) if years else F.col(group)
    keep = (F.length(text) > min_len) & (F.col(text) != placeholder if placeholder else F.lit(True))
    return rows.where(keep).select(key.alias("group"), F.col(order).alias("ord"), F.col(text).alias("text"))


def write_corpus(rows: DataFrame, path: str) -> None:
    """Text files by group, in order; a large group takes several files, whose names follow the order."""
    rows.repartitionByRange("group", "ord").sortWithinPartitions("group", "ord").select("group", "text").write.partitionBy("group").text(path)


def group_sizes(rows: DataFrame, years: DataFrame, year: str) -> DataFrame:
    """(group, n, bar): how many rows each decade of a valid year has, 0 where none is left; bar: a mark for each twentieth of the most."""
    valid = years.where((F.col(year) > 0) & (F.col(year) < 2021)).select(decade(F.col(year)).alias("group")).distinct()
    n = rows.groupBy("group").agg(F.count(F.lit(1)).alias("n"))
    out = valid.join(n, "group", "left").select("group", F.coalesce("n", F.lit(0)).alias("n"))
    most = n.agg(F.coalesce(F.max("n"), F.lit(1)).alias("_most"))
    return out.join(F.broadcast(most)).select("group", "n", F.repeat(F.lit("█"), F.ceil(F.col("n") * 20 / F.col("_most")).cast("int")).alias("bar"))


def without_stop(rows: DataFrame, column: str, stop: list[str] | DataFrame | None) -> DataFrame:
    """rows whose column is no stop-word; stop: a list of a few words, or a table whose first column has them.

    A null is no stop-word. The table is sent to all tasks if it is small, else the rows are dealt by word.
    """
    if stop is None:
        return rows
    if isinstance(stop, DataFrame):
        return join_checked(rows, stop.select(F.col(stop.columns[0]).alias(column)).distinct(), column, "left_anti").select(*rows.columns)
    return rows.where(~F.coalesce(F.col(column).isin(stop), F.lit(False))) if stop else rows


def term_counts(docs: DataFrame, group: str, text: str, stop: list[str] | DataFrame | None = None, min_len: int = 1) -> DataFrame:
    """(group, term, n) over white-space tokens of lower-cased texts."""
    t = docs.select(F.col(group).alias("group"), F.explode(tokens(F.lower(text))).alias("term")).where(F.length("term") >= min_len)
    return without_stop(t.groupBy("group", "term").agg(F.count(F.lit(1)).alias("n")), "term", stop)


def term_freq(docs: DataFrame, group: str, text: str, min_count: int = 3, k: int = 200, stop: list[str] | DataFrame | None = None) -> DataFrame:
    c = term_counts(docs, group, text, stop).where(F.col("n") >= min_count)
    return top_k(c, k, [F.desc("n"), F.col("term")], ["group"])


#: Tokens whose pairs are counted together.
_TOKENS = 1_000_000


def skipgrams(docs: DataFrame, text: str, reach: int = 4, min_count: int = 3, group: str | None = None) -> DataFrame:
    """([group,] a, b, n): ordered token pairs at most ``reach`` apart in one document, held min_count times or more.

    Tasks count pairs as numbers, about a million tokens at a time, so that no pair becomes a row before it is counted.
    """
    keys = ["group"] if group else []
    rows = docs.select(F.col(group).alias("group") if group else F.lit(None).cast("string").alias("group"), tokens(F.lower(text)).alias("tok")).where("tok IS NOT NULL")

    def count(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            sizes = batch.column(1).value_lengths().to_numpy(zero_copy_only=False)
            begin = 0
            while begin < len(sizes):
                end = begin + max(1, int(np.searchsorted(np.cumsum(sizes[begin:]), _TOKENS, side="right")))
                words = batch.column(1).slice(begin, end - begin).flatten().dictionary_encode()
                of = batch.column(0).slice(begin, end - begin).dictionary_encode(null_encoding="encode")
                doc, w = np.repeat(np.arange(end - begin), sizes[begin:end]), words.indices.to_numpy().astype(np.int64)
                g, many, found = of.indices.to_numpy().astype(np.int64)[doc], len(words.dictionary), []
                for k in range(1, reach + 1):
                    one = np.flatnonzero(doc[:-k] == doc[k:])
                    found.append((g[one] * many + w[one]) * many + w[one + k])
                key, n = np.unique(np.concatenate(found), return_counts=True)
                a, b = words.dictionary.take(pa.array(key // max(1, many) % max(1, many))), words.dictionary.take(pa.array(key % max(1, many)))
                yield pa.RecordBatch.from_arrays([of.dictionary.take(pa.array(key // max(1, many * many))), a, b, pa.array(n)], ["group", "a", "b", "n"])
                begin = end

    kind = dict(rows.dtypes)["group"]
    found = rows.mapInArrow(count, f"`group` {kind}, a string, b string, n long")
    return found.groupBy(*keys, "a", "b").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def keyness(counts: DataFrame) -> DataFrame:
    """log2 of a term's share in its group over its share in all groups."""
    total = counts.groupBy("term").agg(F.sum("n").alias("_f"))
    size = counts.groupBy("group").agg(F.sum("n").alias("_g"))
    every = counts.agg(F.sum("n").alias("_a"))
    score = F.log2((F.col("n") / F.col("_g")) / (F.col("_f") / F.col("_a")))
    return counts.join(total, "term").join(size, "group").join(F.broadcast(every)).select("group", "term", "n", score.alias("score"))


def keywords(docs: DataFrame, group: str, text: str, stop: list[str] | DataFrame, k: int | None = None) -> DataFrame:
    """(group, term, n, score): keyness without stop-words, hyphens written as #, largest first.

    In all texts together a hyphen is replaced before the stop-words go, in a group after: a stop-word with a hyphen in it
    counts in the whole, not in its group.
    """
    counts = cut(term_counts(docs, group, text))
    mark = F.replace(F.col("term"), F.lit("-"), F.lit("#"))
    whole = without_stop(counts.withColumn("term", mark), "term", stop).groupBy("term").agg(F.sum("n").alias("_f"))
    own = without_stop(counts, "term", stop).withColumn("term", mark).groupBy("group", "term").agg(F.sum("n").alias("n"))
    size = own.groupBy("group").agg(F.sum("n").alias("_g"))
    every = whole.agg(F.sum("_f").alias("_a"))
    score = F.log2((F.col("n") / F.col("_g")) / (F.col("_f") / F.col("_a")))
    out = own.join(whole, "term").join(size, "group").join(F.broadcast(every)).select("group", "term", "n", score.alias("score"))
    return top_k(out, k, [F.desc(F.round("score", 9)), F.col("term")], ["group"]) if k else out.orderBy("group", F.desc("score"), "term")


def word_graph(pairs: DataFrame) -> DataFrame:
    """Skip-gram counts as an undirected graph without loops; both orders of a pair are added. A group is part of the terms' ids."""
    term = (lambda c: F.struct("group", F.col(c).alias("term"))) if "group" in pairs.columns else F.col
    return pairs.where("a <> b").groupBy(F.least(term("a"), term("b")).alias("src"), F.greatest(term("a"), term("b")).alias("dst")).agg(F.sum("n").alias("weight"))


def word_pagerank(pairs: DataFrame, **how) -> DataFrame:
    e = word_graph(pairs)
    nodes = e.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    return pagerank(nodes, e, **how)


def word_ranks(docs: DataFrame, group: str, text: str, stop: list[str] | DataFrame, k: int = 200, **how) -> DataFrame:
    """(group, term, rank): the k terms of each group with the largest PageRank in its word graph, stop-words left out at the end.

    The groups' graphs have no edge in common, so one run over all of them gives each group's ranks, up to its share of the nodes.
    """
    ranks = cut(word_pagerank(cut(skipgrams(docs.where(F.col(group).isNotNull()), text, group=group)), **how).select("id.group", "id.term", "rank"))
    share = ranks.groupBy("group").agg(F.sum("rank").alias("_all"))
    own = ranks.join(F.broadcast(share), "group").select("group", "term", (F.col("rank") / F.col("_all")).alias("rank"))
    return top_k(without_stop(own, "term", stop), k, [F.desc(F.round("rank", 9)), F.col("term")], ["group"])


def vocabulary_bags(docs: DataFrame, doc_id: str, text: str, min_df: int = 2) -> tuple[DataFrame, DataFrame]:
    """(term, df, tf) of terms in min_df documents or more, and (doc, term, n) bags over them."""
    bag = term_counts(docs, doc_id, text).withColumnRenamed("group", "doc")
    vocab = bag.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("n").alias("tf")).where(F.col("df") >= min_df)
    return vocab, bag.join(vocab.select("term"), "term", "left_semi")


def term_dictionary(docs: DataFrame, text: str, min_df: int = 2) -> DataFrame:
    """(term, at, df): every term of min_df documents or more with its number from 0, in order; a table, however many there are."""
    words = docs.select(F.explode(F.array_distinct(tokens(F.lower(text)))).alias("term"))
    vocab = words.groupBy("term").agg(F.count(F.lit(1)).alias("df")).where(F.col("df") >= min_df)
    return rank_all(vocab, ["term"], "_r").select("term", (F.col("_r") - 1).cast("long").alias("at"), "df")


def term_vectors(docs: DataFrame, doc_id: str, text: str, dictionary: DataFrame) -> DataFrame:
    """(doc, features): sparse counts over the dictionary, made by join and aggregation; texts without a known term have none."""
    from pyspark.ml.linalg import Vectors, VectorUDT

    size = dictionary.count()
    counts = term_counts(docs, doc_id, text).withColumnRenamed("group", "doc").join(dictionary.select("term", "at"), "term")
    bags = counts.groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("at", "n"))).alias("bag"))
    vector = F.udf(lambda at, n: Vectors.sparse(size, at, n), VectorUDT())
    return bags.select("doc", vector("bag.at", "bag.n").alias("features"))


def lda_topics(docs: DataFrame, doc_id: str, text: str, k: int = 5, passes: int = 10, seed: int = 100, path: str | None = None) -> DataFrame:
    """(topic, rank, term, weight): ten leading terms of each topic of an online LDA; saved if a path is given.

    Every pass takes all documents, and every term of two documents or more takes part. doc_id tells documents apart; the model
    itself, k numbers for each term, is MLlib's and on the driver.
    """
    from pyspark.ml.clustering import LDA

    dictionary = cut(term_dictionary(docs, text))
    alpha = [1.0 / (i + k**0.5) for i in range(k)]
    lda = LDA(k=k, maxIter=passes, optimizer="online", subsamplingRate=1.0, learningDecay=0.5, learningOffset=64.0, docConcentration=alpha, optimizeDocConcentration=False, seed=seed)
    model = lda.fit(cut(term_vectors(docs, doc_id, text, dictionary).select("features")))
    if path:
        model.write().overwrite().save(path)
    top = model.describeTopics(10).select("topic", F.posexplode(F.arrays_zip("termIndices", "termWeights")).alias("rank", "t"))
    return dictionary.join(F.broadcast(top), F.col("t.termIndices") == F.col("at")).select("topic", "rank", "term", F.col("t.termWeights").alias("weight"))


#: More languages than this are an error of the table.
MOST_LANGUAGES = 500


#: Numbers in a model of letters that goes to all tasks; those of a larger one stay in a table.
MODEL_CELLS = 8_000_000

#: Letters that are looked at together.
_LETTERS = 1_000_000


def _gram_codes(texts: list[str]):
    """All runs of three letters or signs of the texts as numbers, 21 bits a sign, and how many each text has."""
    import numpy as np

    signs = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.int64)
    size = np.array([len(t) for t in texts], np.int64)
    if len(signs) < 3:
        return np.zeros(0, np.int64), np.zeros(len(size), np.int64)
    codes = signs[:-2] << 42 | signs[1:-1] << 21 | signs[2:]
    inside = np.ones(len(signs), bool)
    ends_ = np.cumsum(size)[size > 0]
    inside[ends_ - 1] = False
    two = ends_[size[size > 0] > 1]
    inside[two - 2] = False
    return codes[inside[:-2]], np.maximum(size - 2, 0)


def _some(texts: list[str]):
    """(first, last) places of texts of about _LETTERS signs together."""
    begin = n = 0
    for k, t in enumerate(texts):
        n += len(t)
        if n >= _LETTERS:
            yield begin, k + 1
            begin, n = k + 1, 0
    if begin < len(texts):
        yield begin, len(texts)


def _count_grams(batches):
    """(lang, gram, n) of (lang, text)."""
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for lang in sorted(set(langs)):
            own = [t for x, t in zip(langs, texts, strict=True) if x == lang]
            for begin, end in _some(own):
                gram, n = np.unique(_gram_codes(own[begin:end])[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(gram), pa.string()), pa.array(gram), pa.array(n)], ["lang", "gram", "n"])


def letter_model(docs: DataFrame, text: str, lang: str) -> tuple[DataFrame, list[str], DataFrame]:
    """(gram, p0, p1, ...), the languages, and one row of what an unknown gram has: log shares of letter trigrams, one added to each count.

    All texts with a language count, whole. A gram is the number that ``_gram_codes`` makes of it.
    """
    known = docs.where(F.col(lang).isNotNull() & (F.length(text) > 2)).select(F.col(lang).cast("string").alias("lang"), F.lower(text).alias("text"))
    counts = cut(known.mapInArrow(_count_grams, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    names = [r[0] for r in counts.select("lang").distinct().limit(MOST_LANGUAGES + 1).collect()]
    if len(names) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    names.sort()
    of = [F.coalesce(F.sum(F.when(F.col("lang") == x, F.col("n"))), F.lit(0)) for x in names]
    wide = counts.groupBy("gram").agg(*[c.alias(f"n{i}") for i, c in enumerate(of)])
    total = wide.agg(F.count(F.lit(1)).alias("v"), *[F.sum(f"n{i}").alias(f"t{i}") for i in range(len(names))])
    share = [F.log((F.col(f"n{i}") + 1) / (F.col(f"t{i}") + F.col("v"))).alias(f"p{i}") for i in range(len(names))]
    unknown = total.select(*[F.log(1 / (F.col(f"t{i}") + F.col("v"))).alias(f"u{i}") for i in range(len(names))])
    return cut(wide.join(F.broadcast(total)).select("gram", *share)), names, unknown


def _scored_lines(lines: DataFrame, model: DataFrame, unknown: DataFrame, names: list[str], keep: str) -> DataFrame:
    """lines with p, by a model that goes to all tasks: no gram becomes a row."""
    import numpy as np
    import pyarrow as pa

    own = names.index(keep)
    table = model.orderBy("gram").toArrow()
    shares = np.column_stack([table[f"p{i}"].to_numpy() for i in range(len(names))])
    sent = lines.sparkSession.sparkContext.broadcast((table["gram"].to_numpy(), np.vstack([shares, np.array([list(unknown.first())], float)])))

    def score(batches):
        grams, shares = sent.value
        for batch in batches:
            low = batch.column(batch.num_columns - 1).to_pylist()
            p = np.zeros(len(low))
            for begin, end in _some(low):
                codes, size = _gram_codes(low[begin:end])
                at = np.minimum(np.searchsorted(grams, codes), len(grams) - 1)
                at[grams[at] != codes] = len(grams)
                full = np.flatnonzero(size)
                if len(full):
                    s = np.add.reduceat(shares[at], (np.cumsum(size) - size)[full], axis=0)
                    p[begin + full] = 1 / np.exp(np.minimum(s - s[:, own : own + 1], 700.0)).sum(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(p)], [*batch.schema.names[:-1], "p"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in lines.schema.fields)
    return lines.withColumn("_low", F.lower("text")).mapInArrow(score, f"{schema}, p double")


def _gram_rows(text: str):
    """The numbers of all grams of a lower-cased text."""
    low = F.split(F.lower(text), "")
    sign = lambda c: F.ascii(c).cast("long")
    code = lambda i: F.shiftleft(sign(F.get(low, i)), 42) + F.shiftleft(sign(F.get(low, i + 1)), 21) + sign(F.get(low, i + 2))
    return F.transform(F.sequence(F.lit(0), F.size(low) - 3), code)


def language_lines(docs: DataFrame, doc_id: str, text: str, lang: str, keep: str, most: int = MODEL_CELLS) -> DataFrame:
    """(doc, line, text, p): the lines of more than two characters with the probability that they are in language ``keep``.

    A model of at most ``most`` numbers goes to all tasks, which read each line once; grams meet a larger one in joins.
    """
    model, names, unknown = letter_model(docs, text, lang)
    lines = docs.select(F.col(doc_id).alias("doc"), F.posexplode(F.split(text, "\n")).alias("line", "text")).where(F.length("text") > 2)
    if keep not in names:
        return lines.withColumn("p", F.lit(0.0))
    if model.count() * len(names) <= most:
        return _scored_lines(lines, model, unknown, names, keep)
    grams = lines.select("doc", "line", F.explode(_gram_rows("text")).alias("gram"))
    met = join_checked(grams, model, "gram", "left").join(F.broadcast(unknown))
    score = [F.sum(F.coalesce(f"p{i}", f"u{i}")).alias(f"s{i}") for i in range(len(names))]
    own = names.index(keep)
    p = 1 / sum((F.exp(F.least(F.col(f"s{i}") - F.col(f"s{own}"), F.lit(700.0))) for i in range(len(names))), F.lit(0.0))
    scored = met.groupBy("doc", "line").agg(*score).select("doc", "line", p.alias("p"))
    return lines.join(scored, ["doc", "line"]).select("doc", "line", "text", "p")


def language_filter(docs: DataFrame, doc_id: str, text: str, lang: str, keep: str, threshold: float = 0.8) -> DataFrame:
    """(doc, line, text) of the lines that are in language ``keep`` with probability over the threshold. doc_id tells documents apart."""
    return language_lines(docs, doc_id, text, lang, keep).where(F.col("p") > threshold).select("doc", "line", "text")


def language_corpus(docs: DataFrame, years: DataFrame, doc_id: str, year: str, text: str, lang: str, keep: str, threshold: float = 0.8, min_len: int = 40, placeholder: str | None = None) -> DataFrame:
    """(group, ord, text): a corpus by decade of the lines in one language.

    Lines are filtered, put together again in order, repaired and cleaned; then ``corpus`` takes decade, length and placeholder.
    """
    lines = language_filter(docs, doc_id, text, lang, keep, threshold)
    whole = lines.groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("line", "text"))).alias("l"))
    joined = whole.select(F.col("doc").alias(doc_id), F.array_join("l.text", "\n").alias("text"))
    dated = years.select(F.col(doc_id), F.col(year).alias("year")).join(joined, doc_id)
    return corpus(dated.withColumn("text", clean_text(repaired(F.col("text")))), "year", doc_id, "text", min_len, placeholder, years=True)


def lemmas(docs: DataFrame, doc_id: str, text: str, tagger, keep: tuple[str, ...] = ("Adj", "V", "Adv", "N"), min_len: int = 3, stop: list[str] | DataFrame | None = None) -> DataFrame:
    """(doc, line, lemma) of the kept classes. tagger: column of text -> array<struct<lemma, tag>>, such as a service's parsed reply."""
    t = docs.select(F.col(doc_id).alias("doc"), F.posexplode(F.split(text, "\n")).alias("line", "text"))
    t = t.select("doc", "line", F.explode(tagger(F.col("text"))).alias("t")).where(pos_class(F.col("t.tag")).isin(*keep))
    t = t.select("doc", "line", "t.lemma").where(F.length("lemma") >= min_len)
    return without_stop(t, "lemma", stop)


def cleaned(docs: DataFrame, text: str) -> DataFrame:
    return docs.withColumn(text, clean_text(F.col(text)))
