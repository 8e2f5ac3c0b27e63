"""Sources, and sinks that are one call: TSV, GraphML, nested JSON, stop-words, SQLite, JDBC, pages, per-group text. ``writers`` has the others."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


def read_tsv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Header-less TSV by position."""
    return spark.read.csv(path, sep="\t", schema=schema, quote="")


def write_tsv(df: DataFrame, path: str, header: bool = False) -> None:
    df.write.csv(path, sep="\t", header=header, quote="")


def read_graphml(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """nodes (id, data) and edges (src, dst, weight); data are mapped from key ids to attribute names."""
    data = "data array<struct<_key:string,_VALUE:string>>"
    keys = spark.read.format("xml").option("rowTag", "key").schema("_id string, `_attr.name` string").load(path)
    # One name for each attribute of the graph, as many as its tables have columns.
    names = {r[0]: r[1] for r in keys.distinct().collect()}
    known = F.create_map(*[F.lit(x) for kv in (names or {"": ""}).items() for x in kv])
    attrs = F.map_from_entries(F.transform(F.coalesce("data", F.array().cast("array<struct<_key:string,_VALUE:string>>")), lambda d: F.struct(F.coalesce(known[d["_key"]], d["_key"]), d["_VALUE"])))
    nodes = spark.read.format("xml").option("rowTag", "node").schema(f"_id string, {data}").load(path)
    edges = spark.read.format("xml").option("rowTag", "edge").schema(f"_source string, _target string, {data}").load(path)
    weight = F.try_element_at(attrs, F.lit("weight")).try_cast("double")
    return nodes.select(F.col("_id").alias("id"), attrs.alias("data")), edges.select(
        F.col("_source").alias("src"), F.col("_target").alias("dst"), weight.alias("weight")
    )


LAYOUT = (
    "nodes struct<positions:array<array<double>>,labels:array<string>,ords:array<long>>, "
    "links map<string,struct<end_points:array<int>,points:array<array<double>>,radius:double,weight:int>>, scale double"
)


def read_layout(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """node rows (ord, label, x, y, z) and link rows (label, a, b, radius, weight, points) of a layout document, or of a folder of them.

    ord is the place in the document, or what its ``ords`` say.
    """
    doc = spark.read.json(path, schema=LAYOUT, multiLine=True)
    n = doc.select(F.posexplode(F.arrays_zip("nodes.positions", "nodes.labels", F.coalesce("nodes.ords", F.array().cast("array<long>")).alias("ords"))).alias("at", "n"))
    xyz = [F.col("n.positions")[k].alias(c) for k, c in enumerate("xyz")]
    nodes = n.select(F.coalesce("n.ords", F.col("at").cast("long")).alias("ord"), F.col("n.labels").alias("label"), *xyz)
    links = doc.select(F.explode("links").alias("label", "l"))
    return nodes, links.select("label", F.col("l.end_points")[0].alias("a"), F.col("l.end_points")[1].alias("b"), "l.radius", "l.weight", "l.points")


def write_groups(df: DataFrame, group: str, text: str, path: str) -> None:
    df.select(F.col(group), F.col(text).alias("value")).write.partitionBy(group).text(path)


def read_groups(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("wholetext", True).text(path)


# The languages that Spark has lists for.
STOP_LANGUAGES = "danish dutch english finnish french german hungarian italian norwegian portuguese russian spanish swedish turkish".split()


def stop_words(spark: SparkSession, path: str | None = None, languages: tuple[str, ...] | None = None, lower: bool = True, more: tuple[str, ...] = ()) -> DataFrame:
    """(word): distinct stop-words of a file (one a line), of the built-in lists of some languages (of all by default) and ``more``.

    lower=False leaves the words of the file as they stand; white space around them goes either way.
    """
    from pyspark.ml.feature import StopWordsRemover

    languages = STOP_LANGUAGES if languages is None else languages
    built = sorted({w for lang in languages for w in StopWordsRemover.loadDefaultStopWords(lang)})
    out = spark.createDataFrame([(w,) for w in [*built, *more]], "word string")
    if path:
        w = F.trim(F.col("value"))
        out = out.unionByName(spark.read.text(path).select((F.lower(w) if lower else w).alias("word")))
    return out.where("word <> ''").distinct()


class SqliteSource(DataSource):
    """spark.dataSource.register(SqliteSource); read.format("sqlite").schema(...).load(path, table=..., partitions=..., key=...)."""

    @classmethod
    def name(cls) -> str:
        return "sqlite"

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _SqliteReader(self.options, schema)


class _Part(InputPartition):
    def __init__(self, k: int, n: int):
        self.k, self.n = k, n


class _SqliteReader(DataSourceReader):
    def __init__(self, options, schema):
        self.path, self.table = options["path"], options["table"]
        self.n, self.key = int(options.get("partitions", 1)), options.get("key", "rowid")
        self.columns = [f.name for f in schema]

    def partitions(self):
        return [_Part(k, self.n) for k in range(self.n)]

    def read(self, partition) -> Iterator[tuple]:
        import sqlite3

        cols = ", ".join('"' + c.replace('"', '""') + '"' for c in self.columns)
        with sqlite3.connect(f"file:{self.path}?mode=ro", uri=True) as con:
            yield from con.execute(f'SELECT {cols} FROM "{self.table}" WHERE coalesce(abs("{self.key}"), 0) % ? = ?', (partition.n, partition.k))


def read_jdbc(spark: SparkSession, url: str, table: str, key: str, low: int, high: int, partitions: int = 8, **options: str) -> DataFrame:
    """A table over JDBC in ranges of a numeric key; the driver's jar comes with the cluster."""
    return spark.read.format("jdbc").options(
        url=url, dbtable=table, partitionColumn=key, lowerBound=low, upperBound=high, numPartitions=partitions, **options
    ).load()


def fetch_pages(urls: DataFrame, fetchers: list[Callable[[str], str | None]], url: str = "url") -> DataFrame:
    """(url, html): the first fetcher that answers; null if none does, whatever goes wrong."""

    def get(batches):
        for pdf in batches:
            found = []
            for u in pdf[url]:
                html = None
                for fetch in fetchers:
                    try:
                        html = fetch(u)
                    except Exception:  # a page that fails is a null page
                        html = None
                    if html is not None:
                        break
                found.append(html)
            pdf["html"] = found
            yield pdf[[url, "html"]]

    return urls.select(url).mapInPandas(get, f"{url} string, html string")


def create_if_missing(spark: SparkSession, path: str, schema: str) -> bool:
    """An empty table at path with this schema, unless there is one already; whether it was made."""
    from pyspark.errors import AnalysisException

    try:
        spark.read.parquet(path).schema  # noqa: B018
    except AnalysisException:
        spark.createDataFrame([], schema).write.mode("ignore").parquet(path)
        return True
    return False


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line) of every regular file under a folder."""
    return spark.read.text(path).select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("file"), F.col("value").alias("line"))


def parse_reply(reply, schema: str = "array<struct<lemma:string,tag:string>>"):
    """A service's JSON reply as values of a schema; null where it does not fit. Nothing is evaluated."""
    return F.from_json(reply, schema, {"mode": "PERMISSIVE"})
