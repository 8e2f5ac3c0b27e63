"""Rows that fail are kept apart with what is wrong with them; good and bad rows sum to all rows."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillnet.session import cut

CORRUPT = "_corrupt_record"


class Checked(NamedTuple):
    """good: rows as asked for; rejects: what was refused and why; counts: rows and rejects, filled by the pass that wrote them."""

    good: DataFrame
    rejects: DataFrame
    counts: dict


def read_checked(spark: SparkSession, path: str, schema: str, fmt: str = "json", reject_path: str | None = None, **options: str) -> Checked:
    """JSON lines or CSV read by a schema. rejects (file, record): records that do not fit, as they stand in the file.

    The files are read once. With reject_path the rejects are added to the table there.
    """
    wanted = T.StructType.fromDDL(schema)
    full = T.StructType([*wanted.fields, T.StructField(CORRUPT, T.StringType())])
    raw = spark.read.format(fmt).schema(full).options(**{"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT, **options}).load(path)
    seen = Observation()
    counted = raw.withColumn("_file", F.col("_metadata.file_name")).observe(seen, F.count(F.lit(1)).alias("rows"), F.count(CORRUPT).alias("rejects"))
    rows = cut(counted)
    bad = rows.where(F.col(CORRUPT).isNotNull()).select(F.col("_file").alias("file"), F.col(CORRUPT).alias("record"))
    if reject_path:
        bad.write.mode("append").parquet(reject_path)
    return Checked(rows.where(F.col(CORRUPT).isNull()).select(*wanted.names), bad, seen.get)


def cast_checked(df: DataFrame, casts: dict[str, str], rules: dict[str, Column] | None = None, reject_path: str | None = None) -> Checked:
    """df with columns cast. rejects: the rows, uncast, with ``errors``: the columns that do not cast and the rules that do not hold.

    A null casts to null and is no error; a rule that is null does not hold.
    """
    made = {c: F.col(c).try_cast(kind) for c, kind in casts.items()}
    wrong = [F.when(F.col(c).isNotNull() & made[c].isNull(), F.lit(f"{c}: not {kind}")) for c, kind in casts.items()]
    wrong += [F.when(~F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in (rules or {}).items()]
    seen = Observation()
    marked = df.withColumn("errors", F.array_compact(F.array(*wrong)))
    rows = cut(marked.observe(seen, F.count(F.lit(1)).alias("rows"), F.count(F.when(F.size("errors") > 0, 1)).alias("rejects")))
    bad = rows.where(F.size("errors") > 0)
    if reject_path:
        bad.write.mode("append").parquet(reject_path)
    return Checked(rows.where(F.size("errors") == 0).drop("errors").withColumns(made), bad, seen.get)
