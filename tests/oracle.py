"""Compares a query with its SQL over given tables."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return str(v) if hasattr(v, "isoformat") else v


def rows_of(df):
    return sorted(repr(tuple(_plain(r[c]) for c in sorted(df.columns))) for r in df.collect())


def sql_rows(sql, sf_dir, columns):
    con = duckdb.connect()
    from pathlib import Path

    for t in TABLES:
        if Path(f"{sf_dir}/{t}.parquet").exists():
            g = f"{sf_dir}/{t}.parquet" + ("/*.parquet" if Path(f"{sf_dir}/{t}.parquet").is_dir() else "")
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{g}'")
    r = con.sql(sql)
    at = [r.columns.index(c) for c in sorted(columns)]
    return sorted(repr(tuple(_plain(x[i]) for i in at)) for x in r.fetchall())
