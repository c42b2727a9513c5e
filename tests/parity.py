"""Runs queries in both engines and compares all values."""

import duckdb

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def connection(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _plain(value):
    return round(value, 5) if isinstance(value, float) else value


def same(spark_df, con, sql):
    """None, or what differs."""
    names = sorted(spark_df.columns)
    got = sorted(([_plain(r[n]) for n in names] for r in spark_df.collect()), key=repr)
    result = con.execute(sql)
    columns = [d[0] for d in result.description]
    want = sorted(([_plain(r[columns.index(n)]) for n in names] for r in result.fetchall()), key=repr) if sorted(columns) == names else None
    if want is None:
        return f"columns {names} and {sorted(columns)}"
    if len(got) != len(want):
        return f"{len(got)} and {len(want)} rows"
    for a, b in zip(got, want, strict=True):
        if a != b:
            return f"{a} and {b}"
    return None
