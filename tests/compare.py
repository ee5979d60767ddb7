"""A query's rows against its SQL in DuckDB."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def by_duckdb(sql, sf_dir, views=None):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    for name, path in (views or {}).items():
        con.execute(f"CREATE OR REPLACE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    rel = con.sql(sql)
    return rel.columns, rel.fetchall()


def norm(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, int):
        return float(f"{v:.17g}") if abs(v) < 2**53 else v
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return str(v) if not isinstance(v, (str, bytes)) else v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i].lower())
    return sorted((tuple(norm(r[i]) for i in order) for r in rows), key=str), [columns[i].lower() for i in order]


def check(df, sql, sf_dir, views=None):
    got, names = rows_of(df.columns, [tuple(r) for r in df.collect()])
    columns, rows = by_duckdb(sql, sf_dir, views)
    want, wanted = rows_of(columns, rows)
    assert names == wanted, (names, wanted)
    assert len(got) == len(want), (len(got), len(want))
    bad = [(a, b) for a, b in zip(got, want) if a != b]
    assert not bad, (len(bad), names, bad[:3])
    return len(got)
