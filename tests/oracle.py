"""Comparison of a query with its DuckDB equivalent."""

from pathlib import Path

import duckdb


def normal(value):
    if isinstance(value, float):
        return round(value, 9)
    return tuple(map(normal, value)) if isinstance(value, (list, tuple)) else value


def differences(spark, query, sql, folder):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in Path(folder).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    df = query(spark, str(folder))
    columns = sorted(df.columns)
    got = sorted((tuple(map(normal, r)) for r in df.select(columns).collect()), key=repr)
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    rows = result.fetchall()
    want = sorted((tuple(normal(r[names.index(c)]) for c in columns) for r in rows), key=repr)
    assert len(got) == len(want)
    return [(a, b) for a, b in zip(got, want, strict=True) if a != b]
