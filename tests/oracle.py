"""Compares a Spark result with a DuckDB one, whatever the order of rows and columns."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf: str, sql: str):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    r = c.execute(sql)
    names = [x[0] for x in r.description]
    return names, r.fetchall()


def shown(x) -> str:
    return "%.9g" % x if isinstance(x, float) else str(x)


def same(df, sf: str, sql: str) -> None:
    names, rows = duck(sf, sql)
    assert sorted(names) == sorted(df.columns)
    order = sorted(range(len(names)), key=lambda i: names[i])
    expected = sorted(tuple(shown(r[i]) for i in order) for r in rows)
    got = sorted(tuple(shown(x) for x in r) for r in df.select(*[f"`{x}`" for x in sorted(df.columns)]).collect())
    assert len(got) == len(expected)
    assert got == expected
