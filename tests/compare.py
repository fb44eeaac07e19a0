"""Spark rows against DuckDB rows, order aside."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return repr(round(v, 9))
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    return None if v is None else str(v)


def duck(sql: str, sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    out = con.sql(sql)
    names = sorted(out.columns)
    return names, sorted(repr([plain(dict(zip(out.columns, r, strict=True))[c]) for c in names]) for r in out.fetchall())


def same(df, sql: str, sf_dir: str) -> None:
    names, rows = duck(sql, sf_dir)
    assert sorted(df.columns) == names
    assert sorted(repr([plain(r[c]) for c in names]) for r in df.collect()) == rows
