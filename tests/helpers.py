"""Runs a registered query and its SQL side by side."""

from pathlib import Path

import duckdb

DATA = Path("/root/testdata")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        p = Path(sf_dir, f"{t}.parquet")
        if p.exists():
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if value != value else round(value, 5) + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    return value


def same(spark, con, queries, oracle, name, sf_dir):
    df = queries[name](spark, str(sf_dir))
    columns = sorted(df.columns)
    got = sorted(repr(tuple(map(plain, r))) for r in df.select(*[f"`{c}`" for c in columns]).collect())
    wanted = con.sql(f"SELECT {', '.join(f'"{c}"' for c in columns)} FROM ({oracle[name]}) q").fetchall()
    assert sorted(con.sql(oracle[name]).columns) == columns
    assert got == sorted(repr(tuple(map(plain, r))) for r in wanted)
