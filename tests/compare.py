"""Run a query and its SQL and compare rows as sets with counts."""

from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(value):
    return float(f"{value:.9g}") + 0.0 if isinstance(value, float) else value


def check(frame, con, text):
    columns = sorted(frame.columns)
    got = Counter(tuple(map(plain, r)) for r in frame.select(*columns).collect())
    relation = con.execute(text)
    names = [c[0] for c in relation.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    want = Counter(tuple(plain(r[k]) for k in at) for r in relation.fetchall())
    assert got == want, (list((got - want).items())[:3], list((want - got).items())[:3])
