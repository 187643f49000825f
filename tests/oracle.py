"""Compares a query's rows with those of its SQL, as sorted multisets."""

from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if value is None:
        return None
    if isinstance(value, float):
        return round(value, 5) + 0.0
    return str(value)


def compare(spark, query, sql, sf_dir):
    """None if equal, else a text that shows how they differ."""
    df = query(spark, sf_dir)
    names = sorted(df.columns)
    got = Counter(tuple(plain(r[c]) for c in names) for r in df.collect())
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    out = con.execute(sql)
    cols = [c[0] for c in out.description]
    if sorted(cols) != names:
        return f"columns {sorted(cols)} and {names}"
    order = [cols.index(c) for c in names]
    want = Counter(tuple(plain(r[i]) for i in order) for r in out.fetchall())
    if got == want:
        return None
    return f"{sum(got.values())} and {sum(want.values())} rows; only here {list((got - want))[:3]}; only in SQL {list((want - got))[:3]}"
