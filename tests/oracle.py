"""Comparison of a query with its SQL on the same tables."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(df):
    names = sorted(df.columns)
    plain = lambda v: float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v
    return sorted((tuple(None if v != v else plain(v) for v in r) for r in df[names].astype(object).itertuples(index=False)), key=repr), names


def compare(spark, query, sql, sf_dir):
    db = duckdb.connect()
    for t in TABLES:
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    got, expected = query(spark, sf_dir).toPandas(), db.sql(sql).df()
    a, b = rows(got.where(got.notna(), None)), rows(expected.astype(object).where(expected.notna(), None))
    assert a[1] == b[1]
    assert len(a[0]) == len(b[0])
    assert a[0] == b[0]
