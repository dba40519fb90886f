"""Comparison of a query's rows with its SQL run by DuckDB."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def run_sql(sql, sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    return [dict(zip(names, r)) for r in rel.fetchall()]


def norm(rows):
    def one(v):
        if isinstance(v, float):
            return "null" if math.isnan(v) else repr(round(v, 6))
        return "null" if v is None else str(v)

    return sorted(tuple((k, one(r[k])) for k in sorted(r)) for r in rows)


def same(spark_df, sql, sf_dir):
    got = norm([r.asDict() for r in spark_df.collect()])
    want = norm(run_sql(sql, sf_dir))
    assert len(got) == len(want), (len(got), len(want))
    diff = [(a, b) for a, b in zip(got, want) if a != b]
    assert not diff, diff[:3]
