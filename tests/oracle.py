"""Hold a query against its SQL in DuckDB."""

import os


def connect(sf_dir):
    import duckdb

    con = duckdb.connect()
    for name in sorted(os.listdir(sf_dir)):
        path = f"{sf_dir}/{name}"
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def rows(found, columns):
    return sorted(repr([(c, r[c]) for c in sorted(columns)]) for r in found)


def assert_same(spark, sf_dir, query, sql):
    got = query(spark, sf_dir)
    have = [r.asDict(recursive=True) for r in got.collect()]
    cursor = connect(sf_dir).execute(sql)
    columns = [c[0] for c in cursor.description]
    want = [dict(zip(columns, r, strict=True)) for r in cursor.fetchall()]
    assert sorted(columns) == sorted(got.columns)
    assert rows(have, columns) == rows(want, columns)
