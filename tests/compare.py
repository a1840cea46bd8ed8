"""Compare a Spark result with DuckDB's for the same tables."""

import glob
import math
import os

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def views(connection, sf_dir):
    for name in TABLES.split():
        path = f"{sf_dir}/{name}.parquet"
        if os.path.isdir(path):
            path += "/*.parquet"
        if glob.glob(path):
            connection.sql(f"CREATE OR REPLACE VIEW {name} AS SELECT * FROM '{path}'")


def plain(value):
    if value is None:
        return "~"
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.6g}"
    if isinstance(value, bool):
        return str(value)
    if hasattr(value, "isoformat"):
        return value.isoformat()
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(plain(x) for x in value) + "]"
    return str(value)


def same_rows(df, sql, sf_dir, connection):
    views(connection, sf_dir)
    found = connection.sql(sql)
    columns = sorted(df.columns)
    assert columns == sorted(found.columns)
    want = sorted(tuple(plain(v) for v in row) for row in found.select(*[f'"{c}"' for c in columns]).fetchall())
    got = sorted(tuple(plain(v) for v in row) for row in df.select(*columns).collect())
    assert len(got) == len(want)
    wrong = [(g, w) for g, w in zip(got, want, strict=True) if g != w]
    assert not wrong, wrong[:3]
