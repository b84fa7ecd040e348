"""Compare a DataFrame with a DuckDB query on the same tables."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir):
    con = duckdb.connect()
    con.execute("SET threads = 2")
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        path = f"{sf_dir}/{name}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(value):
    if hasattr(value, "asDict"):
        value = value.asDict()
    if isinstance(value, dict):
        return tuple((k, plain(v)) for k, v in sorted(value.items(), key=lambda kv: str(kv[0])))
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if isinstance(value, float):
        return round(value, 7) + 0.0
    if isinstance(value, bool) or value is None or isinstance(value, str):
        return value
    if isinstance(value, int):
        return value
    try:
        return round(float(value), 7) + 0.0
    except (TypeError, ValueError):
        return str(value)


def rows_of(columns, records):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(plain(r[i]) for i in order) for r in records]
    return [columns[i] for i in order], sorted(out, key=repr)


def compare_query(df, sql, sf_dir, show=3):
    cur = duck(sf_dir).execute(sql)
    want_cols, want = rows_of([d[0] for d in cur.description], cur.fetchall())
    got_cols, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    assert got_cols == want_cols, (got_cols, want_cols)
    if got != want:
        a, b = set(map(repr, got)), set(map(repr, want))
        raise AssertionError(
            f"rows {len(got)} vs {len(want)}; only spark {sorted(a - b)[:show]}; only sql {sorted(b - a)[:show]}"
        )
    return len(got)
