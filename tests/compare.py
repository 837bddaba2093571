"""Compare registered queries with their SQL in DuckDB. Also a script: python tests/compare.py DIR [name ...]"""

from __future__ import annotations

import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _plain(value):
    if value is None or value != value:
        return None
    if isinstance(value, float):
        return value + 0.0
    return value.item() if hasattr(value, "item") else value


def _sorted_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted([tuple(_plain(row[i]) for i in order) for row in rows], key=repr)


def differences(spark, con, sf_dir: str, fn, sql: str) -> list[str]:
    """Empty when both give the same columns, row count and values."""
    df = fn(spark, sf_dir)
    result = con.execute(sql)
    sql_columns = [d[0] for d in result.description]
    if sorted(df.columns) != sorted(sql_columns):
        return [f"columns {sorted(df.columns)} != {sorted(sql_columns)}"]
    got = _sorted_rows(df.columns, [tuple(row) for row in df.collect()])
    want = _sorted_rows(sql_columns, result.fetchall())
    if len(got) != len(want):
        return [f"rows {len(got)} != {len(want)}"] + [f"only here {x}" for x in list(set(got) - set(want))[:3]] + [
            f"only sql {x}" for x in list(set(want) - set(got))[:3]
        ]
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    types = [(type(a), type(b)) for g, w in zip(got, want) for a, b in zip(g, w) if a is not None and b is not None and type(a) is not type(b)]
    out = [f"{g} != {w}" for g, w in bad[:3]] + ([f"types {types[:2]}"] if types else [])
    return [f"{len(bad)} of {len(got)} rows differ", *out] if out else []


if __name__ == "__main__":
    import __spark_entry__ as entry
    from tallyflow.session import build_session

    sf_dir, names = sys.argv[1], sys.argv[2:]
    spark = build_session(master="local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "12g",
        "spark.ui.showConsoleProgress": "false",
    })
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    oracles = entry.oracle_sql()
    failed = 0
    for name, fn in entry.queries().items():
        if names and name not in names:
            continue
        start = time.time()
        try:
            if name in oracles:
                problems = differences(spark, con, sf_dir, fn, oracles[name])
                n = con.execute(f"SELECT COUNT(*) FROM ({oracles[name]})").fetchall()[0][0]
            else:
                n, problems = fn(spark, sf_dir).count(), []
        except Exception as error:
            n, problems = -1, [str(error)[:1500]]
        failed += bool(problems)
        print(f"{'FAIL' if problems else 'ok  '} {name} rows={n} {time.time() - start:.1f}s {'' if name in oracles else '(no sql)'}")
        for p in problems:
            print("     ", p[:1500])
    print("failed:", failed)
    spark.stop()
