"""Compare registered queries with their DuckDB oracles: python tests/oracle_check.py [sf_dir] [names...]."""

import math
import os
import sys
import time
from datetime import datetime

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def duck(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, float) and (math.isnan(value)):
        return None
    if isinstance(value, float) and value == 0:
        return 0.0
    if isinstance(value, datetime):
        return value.replace(tzinfo=None)
    return value


def table(columns, rows):
    """Columns by name; rows sorted by everything but floats first, floats last."""
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain_rows = [[plain(r[i]) for i in order] for r in rows]

    def key(row):
        exact = [repr(v) for v in row if not isinstance(v, float)]
        return exact, [v for v in row if isinstance(v, float)]

    return [columns[i] for i in order], sorted(plain_rows, key=key)


def same(a, b):
    """Equal; floats up to one unit of the sixth decimal, where a mean can sit on a tie."""
    if isinstance(a, float) and isinstance(b, float):
        return a == b or math.isclose(a, b, rel_tol=1e-12, abs_tol=1.5e-6)
    return type(a) is type(b) and a == b


def compare(spark_df, con, sql):
    """None if equal, else what differs."""
    rows = spark_df.collect()
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    expected = found.fetchall()
    left, right = table(spark_df.columns, rows), table(names, expected)
    if left[0] != right[0]:
        return f"columns {left[0]} != {right[0]}"
    if len(left[1]) != len(right[1]):
        return f"rows {len(left[1])} != {len(right[1])}"
    pairs = [(a, b) for a, b in zip(left[1], right[1]) if not all(map(same, a, b))]
    if pairs:
        return f"{len(pairs)} of {len(left[1])} rows differ, first {pairs[0]}"
    return None if rows else "no rows"


if __name__ == "__main__":
    from __spark_entry__ import oracle_sql, queries
    from tidemark.session import local_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:] or list(queries())
    spark, con = local_session(8), duck(sf)
    bad = 0
    for name in wanted:
        start = time.time()
        try:
            df = queries()[name](spark, sf)
            problem = compare(df, con, oracle_sql()[name]) if name in oracle_sql() else f"(no oracle) rows={df.count()}"
        except Exception as error:  # noqa: BLE001
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        bad += bool(problem) and not str(problem).startswith("(no oracle)")
        print(f"{'ok ' if not problem else '-- '} {name:28s} {time.time() - start:6.2f}s {problem or ''}", flush=True)
    print("bad:", bad)
