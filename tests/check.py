"""Compare registered queries with their checking SQL: python tests/check.py [sf] [names...]"""

import datetime
import decimal
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def plain(value):
    if isinstance(value, float):
        return f"{value:.6g}"
    if isinstance(value, decimal.Decimal):
        return f"{float(value):.6g}"
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


def compare(spark, con, sf_dir, name, function, sql):
    """None when equal, else a short description."""
    df = function(spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return None if df.columns else "no columns"
    cursor = con.execute(sql)
    columns = [c[0] for c in cursor.description]
    if sorted(columns) != sorted(df.columns):
        return f"columns {df.columns} / {columns}"
    want = rows_of(columns, cursor.fetchall())
    if got == want:
        return None
    extra = [g for g in got if g not in set(want)][:2]
    missing = [w for w in want if w not in set(got)][:2]
    return f"{len(got)} / {len(want)} rows; only here {extra}; only there {missing}"


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


if __name__ == "__main__":
    import __spark_entry__ as entry
    from conftest import make_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.001"
    sf_dir = f"/root/testdata/sf{sf}"
    spark = make_session()
    con = connect(sf_dir)
    checks = entry.oracle_sql()
    bad = 0
    for name, function in entry.queries().items():
        if len(sys.argv) > 2 and not any(a in name for a in sys.argv[2:]):
            continue
        start = time.time()
        try:
            problem = compare(spark, con, sf_dir, name, function, checks.get(name))
        except Exception as error:  # report and go on with the others
            problem = f"{type(error).__name__}: {str(error)[:700]}"
        bad += problem is not None
        print(f"{'ok ' if problem is None else 'BAD'} {name} {time.time() - start:.1f}s {'' if name in checks else '(rows only)'} {problem or ''}", flush=True)
    print(f"{bad} bad")
