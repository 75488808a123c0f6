"""Runs registered queries next to their SQL and compares the rows.

    python tests/compare.py [sf_dir] [name ...]
"""

import datetime as dt
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _cell(value):
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, float):
        return round(value, 6)
    return value


def _sorted(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    cells = [tuple(_cell(row[i]) for i in order) for row in rows]
    return sorted(cells, key=lambda r: tuple((v is not None, str(v)) for v in r))


def differences(spark_df, con, sql):
    """Empty when both give the same columns and rows, else a description."""
    names = spark_df.columns
    got = _sorted(names, [tuple(r) for r in spark_df.collect()])
    cursor = con.execute(sql)
    other = [c[0] for c in cursor.description]
    want = _sorted(other, cursor.fetchall())
    if sorted(names) != sorted(other):
        return f"columns {sorted(names)} != {sorted(other)}"
    if len(got) != len(want):
        extra = [r for r in got if r not in set(want)][:2], [r for r in want if r not in set(got)][:2]
        return f"{len(got)} rows != {len(want)}: {extra}"
    for a, b in zip(got, want):
        if a != b or [type(x) for x in a] != [type(x) for x in b]:
            return f"row {a} != {b}"
    return ""


def main():
    from pyspark.sql import SparkSession

    import __spark_entry__ as e

    args = sys.argv[1:]
    sf_dir = args.pop(0) if args and "/" in args[0] else "/root/testdata/sf0.01"
    spark = (SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
             .config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "12g").getOrCreate())
    spark.sparkContext.setLogLevel("OFF")
    con = connect(sf_dir)
    queries, oracles = e.queries(), e.oracle_sql()
    names = [n for n in queries if not args or any(n.startswith(a) for a in args)]
    bad = []
    for name in names:
        start = time.time()
        try:
            df = queries[name](spark, sf_dir)
            problem = differences(df, con, oracles[name]) if name in oracles else f"(no SQL, {df.count()} rows)"
        except Exception as error:
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        if problem and not problem.startswith("(no SQL"):
            bad.append(name)
        print(f"{name:28} {time.time() - start:6.1f}s {problem or 'ok'}"[:900], flush=True)
    print(f"{len(names) - len(bad)} of {len(names)} fine; bad: {bad}")


if __name__ == "__main__":
    main()
