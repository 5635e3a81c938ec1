"""Spark rows against DuckDB rows of the same query. Run as a script: python -m tests.compare DIR [NAME..]"""

from __future__ import annotations

import datetime
import math
import sys
import time
from collections import Counter

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def oracle(sf_dir: str):
    import duckdb

    c = duckdb.connect()
    c.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return round(v, 6) if math.isfinite(v) else str(v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if hasattr(v, "as_integer_ratio") and not isinstance(v, (int, bool)):
        return plain(float(v))
    return v


def rows_of(names: list[str], rows) -> Counter:
    order = sorted(range(len(names)), key=names.__getitem__)
    return Counter(tuple(plain(r[i]) for i in order) for r in rows)


def difference(spark, connection, f, sql: str, sf_dir: str) -> str | None:
    df = f(spark, sf_dir)
    got = rows_of(df.columns, df.collect())
    names = [x[0] for x in connection.sql(f"DESCRIBE {sql}").fetchall()]
    want = rows_of(names, connection.sql(sql).fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    if got != want:
        return f"{sum(got.values())} and {sum(want.values())} rows; only here {list((got - want).items())[:2]}; only there {list((want - got).items())[:2]}"
    return None


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "4").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "4g").getOrCreate()
    spark.sparkContext.setLogLevel("OFF")
    c, queries, sql = oracle(sys.argv[1]), entry.queries(), entry.oracle_sql()
    for name in sys.argv[2:] or [n for n in queries if n in sql]:
        began = time.time()
        try:
            said = difference(spark, c, queries[name], sql[name], sys.argv[1]) if name in sql else f"{queries[name](spark, sys.argv[1]).count()} rows"
        except Exception as e:  # noqa: BLE001  the next query still runs
            said = f"{type(e).__name__}: {str(e)[:500]}"
        print(f"{'ok ' if said is None else 'BAD' if name in sql else '-  '} {name} {time.time() - began:.1f}s {said or ''}", flush=True)
