"""python tests/check.py [name-prefix ...] [--sf 0.001]: compare registered queries with their SQL."""

from __future__ import annotations

import sys
import time

sys.path.insert(0, "/root/repo")

from pyspark.sql import SparkSession

import __spark_entry__ as entry
from tests.oracle import compare, connect


def main() -> int:
    args = [a for a in sys.argv[1:] if not a.startswith("--")]
    sf = next((a.split("=")[1] for a in sys.argv[1:] if a.startswith("--sf=")), "0.001")
    base = f"/root/testdata/sf{sf}"
    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false").config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(base)
    sqls = entry.oracle_sql()
    bad = 0
    for name, make in entry.queries().items():
        if args and not any(name.startswith(a) for a in args):
            continue
        start = time.time()
        try:
            df = make(spark, base)
            note = compare(df, con, sqls[name]) if name in sqls else f"rows-only: {df.count()}"
        except Exception as exc:  # a failing query must not hide the rest of the report
            note = f"{type(exc).__name__}: {str(exc)[:1500]}"
        took = time.time() - start
        ok = note is None or note.startswith("rows-only")
        bad += not ok
        print(f"{'ok  ' if ok else 'BAD '} {name} {took:.1f}s {note or ''}", flush=True)
    print("failures:", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
