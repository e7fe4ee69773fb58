"""Run queries next to their SQL: ``python -m tests.check_all [sf_dir] [name ...]``."""

from __future__ import annotations

import sys
import time

from pyspark.sql import SparkSession

import __spark_entry__ as e
from tests.oracle import connect, differences


def main() -> int:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    sql, bad = e.oracle_sql(), 0
    for name, run in e.queries().items():
        if sys.argv[2:] and name not in sys.argv[2:]:
            continue
        t = time.time()
        try:
            df = run(spark, sf_dir)
            if name in sql:
                problems = differences(df, con, sql[name])
            else:
                problems = []
            n = df.count()
        except Exception as x:  # noqa: BLE001
            problems, n = [f"{type(x).__name__}: {str(x)[:1500]}"], -1
        bad += bool(problems)
        print(
            f"{'BAD' if problems else 'ok '} {name} rows={n} sql={name in sql} {time.time() - t:.1f}s",
            flush=True,
        )
        for p in problems:
            print("     ", p)
    return bad


if __name__ == "__main__":
    sys.exit(main())
