"""Command line check: ``python tests/run_oracles.py <sf_dir> [query ...]``."""

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from oracle import compare, connect  # noqa: E402
from pyspark.sql import SparkSession  # noqa: E402

import __spark_entry__ as entry  # noqa: E402

if __name__ == "__main__":
    sf_dir, names = sys.argv[1], sys.argv[2:] or list(entry.queries())
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    for name in names:
        start = time.time()
        try:
            sql = entry.oracle_sql().get(name)
            df = entry.queries()[name](spark, sf_dir)
            rows, problem = compare(df, con, sql) if sql else (df.count(), "no sql")
        except Exception as e:  # report and go on with the next query
            rows, problem = -1, f"{type(e).__name__}: {str(e)[:600]}"
        print(f"{'ok ' if not problem else 'BAD'} {name} rows={rows} {time.time() - start:.1f}s {problem}", flush=True)
