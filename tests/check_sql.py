"""Run registered queries against their SQL: python tests/check_sql.py [folder] [prefix ...]."""

import sys
import time
import traceback
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from pyspark.sql import SparkSession  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
from tests.compare import compare, connect  # noqa: E402

folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
prefixes = tuple(sys.argv[2:])
spark = (
    SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
    .config("spark.ui.enabled", "false").config("spark.driver.memory", "12g")
    .config("spark.sql.session.timeZone", "UTC").getOrCreate()
)
spark.sparkContext.setLogLevel("OFF")
con, sql, bad, n = connect(folder), entry.oracle_sql(), 0, 0
for name, fn in entry.queries().items():
    if prefixes and not name.startswith(prefixes):
        continue
    n += 1
    start = time.time()
    try:
        df = fn(spark, folder)
        text = compare(df, con, sql[name]) if name in sql else f"rows only: {len(df.collect())}"
        ok = text is None or name not in sql
    except Exception:
        text, ok = "".join(traceback.format_exc().splitlines(True)[-4:])[:1500], False
    bad += not ok
    print(f"{'ok  ' if ok else 'FAIL'} {name} {time.time() - start:.1f}s {text or ''}", flush=True)
print(f"{n} queries, {bad} failures")
sys.exit(bool(bad))
