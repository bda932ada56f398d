"""Compare every registered query with its SQL twin: check_all.py [data] [names...]."""

import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import __spark_entry__ as entry  # noqa: E402
from compare import connect, differences  # noqa: E402

from fieldglass.session import local_session  # noqa: E402

if __name__ == "__main__":
    data = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    spark = local_session("8")
    spark.sparkContext.setLogLevel("ERROR")
    con, queries, sql = connect(data), entry.queries(), entry.oracle_sql()
    bad = []
    for name in sys.argv[2:] or queries:
        begin = time.time()
        try:
            df = queries[name](spark, data)
            found = differences(df, con, sql[name]) if name in sql else [f"no SQL; {df.count()} rows"]
        except Exception as exc:  # noqa: BLE001
            found = [f"{type(exc).__name__}: {str(exc)[:600]}"]
            if os.environ.get("TRACE"):
                traceback.print_exc()
        print(f"{'ok ' if not found else 'BAD'} {name} {time.time() - begin:.1f}s", *[f"\n      {f[:900]}" for f in found], flush=True)
        if found:
            bad.append(name)
    print(len(bad), "bad:", " ".join(bad))
