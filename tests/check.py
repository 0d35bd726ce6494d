"""Compare registered queries with their SQL twins: ``python tests/check.py SF_DIR [name ...]``."""

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as entry  # noqa: E402
from changeflow.session import local_session  # noqa: E402
from oracle import compare, connect  # noqa: E402


def main(sf: str, names: list[str]) -> int:
    spark = local_session(8, 8, **{"spark.ui.showConsoleProgress": "false"})
    con = connect(sf)
    queries, oracle = entry.queries(), entry.oracle_sql()
    failed = 0
    for name in names or list(queries):
        t = time.time()
        try:
            if name in oracle:
                n, problem = compare(spark, con, queries[name], oracle[name], sf)
            else:
                n, problem = queries[name](spark, sf).count(), None
        except Exception as e:  # noqa: BLE001 - report and go on
            n, problem = "?", f"{type(e).__name__}: {str(e)[:600]}"
        failed += problem is not None
        kind = "sql " if name in oracle else "rows"
        print(f"{'FAIL' if problem else 'ok  '} {kind} {name:32} {n!s:>8} rows {time.time() - t:6.2f}s {problem or ''}", flush=True)
    print(f"{failed} failed")
    return failed


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1], sys.argv[2:]) else 0)
