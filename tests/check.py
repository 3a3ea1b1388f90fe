"""Run registered queries against their SQL and print one line each.

    python tests/check.py [sf_dir] [name substring ...]
"""

import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import oracle

from millrace import plans
from millrace.session import local_session

if __name__ == "__main__":
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    wanted = sys.argv[2:]
    spark = local_session(8, 8)
    con = oracle.connect(sf_dir)
    sql = plans.oracle_sql()
    bad = 0
    for name, fn in plans.queries().items():
        if wanted and not any(w in name for w in wanted):
            continue
        start = time.time()
        try:
            if name in sql:
                mid = None
                problem = oracle.difference(fn(spark, sf_dir), con, sql[name])
            else:
                problem = None if fn(spark, sf_dir).count() >= 0 else "?"
        except Exception as error:  # report and go on with the next query
            problem = str(error)[:1500] if os.environ.get("FULL") else str(error)[:500]
            if os.environ.get("FULL"):
                traceback.print_exc()
        took = time.time() - start
        if problem or took > 5 or os.environ.get("ALL"):
            print(f"{'BAD' if problem else 'ok '} {name} {took:.1f}s {'' if name in sql else '(no sql)'} {problem or ''}", flush=True)
        bad += bool(problem)
    print("bad:", bad)
    spark.stop()
