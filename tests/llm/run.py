"""Run registered queries against their SQL: python tests/llm/run.py sf_dir [name substring ...]"""

import os
import sys
import time

sys.path[:0] = [os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))), os.path.dirname(os.path.dirname(os.path.abspath(__file__)))]

import oracle

from millrace import llm
from millrace.session import local_session

if __name__ == "__main__":
    sf_dir, wanted = sys.argv[1], sys.argv[2:]
    spark = local_session(8, 8)
    con = oracle.connect(sf_dir)
    for name, fn in llm.queries().items():
        if not wanted or any(w in name for w in wanted):
            start = time.time()
            df = fn(spark, sf_dir)
            sql = llm.oracle_sql().get(name)
            said = oracle.difference(df, con, sql) if sql else df.count()
            print(name, f"{time.time() - start:.1f}s", said, df.columns, flush=True)
    spark.stop()
