"""python tests/run_oracle.py [sf_dir] [name ...] – compare queries with their oracle."""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import __spark_entry__ as E  # noqa: E402
from oracle import compare, duck  # noqa: E402

from codeprep.session import get_session  # noqa: E402

if __name__ == "__main__":
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:]
    spark = get_session("local[8]", 8)
    con = duck(sf)
    qs, sqls = E.queries(), E.oracle_sql()
    bad = 0
    for name, fn in qs.items():
        if names and name not in names:
            continue
        t = time.time()
        if name not in sqls:
            n = fn(spark, sf).count()
            print(json.dumps({"name": name, "rows_only": n, "sec": round(time.time() - t, 2)}))
            continue
        try:
            info = compare(spark, con, name, fn, sqls[name], sf)
        except Exception as e:  # report and go on
            info = {"name": name, "error": repr(e)[:800], "match": False}
        info["sec"] = round(time.time() - t, 2)
        bad += not info.get("match")
        print(json.dumps(info, default=str)[:3000], flush=True)
    print("MISMATCHES", bad)
