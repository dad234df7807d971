"""Run every registered query against its DuckDB oracle (what the driver's
correctness gate does).  Usage: python tests/run_oracles.py [sf_dir] [name...]"""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from oracle_compare import compare, duck  # noqa: E402

import __spark_entry__ as E  # noqa: E402
from tollgate.session import get_session  # noqa: E402


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:]
    spark = get_session("local[8]")
    con = duck(sf)
    q, o = E.queries(), E.oracle_sql()
    bad = 0
    for name in names or list(q):
        t = time.time()
        try:
            df = q[name](spark, sf)
            if name in o:
                r = compare(df, con, o[name])
            else:
                r = {"rows_spark": df.count(), "ok": None}
        except Exception as e:  # report and continue
            r = {"ok": False, "error": f"{type(e).__name__}: {str(e)[:400]}"}
        r["sec"] = round(time.time() - t, 2)
        bad += r.get("ok") is False
        print("\nRESULT", name, json.dumps(r, default=str), flush=True)
    print("FAILED", bad)


if __name__ == "__main__":
    main()
