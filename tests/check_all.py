"""Run registered queries against their SQL twins: check_all.py SF [name ...]."""

from __future__ import annotations

import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as entry  # noqa: E402
from slidelake.session import local_session  # noqa: E402
from tests.compare import compare, duck  # noqa: E402


def main() -> None:
    sf, names = sys.argv[1], sys.argv[2:]
    sf_dir = f"/root/testdata/sf{sf}"
    spark = local_session("8")
    con = duck(sf_dir)
    queries, sql = entry.queries(), entry.oracle_sql()
    bad = 0
    for n in names or queries:
        t0 = time.time()
        try:
            df = queries[n](spark, sf_dir)
            if n in sql:
                r = compare(df, con, sql[n])
                flag = "ok  " if r["ok"] and not r["types"] else "TYPE" if r["ok"] else "BAD "
                bad += flag != "ok  "
                print(flag, n, r["rows"], f"{time.time() - t0:.2f}s", r["types"] or "", r.get("detail", ""), flush=True)
            else:
                rows = df.count()
                print("rows", n, rows, f"{time.time() - t0:.2f}s", flush=True)
        except Exception as e:  # noqa: BLE001
            bad += 1
            print("FAIL", n, f"{time.time() - t0:.2f}s", type(e).__name__, str(e)[:600], flush=True)
            if len(names) == 1:
                traceback.print_exc()
    print("not ok:", bad)


if __name__ == "__main__":
    main()
