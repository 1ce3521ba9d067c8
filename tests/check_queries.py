"""Run registered queries against DuckDB: ``python tests/check_queries.py [sf_dir] [name ...]``."""

from __future__ import annotations

import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as entry  # noqa: E402
from compare import connect, difference  # noqa: E402
from foldsmith.session import get_session  # noqa: E402


def main(sf_dir: str, names: list[str]) -> int:
    spark = get_session("check", "local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false",
                        spark__driver__memory="12g")
    spark.sparkContext.setLogLevel("ERROR")
    con, oracles, bad = connect(sf_dir), entry.oracle_sql(), 0
    for name, fn in entry.queries().items():
        if names and name not in names:
            continue
        started = time.time()
        try:
            df = fn(spark, sf_dir)
            text = difference(df, con, oracles[name]) if name in oracles else f"rows only: {df.count()}"
            ok = text is None or name not in oracles
        except Exception as e:
            ok, text = False, "".join(traceback.format_exception_only(e))[:700]
        bad += not ok
        print(f"{'ok ' if ok else 'BAD'} {name:<32} {time.time() - started:6.2f}s {text or ''}", flush=True)
    print(f"{bad} bad")
    return bad


if __name__ == "__main__":
    args = sys.argv[1:]
    folder = args.pop(0) if args and args[0].startswith("/") else "/root/testdata/sf0.001"
    sys.exit(1 if main(folder, args) else 0)
