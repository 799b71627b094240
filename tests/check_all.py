"""Run every registered query against its check: ``python tests/check_all.py FOLDER [NAME ...]``."""

import sys
import time
import traceback
from pathlib import Path

sys.path[:0] = [str(Path(__file__).resolve().parent.parent), str(Path(__file__).resolve().parent)]

from compare import connect, differences  # noqa: E402

from orderloom.plans.catalog import full_registry  # noqa: E402
from orderloom.session import build_session  # noqa: E402


def main() -> int:
    folder, names = sys.argv[1], sys.argv[2:]
    registry = full_registry()
    spark = build_session(master="local[8]", spark__sql__shuffle__partitions="8",
                          spark__driver__memory="8g", spark__ui__enabled="false", spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    bad = 0
    for name, query in registry.queries.items():
        if names and not any(name.startswith(n) for n in names):
            continue
        start = time.time()
        try:
            df = query(spark, folder)
            if name in registry.checks:
                found = differences(df, con, registry.checks[name])
                n = df.count()
            else:
                n, found = f"rows only: {df.count()}", []
        except Exception as error:  # noqa: BLE001 - the report lists every failure
            found = ["".join(traceback.format_exception_only(error))[:1500]]
            n = ""
        bad += bool(found)
        print(f"{'FAIL' if found else 'ok  '} {time.time() - start:6.2f}s {name} {n}", flush=True)
        for line in found:
            print("   ", line, flush=True)
    print("failures:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(main())
