"""Run every query beside its SQL and print what differs.

    python verify.py [table folder] [query name ...]
"""

from __future__ import annotations

import sys
import time

from dossier import plans
from dossier.session import local_session
from dossier.comparison import connection, differences


def main() -> int:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:] or list(plans.QUERIES)
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = connection(sf_dir)
    bad = 0
    for name in wanted:
        entry = plans.QUERIES[name]
        started = time.time()
        try:
            df = entry.build(spark, sf_dir)
            report = f"rows {df.count()}, no SQL" if entry.sql is None else differences(df, con, entry.sql)
            failed = entry.sql is not None and report is not None
        except Exception as error:  # noqa: BLE001 - report and go on
            report, failed = f"{type(error).__name__}: {str(error)[:1500]}", True
        bad += failed
        print(f"{'BAD' if failed else 'ok '} {name:28s} {time.time() - started:6.2f}s {report or ''}", flush=True)
    print(f"{len(wanted) - bad} of {len(wanted)} fine")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
