"""Compare every registered query with its SQL: python tests/check_all.py [sf_dir] [name ...]."""

from __future__ import annotations

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from ledgerline.plans import catalog  # noqa: E402
from ledgerline.session import build_session  # noqa: E402
from tests import oracle  # noqa: E402


def main(argv: list[str]) -> int:
    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    names = argv[1:] or list(catalog.QUERIES)
    spark = build_session(
        master="local[8]",
        **{"spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = oracle.connect(sf_dir)
    bad = 0
    for name in names:
        start = time.time()
        build = catalog.QUERIES[name]
        try:
            if name in catalog.CHECKS:
                verdict = oracle.compare(spark, con, build, catalog.CHECKS[name], sf_dir)
            else:
                verdict = f"rows only: {build(spark, sf_dir).count()}"
        except Exception as error:  # report and go on with the next query
            verdict = f"{type(error).__name__}: {str(error)[:700]}"
        bad += bool(verdict) and not verdict.startswith("rows only")
        print(f"{name:32s} {time.time() - start:6.2f}s  {verdict or 'ok'}", flush=True)
    print(f"{len(names)} queries, {bad} differ")
    return bad


if __name__ == "__main__":
    raise SystemExit(main(sys.argv[1:]))
