"""Command line: compare catalog queries with their SQL (name parts as arguments)."""

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from checker import compare, connect  # noqa: E402
from plotgrid.plans.catalog import CHECKS, QUERIES  # noqa: E402
from plotgrid.session import local_session  # noqa: E402

if __name__ == "__main__":
    sf_dir = f"/root/testdata/sf{sys.argv[1]}"
    wanted = sys.argv[2:]
    spark = local_session()
    connection = connect(sf_dir)
    for name, run in QUERIES.items():
        if wanted and not any(w in name for w in wanted):
            continue
        begin = time.time()
        try:
            frame = run(spark, sf_dir)
            outcome = compare(frame, connection, CHECKS[name]) if name in CHECKS else f"rows only: {frame.count()}"
        except Exception as error:  # report and go on with the next query
            outcome = f"ERROR {type(error).__name__} {str(error)[:600]}"
        print(f"{'ok  ' if outcome is None else 'FAIL' if 'rows only' not in outcome else 'rows'} "
              f"{name} {time.time() - begin:.1f}s {outcome or ''}", flush=True)
