"""Command line: compare queries with their SQL. Arguments: scale factor, then name prefixes."""

import sys
import time
import traceback
import warnings

warnings.filterwarnings("ignore")
sys.path[:0] = [".", "tests"]

from compare import compare, connect  # noqa: E402
from conftest import make_session  # noqa: E402

import __spark_entry__ as entry  # noqa: E402

sf = sys.argv[1]
prefixes = sys.argv[2:]
sf_dir = f"/root/testdata/sf{sf}"
spark = make_session()
con = connect(sf_dir)
oracles = entry.oracle_sql()
good = bad = 0
for name, fn in entry.queries().items():
    if prefixes and not any(name.startswith(p) for p in prefixes):
        continue
    t = time.time()
    try:
        df = fn(spark, sf_dir)
        if name in oracles:
            out = compare(df, con, oracles[name])
            label = "ok" if not out else "DIFF " + "; ".join(out)[:900]
        else:
            n = df.count()
            out = [] if n else ["no rows"]
            label = f"rows {n}"
    except Exception as exc:
        out = ["error"]
        label = "ERROR " + (str(exc)[:700] or repr(exc)) 
        if "-v" in sys.argv:
            traceback.print_exc()
    good, bad = good + (not out), bad + bool(out)
    print(f"{name}: {label} [{time.time() - t:.1f}s]", flush=True)
print(f"good {good} bad {bad}")
