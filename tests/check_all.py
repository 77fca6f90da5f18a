"""Run every registered query at a scale and compare it with its SQL: python tests/check_all.py [folder] [names...]"""

import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from compare import connect, difference

from tabkit import catalog
from tabkit.session import build_session

folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
names = sys.argv[2:] or list(catalog.QUERIES)
spark = build_session(cores=8)
con = connect(folder)
bad = 0
for name in names:
    start = time.time()
    try:
        df = catalog.QUERIES[name](spark, folder)
        if name in catalog.ORACLE:
            verdict = difference(df, con, catalog.ORACLE[name])
            types = {f.name: f.dataType.simpleString() for f in df.schema}
            duck = {c[0]: str(c[1]) for c in con.execute(catalog.ORACLE[name]).description}
            note = " ".join(f"{k}:{types[k]}/{duck.get(k)}" for k in types)
        else:
            rows = df.collect()
            verdict, note = None, f"{len(rows)} rows, first {rows[:3]}"
    except Exception as problem:
        verdict, note = "".join(traceback.format_exception_only(problem))[:1500], ""
    bad += verdict is not None
    print(f"{'BAD' if verdict else 'ok '} {name:22} {time.time() - start:6.2f}s {verdict or note}", flush=True)
print("bad:", bad)
