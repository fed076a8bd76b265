"""Runs registered queries in Spark and their SQL in DuckDB and compares rows.

    python tests/compare.py [name-prefix ...]      (FOLDER=/root/testdata/sf0.01)
"""

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels"
          " conversations").split()


def connect(folder):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def rows(cols, data):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(r[i] for i in order) for r in data), key=repr)


def compare(spark, con, folder, name, fn, sql):
    t0 = time.time()
    df = fn(spark, folder)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    t1 = time.time()
    if sql is None:
        return True, f"{len(got)} rows, no SQL, spark {t1 - t0:.1f}s"
    cur = con.execute(sql)
    cols = [c[0] for c in cur.description]
    want = rows(cols, cur.fetchall())
    t2 = time.time()
    note = f"{len(got)} rows, spark {t1 - t0:.1f}s, sql {t2 - t1:.1f}s"
    if sorted(df.columns) != sorted(cols):
        return False, f"columns {sorted(df.columns)} / {sorted(cols)}"
    if got == want:
        return True, note
    only_s = [r for r in got if r not in set(map(tuple, want))][:3] if len(got) < 20000 else []
    only_d = [r for r in want if r not in set(got)][:3] if len(got) < 20000 else []
    return False, f"{note}; {len(want)} sql rows\n   spark only {only_s}\n   sql only   {only_d}"


def main(prefixes):
    import __spark_entry__ as entry
    from plumbline.session import build_session

    folder = os.environ.get("FOLDER", "/root/testdata/sf0.01")
    spark = build_session("compare")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    oracles, bad = entry.oracle_sql(), []
    for name, fn in entry.queries().items():
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        try:
            ok, note = compare(spark, con, folder, name, fn, oracles.get(name))
        except Exception as e:  # report and go on
            ok, note = False, f"{type(e).__name__}: {str(e)[:1500]}"
        print("ok  " if ok else "FAIL", name, note, flush=True)
        if not ok:
            bad.append(name)
    print("failed:", bad)


if __name__ == "__main__":
    main(sys.argv[1:])
