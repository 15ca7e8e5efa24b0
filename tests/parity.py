"""Spark-vs-DuckDB parity for the registered queries.

Runs each ``queries()[key]`` on Spark and ``oracle_sql()[key]`` on DuckDB
over the same Parquet tables, and compares column names, row counts, type
families and the multiset of rows (columns sorted by name, floats by repr).

    python tests/parity.py [sf_dir] [key ...]
"""

from __future__ import annotations

import datetime as dt
import decimal
import math
import os
import sys
import time

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def duck(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return repr(float(v))
    if isinstance(v, decimal.Decimal):
        return repr(float(v))
    if isinstance(v, bool):
        return v
    if isinstance(v, int):
        return v
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, dt.date):
        return v.isoformat()
    return str(v)


def _family(typename: str) -> str:
    t = typename.lower()
    if any(x in t for x in ("int", "long", "short", "byte")):
        return "int"
    if any(x in t for x in ("double", "float", "decimal", "numeric", "real")):
        return "float"
    if "timestamp" in t:
        return "timestamp"
    if "date" in t:
        return "date"
    if "bool" in t:
        return "bool"
    return "string"


def compare(spark, con, key: str, build, sql: str, sf_dir: str) -> dict:
    t0 = time.time()
    df = build(spark, sf_dir)
    s_cols = df.columns
    s_types = {f.name: _family(f.dataType.simpleString()) for f in df.schema.fields}
    s_rows = [tuple(r) for r in df.collect()]
    t1 = time.time()
    cur = con.execute(sql)
    d_cols = [c[0] for c in cur.description]
    d_types = {c[0]: _family(str(c[1])) for c in cur.description}
    d_rows = cur.fetchall()
    t2 = time.time()
    out = {"key": key, "spark_rows": len(s_rows), "oracle_rows": len(d_rows),
           "spark_sec": round(t1 - t0, 2), "oracle_sec": round(t2 - t1, 2)}
    if sorted(s_cols) != sorted(d_cols):
        out["error"] = f"columns differ: spark={s_cols} oracle={d_cols}"
        return out
    order = sorted(s_cols)
    bad_types = {c: (s_types[c], d_types[c]) for c in order if s_types[c] != d_types[c]}
    if bad_types:
        out["type_mismatch"] = bad_types
    si = [s_cols.index(c) for c in order]
    di = [d_cols.index(c) for c in order]
    key_fn = lambda r: tuple((x is None, str(x)) for x in r)
    s_norm = sorted((tuple(_norm(r[i]) for i in si) for r in s_rows), key=key_fn)
    d_norm = sorted((tuple(_norm(r[i]) for i in di) for r in d_rows), key=key_fn)
    out["match"] = (s_norm == d_norm) and not bad_types
    if s_norm != d_norm:
        only_s = [r for r in s_norm if r not in set(d_norm)][:3]
        only_d = [r for r in d_norm if r not in set(s_norm)][:3]
        out["columns"] = order
        out["only_spark"] = only_s
        out["only_oracle"] = only_d
    return out


def main(argv: list[str]) -> int:
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    keys = argv[2:]
    from __spark_entry__ import oracle_sql, queries
    from scoreline.session import get_session
    spark = get_session("local[8]", 8)
    con = duck(sf_dir)
    qs, sqls = queries(), oracle_sql()
    ok = True
    for key in keys or list(qs):
        if key not in sqls:
            print({"key": key, "note": "no oracle"})
            continue
        try:
            res = compare(spark, con, key, qs[key], sqls[key], sf_dir)
        except Exception as e:  # report and go on with the next key
            res = {"key": key, "error": repr(e)[:800]}
        ok = ok and bool(res.get("match"))
        print(res, flush=True)
    return 0 if ok else 1


if __name__ == "__main__":
    sys.exit(main(sys.argv))
