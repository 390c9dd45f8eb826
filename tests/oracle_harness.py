"""Run registered Spark queries next to their DuckDB twins and compare
row count, column names and an order-insensitive hash of the values."""

from __future__ import annotations

import hashlib
import math
import sys
import time

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, 9)
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    if hasattr(v, "asDict"):
        return _norm(v.asDict(recursive=True))
    return v


def digest(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    canon = sorted(repr(tuple(_norm(r[i]) for i in order)) for r in rows)
    h = hashlib.sha256()
    for line in canon:
        h.update(line.encode("utf-8", "surrogatepass"))
        h.update(b"\n")
    return sorted(columns), len(rows), h.hexdigest()


SPARK_TO_DUCK = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE",
                 "boolean": "BOOLEAN", "float": "FLOAT", "smallint": "SMALLINT", "date": "DATE"}


def types_match(df, rel):
    s = {f.name: SPARK_TO_DUCK.get(f.dataType.simpleString(), f.dataType.simpleString())
         for f in df.schema.fields}
    d = {n: str(t) for n, t in zip(rel.columns, rel.types)}
    return s == d, s, d


def duck(sf_dir):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def compare(spark, sf_dir, names=None, verbose=True):
    sys.path.insert(0, "/root/repo")
    import __spark_entry__ as E
    qs, sqls = E.queries(), E.oracle_sql()
    con = duck(sf_dir)
    results = {}
    for name in (names or qs):
        t0 = time.time()
        df = qs[name](spark, sf_dir)
        srows = [tuple(r) for r in df.collect()]
        scols = df.columns
        t1 = time.time()
        s = digest(scols, srows)
        if name not in sqls:
            results[name] = ("no-sql", s[1], None)
            if verbose:
                print(f"{name:32s} rows={s[1]:8d} spark={t1-t0:6.2f}s (no oracle)", flush=True)
            continue
        rel = con.sql(sqls[name])
        dcols = rel.columns
        drows = rel.fetchall()
        d = digest(dcols, drows)
        tok, st, dt = types_match(df, rel)
        ok = s == d and tok
        results[name] = (ok, s, d)
        if verbose:
            print(f"{name:32s} rows={s[1]:8d}/{d[1]:8d} cols={'ok' if s[0]==d[0] else 'DIFF'} "
                  f"types={'ok' if tok else 'DIFF'} "
                  f"hash={'ok' if s[2]==d[2] else 'DIFF'} spark={t1-t0:6.2f}s", flush=True)
            if not tok:
                print("   spark types:", st, "\n   duck types: ", dt)
            if s[0] != d[0]:
                print("   spark:", s[0], "\n   duck: ", d[0])
    return results


if __name__ == "__main__":
    from pyspark.sql import SparkSession
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or None
    spark = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
             .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    res = compare(spark, sf, names)
    bad = [k for k, v in res.items() if v[0] is False]
    print("MISMATCH:", bad if bad else "none")
