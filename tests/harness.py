"""Run a registered query on Spark and its SQL on DuckDB, and compare the rows."""

from __future__ import annotations

import os
import sys
import time
from collections import Counter
from decimal import Decimal

import duckdb
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from claimlens.plans.registry import QUERIES  # noqa: E402
from claimlens.sources.binding import DRIVER_TABLES  # noqa: E402


def spark_session(cores: str = "8", memory: str = "12g") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("claimlens-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.driver.memory", memory)
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in DRIVER_TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _plain(v):
    if isinstance(v, Decimal):
        return format(v.normalize(), "f") if v else "0"
    if isinstance(v, float):
        return repr(round(v, 9))
    return v if v is None else str(v)


def bag(rows, names) -> Counter:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(_plain(r[i]) for i in order) for r in rows)


def compare(spark, con, name: str, sf_dir: str, params=None) -> dict:
    query = QUERIES[name]
    start = time.time()
    df = query.run(spark, sf_dir, params)
    rows = df.collect()
    took = time.time() - start
    names = df.columns
    result = {"name": name, "rows": len(rows), "sec": round(took, 2), "ok": None, "why": "", "df": df}
    sql = query.oracle(params)
    if sql is None:
        return result
    start = time.time()
    cursor = con.execute(sql)
    expected_names = [d[0] for d in cursor.description]
    expected = cursor.fetchall()
    result["duck"] = round(time.time() - start, 2)
    if sorted(names) != sorted(expected_names):
        only = set(names) ^ set(expected_names)
        return result | {"ok": False, "why": f"columns differ: {sorted(only)}"}
    ours, theirs = bag(rows, names), bag(expected, expected_names)
    if ours == theirs:
        return result | {"ok": True}
    missing, extra = list((theirs - ours).elements()), list((ours - theirs).elements())
    why = f"rows {len(rows)} vs {len(expected)}; {len(extra)} extra, {len(missing)} missing"
    if extra and missing:
        first = min(extra, key=lambda r: [str(x) for x in r])
        near = max(missing, key=lambda m: sum(a == b for a, b in zip(m, first)))
        columns = sorted(names)
        why += "; " + str({c: (a, b) for c, a, b in zip(columns, first, near) if a != b})
    elif extra or missing:
        why += "; " + str(dict(zip(sorted(names), (extra or missing)[0])))
    return result | {"ok": False, "why": why}


if __name__ == "__main__":
    sf = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    wanted = sys.argv[1:] or list(QUERIES)
    spark, con = spark_session(), duck(sf)
    bad = 0
    for n in [q for q in QUERIES if any(w in q for w in wanted)]:
        try:
            r = compare(spark, con, n, sf)
        except Exception as e:  # keep going, report at the end
            r = {"name": n, "ok": False, "why": f"{type(e).__name__}: {str(e)[:700]}", "rows": -1, "sec": 0}
        bad += r["ok"] is False
        mark = {True: "ok  ", False: "BAD ", None: "rows"}[r["ok"]]
        print(mark, n, r["rows"], f"{r['sec']}s", r.get("duck", ""), r["why"][:1500], flush=True)
    print("bad:", bad)
