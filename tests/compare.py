"""Run registered queries beside their DuckDB statements and compare whole results."""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def duck(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _cell(value):
    if isinstance(value, float):
        if math.isnan(value):
            return "NaN"
        return repr(value + 0.0)
    return repr(value)


def compare(spark, sf_dir: str, fn, sql: str | None, con) -> tuple[str, int, float]:
    """('ok' or a reason, row count, seconds of the Spark side)."""
    start = time.time()
    frame = fn(spark, sf_dir)
    rows = [tuple(r) for r in frame.collect()]
    took = time.time() - start
    if sql is None:
        return "ok (no statement)", len(rows), took
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    types = {d[0]: str(d[1]) for d in cur.description}
    expected = cur.fetchall()
    if sorted(names) != sorted(frame.columns):
        return f"columns {sorted(frame.columns)} != {sorted(names)}", len(rows), took
    odd = [f"{n}:{t}" for n, t in types.items() if t.startswith(("HUGEINT", "DECIMAL", "UBIGINT", "UINTEGER"))]
    odd += [f"spark {n}:{t}" for n, t in frame.dtypes if t.startswith(("decimal",))]
    kinds = {"int": "i", "bigint": "i", "smallint": "i", "tinyint": "i", "double": "f", "float": "f", "string": "s",
             "boolean": "b", "INTEGER": "i", "BIGINT": "i", "DOUBLE": "f", "FLOAT": "f", "VARCHAR": "s", "BOOLEAN": "b",
             "STRING": "s", "NUMBER": "n"}
    for n, t in frame.dtypes:
        a, b = kinds.get(t, t), kinds.get(types[n].strip("'"), types[n])
        if a != b:
            odd.append(f"{n}: {t} vs {types[n]}")
    order = sorted(names)
    mine = sorted(tuple(_cell(r[frame.columns.index(n)]) for n in order) for r in rows)
    theirs = sorted(tuple(_cell(r[names.index(n)]) for n in order) for r in expected)
    if len(mine) != len(theirs):
        return f"rows {len(mine)} != {len(theirs)}", len(rows), took
    for a, b in zip(mine, theirs):
        if a != b:
            diff = [(n, x, y) for n, x, y in zip(order, a, b) if x != y]
            return f"value {diff[:4]} in {a[:6]}", len(rows), took
    if odd:
        return f"types {odd}", len(rows), took
    return ("ok" if rows else "EMPTY"), len(rows), took


def main() -> None:
    sys.path.insert(0, __file__.rsplit("/", 2)[0])
    import __spark_entry__ as entry
    from tallyforge.session import local_session

    sf_dir = sys.argv[1]
    wanted = sys.argv[2:]
    spark = local_session()
    con = duck(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, fn in queries.items():
        if wanted and not any(w in name for w in wanted):
            continue
        try:
            verdict, rows, took = compare(spark, sf_dir, fn, oracles.get(name), con)
        except Exception as err:  # report and go on with the next query
            verdict, rows, took = "ERROR " + str(err).replace("\n", " ")[:400], 0, 0.0
        bad += not verdict.startswith("ok")
        print(f"{name:48s} {rows:7d} {took:6.2f}s {verdict}", flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main()
