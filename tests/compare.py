"""Run registered queries against their comparison SQL.

``python tests/compare.py [sf_dir] [query ...]`` prints one line per query.
"""

from __future__ import annotations

import datetime
import decimal
import math
import os
import sys
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _cell(value) -> str:
    if isinstance(value, bool) or value is None:
        return str(value)
    if isinstance(value, (float, decimal.Decimal)):
        return "nan" if math.isnan(value) else f"{float(value):.6f}"
    if isinstance(value, int):
        return f"{float(value):.6f}"
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    return str(value)


def canonical(columns: list[str], rows: list) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def differences(spark, con, query, sql: str, sf_dir: str) -> str | None:
    """None if both engines agree, else a short description."""
    df = query(spark, sf_dir)
    got_columns, got = canonical(df.columns, [tuple(r) for r in df.collect()])
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    want_columns, want = canonical(names, cursor.fetchall())
    if got_columns != want_columns:
        return f"columns {sorted(set(got_columns) ^ set(want_columns))}"
    if got != want:
        extra, missing = sorted(set(got) - set(want)), sorted(set(want) - set(got))
        text = f"rows {len(got)} vs {len(want)}, {len(extra)} only here, {len(missing)} only there"
        if extra and missing:
            fields = [f"{c}: {a!r} != {b!r}" for c, a, b in zip(got_columns, extra[0], missing[0]) if a != b]
            text += "; first: " + "; ".join(fields)[:600]
        elif extra or missing:
            text += f"; first: {(extra or missing)[0]}"[:600]
        return text
    return None


def main() -> None:
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as E
    from sitegauge.session import local_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark, con = local_session("compare"), connect(sf_dir)
    queries, oracle = E.queries(), E.oracle_sql()
    failed = []
    for name in sys.argv[2:] or queries:
        start = time.time()
        try:
            if name in oracle:
                result = differences(spark, con, queries[name], oracle[name], sf_dir)
                n = ""
            else:
                result, n = None, f" rows {queries[name](spark, sf_dir).count()} (no SQL)"
        except Exception as error:  # report and go on
            result, n = f"{type(error).__name__}: {str(error)[:700]}", ""
        print(f"{'ok  ' if result is None else 'FAIL'} {name} {time.time() - start:.1f}s{n} {result or ''}", flush=True)
        if result:
            failed.append(name)
    print(f"{len(failed)} failed: {failed}")


if __name__ == "__main__":
    main()
