"""Run registered queries and their SQL side by side: python -m tests.compare [folder] [names...]"""

from __future__ import annotations

import sys
import time

import duckdb

from passagery.sources.tables import TABLES


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def _cell(value) -> str:
    if isinstance(value, float) and value.is_integer():
        return f"{value:.1f}"
    return repr(value)


def normalized(columns: list[str], rows: list[tuple]) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def difference(spark, con, name: str, fn, sql: str, folder: str) -> str | None:
    """None when equal, else a short description."""
    df = fn(spark, folder)
    left = normalized(df.columns, [tuple(r) for r in df.collect()])
    res = con.execute(sql)
    right = normalized([d[0] for d in res.description], res.fetchall())
    if left[0] != right[0]:
        return f"columns {left[0]} vs {right[0]}"
    if left[1] == right[1]:
        return None
    only_l = [r for r in left[1] if r not in set(right[1])][:2]
    only_r = [r for r in right[1] if r not in set(left[1])][:2]
    return f"rows {len(left[1])} vs {len(right[1])}; spark only {str(only_l)[:600]}; sql only {str(only_r)[:600]}"


def main() -> None:
    import __spark_entry__ as entry
    from passagery.session import build_session

    args = sys.argv[1:]
    folder = args.pop(0) if args and "/" in args[0] else "/root/testdata/sf0.01"
    spark = build_session("compare", "local[8]", spark__sql__shuffle__partitions="8")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in args or list(queries):
        start = time.time()
        try:
            if name in oracles:
                note = difference(spark, con, name, queries[name], oracles[name], folder) or "equal"
            else:
                note = f"rows only: {queries[name](spark, folder).count()}"
        except Exception as error:  # report and go on
            note = f"ERROR {type(error).__name__}: {str(error)[:700]}"
        bad += not note.startswith(("equal", "rows only"))
        print(f"{name}: {note} ({time.time() - start:.1f}s)", flush=True)
    print(f"{bad} not equal")


if __name__ == "__main__":
    main()
