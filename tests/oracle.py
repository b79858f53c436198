"""Compare registered queries with their SQL on the driver tables."""

from __future__ import annotations

import datetime
import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _kind(t) -> str:
    t = str(t).replace("large_", "")
    return "timestamp" if t.startswith("timestamp") else t


def _cell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return repr(v)


def compare(spark, con, sf_dir: str, fn, sql: str) -> list[str]:
    """The differences between both results; none when rows, types and values agree."""
    left = fn(spark, sf_dir).toArrow()
    right = con.execute(sql).to_arrow_table()
    problems = []
    names = sorted(left.column_names)
    if names != sorted(right.column_names):
        return [f"columns {names} vs {sorted(right.column_names)}"]
    for n in names:
        a, b = _kind(left.schema.field(n).type), _kind(right.schema.field(n).type)
        if a != b:
            problems.append(f"type of {n}: {a} vs {b}")
    if left.num_rows != right.num_rows:
        problems.append(f"rows {left.num_rows} vs {right.num_rows}")

    def rows(t):
        cols = [t.column(n).to_pylist() for n in names]
        return sorted(tuple(_cell(v) for v in r) for r in zip(*cols))

    a, b = rows(left), rows(right)
    if a != b:
        sa, sb = set(a), set(b)
        only_a, only_b = sorted(sa - sb)[:2], sorted(sb - sa)[:2]
        problems.append(f"values: only spark {len(sa - sb)} e.g. {only_a}; only sql {len(sb - sa)} e.g. {only_b}")
    if not problems and not a:
        problems.append("EMPTY")
    return problems


if __name__ == "__main__":
    sys.path.insert(0, __file__.rsplit("/", 2)[0])
    import __spark_entry__ as entry
    from histloom.session import local_session

    sf = sys.argv[1]
    wanted = sys.argv[2:]
    spark, con = local_session(), connect(sf)
    q, o = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in q:
        if wanted and not any(name == w or (w.endswith("*") and name.startswith(w[:-1])) for w in wanted):
            continue
        t = time.time()
        try:
            if name in o:
                problems = compare(spark, con, sf, q[name], o[name])
            else:
                problems = [] if q[name](spark, sf).toArrow().num_rows else ["EMPTY"]
        except Exception as e:  # noqa: BLE001
            problems = [f"{type(e).__name__}: {str(e)[:1500]}"]
        bad += bool(problems)
        kind = "sql" if name in o else "rows"
        print(f"{'FAIL' if problems else 'ok  '} {name} [{kind}] {time.time() - t:.1f}s {' | '.join(problems)[:2500]}", flush=True)
    print("failed:", bad)
