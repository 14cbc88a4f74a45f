"""Run registered queries next to their SQL and compare rows, names and types."""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in glob.glob(os.path.join(sf_dir, "*.parquet")):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _kind(t) -> str:
    text = str(t).replace("large_", "")
    return "timestamp" if text.startswith("timestamp") else text


def _key(value):
    if value is None:
        return "\0"
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    return repr(value)


def rows(table) -> list[tuple]:
    names = sorted(table.column_names)
    columns = [table.column(n).to_pylist() for n in names]
    return sorted(tuple(_key(v) for v in row) for row in zip(*columns))


def check(spark, con, name, run, sql, sf_dir) -> str | None:
    """Text that describes a difference, or None."""
    ours = run(spark, sf_dir).toArrow()
    theirs = con.sql(sql)
    theirs = theirs.to_arrow_table() if hasattr(theirs, "to_arrow_table") else theirs.arrow()
    if sorted(ours.column_names) != sorted(theirs.column_names):
        return f"columns {ours.column_names} / {theirs.column_names}"
    for n in ours.column_names:
        a, b = _kind(ours.schema.field(n).type), _kind(theirs.schema.field(n).type)
        if a != b:
            return f"type of {n}: {a} / {b}"
    if ours.num_rows == 0 or ours.num_rows != theirs.num_rows:
        return f"rows {ours.num_rows} / {theirs.num_rows}"
    a, b = rows(ours), rows(theirs)
    if a != b:
        only = [x for x in a if x not in set(b)][:3], [x for x in b if x not in set(a)][:3]
        return f"values {sorted(ours.column_names)} {only[0]} / {only[1]}"
    return None


def main() -> None:
    from catalog import ORACLES, QUERIES
    from vetloom.session import get_spark

    sf_dir = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    wanted = sys.argv[1:]
    spark = get_spark("compare", "local[8]", **{"spark.sql.shuffle.partitions": "8",
        "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con, bad = duck(sf_dir), 0
    for name, run in QUERIES.items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        start = time.time()
        try:
            if name in ORACLES:
                problem = check(spark, con, name, run, ORACLES[name], sf_dir)
            else:
                problem = None if run(spark, sf_dir).toArrow().num_rows else "no rows"
        except Exception as e:  # noqa: BLE001
            problem = f"{type(e).__name__}: {str(e)[:700]}"
        bad += problem is not None
        print(f"{'FAIL' if problem else 'ok  '} {name} {time.time() - start:.2f}s {problem or ''}",
              flush=True)
    print("failed:", bad)


if __name__ == "__main__":
    main()
