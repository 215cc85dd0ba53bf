"""Side-by-side comparison of a Spark result with its DuckDB text."""

from __future__ import annotations

import glob
import math
import os

import duckdb

TYPES = {
    "tinyint": "TINYINT", "smallint": "SMALLINT", "int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE",
    "float": "FLOAT", "string": "VARCHAR", "boolean": "BOOLEAN", "date": "DATE",
}


def connect(folder: str):
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _key(row):
    return tuple((v is None, str(type(v)), v if v is not None else 0) if not isinstance(v, float) else (False, "f", v) for v in row)


def differences(df, con, sql: str) -> list[str]:
    """Empty when names, types and the multiset of rows agree; floats must be equal."""
    names = sorted(df.columns)
    got = [tuple(r[n] for n in names) for r in df.collect()]
    result = con.execute(sql)
    theirs = [d[0] for d in result.description]
    their_types = dict(zip(theirs, [str(d[1]) for d in result.description]))
    if sorted(theirs) != names:
        return [f"columns {names} vs {sorted(theirs)}"]
    place = [theirs.index(n) for n in names]
    want = [tuple(r[i] for i in place) for r in result.fetchall()]
    problems = []
    for n, t in df.dtypes:
        if TYPES.get(t, t) != their_types[n]:
            problems.append(f"type of {n}: {t} vs {their_types[n]}")
    if len(got) != len(want):
        return problems + [f"{len(got)} rows vs {len(want)}"]
    got.sort(key=_key)
    want.sort(key=_key)
    bad = [(g, w) for g, w in zip(got, want) if not _same(g, w)]
    if bad:
        close = sum(_same(g, w, 1e-9) for g, w in bad)
        problems.append(f"{len(bad)} of {len(got)} rows differ ({close} only by 1e-9): {bad[0][0]} vs {bad[0][1]}")
    return problems


def _same(g, w, tol: float = 0.0) -> bool:
    for a, b in zip(g, w):
        if isinstance(a, float) and isinstance(b, float):
            if a != b and not (math.isnan(a) and math.isnan(b)) and not (tol and math.isclose(a, b, rel_tol=tol, abs_tol=tol)):
                return False
        elif a != b:
            return False
    return True
