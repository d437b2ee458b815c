"""Compare a query with its SQL the way the driver does: by sorted columns and whole rows."""

from __future__ import annotations

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def duck(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def normal(value):
    if isinstance(value, float):
        return round(value, 9) + 0.0
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(
        (tuple(normal(r[i]) for i in order) for r in rows),
        key=lambda r: tuple((v is not None, str(v)) for v in r),
    )


def compare(df, con, sql) -> tuple[int, str]:
    """Row count and '' if all agrees, else what does not."""
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    want = rows_of(names, result.fetchall())
    have = rows_of(df.columns, df.collect())
    if sorted(names) != sorted(df.columns):
        return len(have), f"columns {sorted(df.columns)} != {sorted(names)}"
    if len(want) != len(have):
        return len(have), f"{len(have)} rows != {len(want)}"
    wrong = [(h, w) for h, w in zip(have, want) if h != w]
    return len(have), f"{len(wrong)} rows differ: {wrong[:2]}" if wrong else ""
