"""Compare a Spark result with its SQL twin, ignoring row order."""

import datetime
import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()
_KINDS = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "string": "VARCHAR",
    "double": "DOUBLE",
    "timestamp_ntz": "TIMESTAMP",
    "boolean": "BOOLEAN",
}


def database(sf_dir):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return db


def _key(row):
    return tuple((v is None, str(type(v)), v if v is not None else 0) for v in row)


def _value(v):
    if isinstance(v, float):
        return 0.0 if v == 0 else v
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


def differences(spark_df, db, sql):
    """Empty when names, types, row count and values agree."""
    found = []
    result = db.sql(sql)
    kinds = dict(zip(result.columns, [str(t) for t in result.types]))
    names = sorted(spark_df.columns)
    if names != sorted(result.columns):
        return [f"columns {names} / {sorted(result.columns)}"]
    for f in spark_df.schema.fields:
        if _KINDS.get(f.dataType.simpleString()) != kinds[f.name]:
            found.append(f"type of {f.name}: {f.dataType.simpleString()} / {kinds[f.name]}")
    ours = sorted(
        (tuple(_value(r[n]) for n in names) for r in spark_df.collect()), key=_key
    )
    order = [result.columns.index(n) for n in names]
    theirs = sorted((tuple(_value(r[i]) for i in order) for r in result.fetchall()), key=_key)
    if len(ours) != len(theirs):
        found.append(f"rows {len(ours)} / {len(theirs)}")
    if not ours:
        found.append("no rows")
    wrong = [(a, b) for a, b in zip(ours, theirs) if not _same(a, b)]
    if wrong:
        found.append(f"{len(wrong)} rows differ, first {wrong[0]}")
    return found


def _same(a, b):
    return all(
        math.isclose(x, y, abs_tol=1e-9) if isinstance(x, float) and isinstance(y, float) else x == y
        for x, y in zip(a, b)
    )
