"""Compare a query's rows with those of its SQL."""

from __future__ import annotations

import datetime
import decimal
import math
from collections import Counter


def plain(x):
    """A value in a form both engines share."""
    if x is None:
        return None
    if isinstance(x, float) and math.isnan(x):
        return "NaN"
    if isinstance(x, bool) or type(x).__name__ == "bool_":
        return bool(x)
    if isinstance(x, decimal.Decimal | float):
        return round(float(x), 9)
    if isinstance(x, datetime.datetime):
        return x.isoformat()
    if isinstance(x, list | tuple) or type(x).__name__ == "ndarray":
        return tuple(plain(y) for y in x)
    if isinstance(x, bytes | bytearray):
        return bytes(x).hex()
    return x


def bag(rows: list, columns: list[str]) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(plain(r[i]) for i in order) for r in rows)


def difference(spark_rows: list, spark_columns: list[str], sql_rows: list, sql_columns: list[str], show: int = 5) -> str:
    """Empty if both hold the same rows under the same column names; else what differs."""
    if sorted(spark_columns) != sorted(sql_columns):
        return f"columns {sorted(set(spark_columns) ^ set(sql_columns))}"
    a, b = bag(spark_rows, spark_columns), bag(sql_rows, sql_columns)
    if a == b:
        return ""
    return f"{sum(a.values())} rows against {sum(b.values())}; only here {list((a - b).items())[:show]}; only there {list((b - a).items())[:show]}"
