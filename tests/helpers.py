from __future__ import annotations

from datetime import datetime, timedelta

T0 = datetime(2026, 3, 1, 12, 0, 0)


def at(minutes: float) -> datetime:
    return T0 + timedelta(minutes=minutes)


def rows(df, *cols):
    """Rows as a sorted list of tuples; single columns as plain values."""
    picked = df.select(*cols) if cols else df
    out = [tuple(r) for r in picked.collect()]
    if len(picked.columns) == 1:
        out = [r[0] for r in out]
    return sorted(out, key=lambda v: str(v))


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()
