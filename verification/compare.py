"""Compare Spark results with the SQL of the same name."""

from __future__ import annotations

import math


def canonical(value) -> str:
    """One text per value, so that equal values of two engines look alike."""
    if value is None or value is not None and value != value:
        return "~"
    if isinstance(value, float):
        return "0" if value == 0 else f"{value:.9g}"
    if hasattr(value, "item"):
        return canonical(value.item())
    if type(value).__name__ in ("Timestamp", "datetime"):
        return str(value)[:19].replace(" 00:00:00", "")
    if isinstance(value, (int, bool)) or math.isfinite(0):
        return str(value)
    return str(value)


def rows_of(frame) -> list[tuple]:
    """Sorted canonical rows, columns in name order."""
    columns = sorted(frame.columns)
    picked = [frame[name].astype(object).where(frame[name].notna(), None).map(canonical) for name in columns]
    return sorted(zip(*picked, strict=True))


def differences(left, right, limit: int = 3) -> list[str]:
    """Why two pandas frames differ; empty when they agree."""
    if sorted(left.columns) != sorted(right.columns):
        return [f"columns {sorted(left.columns)} <> {sorted(right.columns)}"]
    a, b = rows_of(left), rows_of(right)
    if a == b:
        return []
    only_a, only_b = sorted(set(a) - set(b)), sorted(set(b) - set(a))
    notes = [f"rows {len(a)} <> {len(b)}; {len(only_a)} only left, {len(only_b)} only right"]
    return notes + [f"left  {row}" for row in only_a[:limit]] + [f"right {row}" for row in only_b[:limit]]
