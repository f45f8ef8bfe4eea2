"""Comparing result rows."""

from __future__ import annotations


def plain(rows: list[tuple]) -> list[tuple]:
    """Rows in an order of their own, numbers to six digits."""

    def value(v):
        if isinstance(v, bool) or v is None or isinstance(v, str):
            return v
        return round(float(v), 6) + 0.0

    return sorted((tuple(map(value, r)) for r in rows), key=repr)
