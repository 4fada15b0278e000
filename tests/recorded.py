"""Recorded pages of a made-up service."""

from __future__ import annotations

ROWS = [{"recommendationid": str(n), "timestamp_created": n * 3600, "review": f"text {n}"} for n in range(200)]


def fetch(window, cursor):
    rows = [r for r in ROWS if window[0] <= r["timestamp_created"] <= window[1]]
    at = 0 if cursor == "*" else int(cursor)
    page = rows[at : at + 30]
    return page, (str(at + 30) if page else None)


def count(start, end):
    return sum(start <= r["timestamp_created"] <= end for r in ROWS)
