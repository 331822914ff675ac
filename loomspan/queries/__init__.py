"""Queries over the driver's tables, each with its SQL twin where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function (spark, sf_dir) under its own name, with its SQL."""

    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


EDGES = "[10, 25, 50, 100, 250, 500, 1000, 2500, 5000, 10000, 30000, 60000, 180000, 600000, 1800000]"
MIDDLES = "[5, 16, 35, 71, 158, 354, 707, 1581, 3536, 7071, 17321, 42426, 103923, 328634, 1039230]"
LABELS = "['<10ms', '≥10ms', '≥25ms', '≥50ms', '≥100ms', '≥250ms', '≥500ms', '≥1s', '≥2.5s', '≥5s', '≥10s', '≥30s', '≥1m', '≥3m', '≥10m', '≥30m']"


def bucket_sql(x: str) -> str:
    return f"len(list_filter({EDGES}, lambda e: e <= {x}))"


def quantile_sql(source: str, by: str, q: float) -> str:
    """Histogram quantile per group of rows with ``ms``, as a subquery with columns ``by, v``."""
    keys = f"{by}, " if by else ""
    part = f"PARTITION BY {by}" if by else ""
    return f"""(
      SELECT {keys}min(CASE WHEN acc >= {q} * tot THEN CASE WHEN b >= 15 THEN top ELSE least(top, {MIDDLES}[b + 1]) END END) AS v FROM (
        SELECT {keys}b, sum(n) OVER ({part} ORDER BY b) AS acc, sum(n) OVER ({part}) AS tot, max(top) OVER ({part}) AS top FROM (
          SELECT {keys}{bucket_sql('ms')} AS b, count(*) AS n, max(ms) AS top FROM {source} WHERE ms IS NOT NULL GROUP BY ALL))
      {f'GROUP BY {by}' if by else ''})"""
