"""Named queries: each pairs a Spark plan over the given tables with its SQL check."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from knownat.session import prepare

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
CTES: dict[str, tuple[tuple[str, ...], str]] = {}


def cte(name: str, body: str, *needs: str) -> None:
    """A named building block of the SQL checks, with the blocks it reads."""
    CTES[name] = (needs, body)


def with_ctes(needs: str, body: str) -> str:
    """``WITH`` clause holding every block ``needs`` names (comma separated), in order."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        if name in ordered:
            return
        for other in CTES[name][0]:
            visit(other)
        ordered.append(name)

    for name in [n.strip() for n in needs.split(",") if n.strip()]:
        visit(name)
    if not ordered:
        return body
    head = ",\n".join(f"{n} AS ({CTES[n][1]})" for n in ordered)
    recursive = "RECURSIVE "
    body = body.strip()
    if body.upper().startswith("WITH "):
        return f"WITH {recursive}{head},\n{body[5:]}"
    return f"WITH {recursive}{head}\n{body}"


def digest_sql(rows: str, keys: str, place: str, text: str, separator: str = ",") -> str:
    """``keys``, digest and n of ``functions.scale.ordered_digest`` over ``rows``."""
    level = f"SELECT {keys}, {place} AS p, CAST({text} AS VARCHAR) AS d, 1 AS n FROM {rows}"
    for _ in range(2):
        level = f"SELECT {keys}, p >> 16 AS p, sha256(string_agg(d, '{separator}' ORDER BY p, d)) AS d, sum(n) AS n FROM ({level}) GROUP BY {keys}, p >> 16"
    return f"SELECT {keys}, sha256(string_agg(d, '{separator}' ORDER BY p, d)) AS digest, CAST(sum(n) AS BIGINT) AS n FROM ({level}) GROUP BY {keys}"


def query(name: str, needs: str = "", sql: str | None = None):
    """Register a plan ``(spark, sf_dir) -> DataFrame``; ``sql`` is its DuckDB twin."""

    def wrap(plan: Callable[[SparkSession, str], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return plan(prepare(spark), sf_dir)

        run.__name__ = name
        run.__doc__ = plan.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = with_ctes(needs, sql)
        return plan

    return wrap
