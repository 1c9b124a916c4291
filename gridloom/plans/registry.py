"""Names of the driver's queries and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from .bindings import BINDING_SQL, Tables

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None, use: str = ""):
    """Register ``f(tables) -> DataFrame``; ``use`` lists the bindings its oracle needs."""

    def register(build: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = lambda spark, sf_dir: build(Tables(spark, sf_dir))
        if oracle is not None:
            ORACLES[name] = with_bindings(use.split(), oracle)
        return build

    return register


def with_bindings(names: list[str], body: str) -> str:
    if not names:
        return body
    ctes = ",\n".join(f"{name} AS ({BINDING_SQL[name]})" for name in names)
    body = body.strip()
    if body[:5].upper() == "WITH ":
        return f"WITH {ctes},\n{body[5:]}"
    if body[:15].upper() == "WITH RECURSIVE ":
        raise ValueError("put recursive oracles together by hand")
    return f"WITH {ctes}\n{body}"


def r(expression: str, places: int = 6) -> str:
    """SQL twin of ``rounded``: negative zero becomes zero."""
    inner = f"round(({expression})::DOUBLE, {places})"
    return f"(CASE WHEN {inner} = 0 THEN 0::DOUBLE ELSE {inner} END)"
