"""Registry of named queries and the SQL each is compared with."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from skylattice.plans.views import VIEW_SQL

Build = Callable[[SparkSession, str], DataFrame]

# A bare decimal literal is DECIMAL in the comparison engine; the exponent makes it DOUBLE.
_DECIMAL = re.compile(r"(?<![\w.'])(\d+\.\d+)(?![\w.])")


@dataclass(frozen=True)
class Registered:
    name: str
    build: Build
    oracle: str | None


REGISTRY: dict[str, Registered] = {}


def _order(views: tuple[str, ...]) -> list[str]:
    """Requested views with the ones they build on first."""
    out: list[str] = []

    def visit(name: str) -> None:
        for dep in VIEW_SQL[name][0]:
            visit(dep)
        if name not in out:
            out.append(name)

    for v in views:
        visit(v)
    return out


def compose(body: str, views: tuple[str, ...]) -> str:
    """Prefix ``body`` with the CTEs of ``views``; ``body`` may open with its own WITH."""
    body = body.strip()
    ctes = [f"{v} AS ({VIEW_SQL[v][1].strip()})" for v in _order(views)]
    recursive = bool(re.match(r"(?i)with\s+recursive\b", body))
    if re.match(r"(?i)with\b", body):
        rest = re.sub(r"(?i)^with(\s+recursive)?\s+", "", body)
        text = ", ".join(ctes + [rest]) if ctes else rest
        head = "WITH RECURSIVE " if recursive else "WITH "
        text = head + text
    else:
        text = ("WITH " + ", ".join(ctes) + " " + body) if ctes else body
    return _DECIMAL.sub(r"\1e0", text)


def query(name: str, *views: str, oracle: str | None = None) -> Callable[[Build], Build]:
    """Register the decorated plan under ``name``."""

    def register(fn: Build) -> Build:
        if name in REGISTRY:
            raise ValueError(f"query {name!r} is registered twice")
        sql = compose(oracle, views) if oracle is not None else None
        REGISTRY[name] = Registered(name, fn, sql)
        return fn

    return register
