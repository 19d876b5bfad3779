"""Registry of runnable queries, the views they read and their SQL oracles."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from citeloom.session import cut_lineage, spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
VIEWS: dict[str, tuple[str, str]] = {}

BASE_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

# Tables whose rows carry whole texts or vectors.
HEAVY_ROWS = ("documents", "pages", "embeddings", "benchmark")

# Derived tables that queries read several times: computed once per query, in shared storage.
WRITTEN_ONCE = ("profiles", "cites")


def view(name: str, sql: str, duck: str | None = None) -> None:
    """Register a derived table; ``duck`` overrides the text where dialects differ."""
    VIEWS[name] = (sql, duck or sql)


def _mentioned(sql: str) -> list[str]:
    words = set(re.findall(r"[A-Za-z_][A-Za-z_0-9]*", sql))
    return [name for name in VIEWS if name in words]


class Tables:
    """Lazy access to the base tables and the derived views of one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark = spark
        self.sf_dir = sf_dir
        self._written: dict[str, DataFrame] = {}
        # The tables hold zone-free UTC times.
        spark.conf.set("spark.sql.session.timeZone", "UTC")

    def __call__(self, name: str) -> DataFrame:
        if name in BASE_TABLES:
            scan = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
            return spread(scan) if name in HEAVY_ROWS else scan
        if name in WRITTEN_ONCE:
            if name not in self._written:
                self._written[name] = cut_lineage(self._derived(name))
            return self._written[name]
        return self._derived(name)

    def _derived(self, name: str) -> DataFrame:
        sql = VIEWS[name][0]
        inputs: dict[str, DataFrame] = {}
        words = set(re.findall(r"[A-Za-z_][A-Za-z_0-9]*", sql))
        for dep in (*BASE_TABLES, *VIEWS):
            if dep in words and dep != name and re.search(rf"(?i)(from|join)\s+{dep}\b", sql):
                inputs[dep] = self(dep)
        text = sql.replace("{", "{{").replace("}", "}}")
        for dep in inputs:
            text = re.sub(rf"(?i)\b(from|join)\s+{dep}\b", rf"\1 {{{dep}}}", text)
        return self.spark.sql(text, **inputs)


def query(name: str, oracle: str | None = None):
    """Register ``fn(tables) -> DataFrame`` under ``name`` with its DuckDB oracle."""

    def register(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if oracle is not None:
            ORACLES[name] = expand_oracle(oracle)
        return fn

    return register


def expand_oracle(sql: str) -> str:
    """Prefix the view definitions an oracle mentions as common table expressions."""
    order: list[str] = []

    def visit(text: str, own: str | None = None) -> None:
        for dep in _mentioned(text):
            if dep != own and re.search(rf"(?i)(from|join)\s+{dep}\b", text):
                visit(VIEWS[dep][1], dep)
                if dep not in order:
                    order.append(dep)

    body = sql.strip()
    visit(body)
    ctes = ", ".join(f"{name} AS ({VIEWS[name][1]})" for name in order)
    head = re.match(r"(?i)with(\s+recursive)?\s+", body)
    recursive = "RECURSIVE " if head and head.group(1) else ""
    if head:
        body = body[head.end():]
        return f"WITH {recursive}{ctes + ', ' if ctes else ''}{body}"
    return f"WITH {ctes} {body}" if ctes else body
