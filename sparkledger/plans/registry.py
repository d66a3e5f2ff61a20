"""Registration of queries with their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .bind import Bound, with_bindings

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, reads: str = "", sql: str = ""):
    """Register a function of the bound tables. sql: what follows the WITH clause of the bindings that are read; it may add
    further common tables by a leading comma."""

    def add(f: Callable[[Bound], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(Bound(spark, sf_dir))
        if sql:
            head = with_bindings(*reads.split())
            SQL[name] = f"{head}{sql if sql.lstrip().startswith(',') else ' ' + sql}" if head != "WITH " else sql
        return f

    return add
