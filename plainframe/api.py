"""run: a sentence over tables, as a lazy DataFrame."""

from __future__ import annotations

import inspect
import sys
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from .operators.compiler import compile_plan
from .plans.checker import Checked, check
from .plans.diagnostics import PlainError
from .plans.parser import parse
from .plans.schema import Schema
from .sources.tables import as_dataframe, is_table, spark_of


def find_tables(names: list[str], given: dict[str, Any], scope: dict[str, Any] | None = None, session: SparkSession | None = None) -> dict[str, DataFrame]:
    """The tables by name: given, else of the caller's scope, else of the catalog. Spark frames and local ones are not mixed."""
    found = {}
    for name in names:
        if name in given:
            found[name] = given[name]
        elif scope and is_table(scope.get(name)):
            found[name] = scope[name]
    spark = spark_of(found.values()) or session or SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
    for name in names:
        if name not in found:
            if not spark.catalog.tableExists(".".join(f"`{p}`" for p in name.split("."))):
                raise PlainError(f"there is no table `{name}`: give it by name, `run(text, {name.split('.')[-1]}=...)`")
            found[name] = spark.table(".".join(f"`{p}`" for p in name.split(".")))
    return {name: as_dataframe(t, spark) for name, t in found.items()}


def checked(text: str, tables: dict[str, DataFrame]) -> Checked:
    return check(parse(text), lambda n: Schema.of(tables[n].schema), text)


def run(text: str, _session: SparkSession | None = None, **tables: Any) -> DataFrame:
    """The table that a sentence describes. Nothing runs until its rows are asked for."""
    frame = inspect.currentframe().f_back
    return run_in(text, tables, {**frame.f_globals, **frame.f_locals} if frame else {}, _session)


def run_in(text: str, tables: dict[str, Any], scope: dict[str, Any], session: SparkSession | None = None) -> DataFrame:
    found = find_tables(parse(text).tables(), tables, scope, session)
    plan = checked(text, found)
    for a in plan.assumptions:
        print(a.render(""), file=sys.stderr)
    return compile_plan(plan, lambda n: found[n])
