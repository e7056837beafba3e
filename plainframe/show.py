"""What a pipeline says and does, without running it."""

from __future__ import annotations

import functools
import inspect
from collections.abc import Mapping
from typing import Any

from .api import checked, find_tables
from .plans import dplyr_code, ladder, pandas_code, picture, polars_code, pyspark_code, sql
from .plans.checker import Checked, check
from .plans.diagnostics import PlainError, hint
from .plans.parser import parse
from .plans.render import text as canonical
from .plans.schema import DATE, NUMBER, TEXT, TIMESTAMP, TRUTH, UNKNOWN, Schema
from .verbs import Pipeline

PRINTERS = {"pyspark": pyspark_code.code, "pandas": pandas_code.code, "polars": polars_code.code, "dplyr": dplyr_code.code}
TARGETS = ("text", *sql.DIALECTS, *PRINTERS)
# Spellings of kinds that a schema may be described with.
SPELLINGS = {
    **dict.fromkeys(("number", "numeric", "double", "integer", "int", "float", "bigint", "decimal"), NUMBER),
    **dict.fromkeys(("text", "string", "character", "varchar"), TEXT),
    **dict.fromkeys(("truth", "boolean", "bool", "logical"), TRUTH),
    "date": DATE,
    **dict.fromkeys(("timestamp", "datetime", "posixct"), TIMESTAMP),
}


def write_as(plan: Checked, target: str) -> str:
    if target == "text":
        return canonical(plan.plan)
    if target in sql.DIALECTS:
        return sql.sql(plan, target)
    if target in PRINTERS:
        return PRINTERS[target](plan)
    raise PlainError(f"there is no target `{target}`.{hint(target, TARGETS)} Targets are {', '.join(TARGETS)}")


def _plan(pipeline: Pipeline | str, tables: dict[str, Any], scope: dict[str, Any]) -> tuple[str, dict]:
    text = pipeline.written() if isinstance(pipeline, Pipeline) else pipeline
    given = {**(pipeline.tables if isinstance(pipeline, Pipeline) else {}), **tables}
    return text, find_tables(parse(text).tables(), given, scope)


def _scope() -> dict[str, Any]:
    frame = inspect.currentframe().f_back.f_back
    return {**frame.f_globals, **frame.f_locals}


def show_as(pipeline: Pipeline | str, target: str, **tables: Any) -> str:
    """The pipeline in another spelling: text, sql (DuckDB), spark (Spark SQL), pyspark, pandas, polars or dplyr."""
    if target not in TARGETS:
        write_as(None, target)
    text, found = _plan(pipeline, tables, _scope())
    return write_as(checked(text, found), target)


class Steps(str):
    """A drawing: a string that a prompt shows as lines and a notebook as a picture; text and svg give either."""

    rows: list[ladder.Row]

    @property
    def text(self) -> str:
        return str(self)

    @functools.cached_property
    def svg(self) -> str:
        return picture.svg(self.rows)

    def __repr__(self) -> str:
        return str(self)

    def _repr_html_(self) -> str:
        return self.svg


def show_steps(pipeline: Pipeline | str, **tables: Any) -> Steps:
    """The table between steps; a refused pipeline as far as it was understood, then the refusal. Nothing runs."""
    text, found = _plan(pipeline, tables, _scope())
    rows = ladder.reading(parse(text), lambda n: Schema.of(found[n].schema), text)
    out = Steps(ladder.draw(rows))
    out.rows = rows
    return out


def described(columns: Mapping[str, str] | str) -> Schema:
    """A schema from {"region": "text"} or "region:text,revenue:number"."""
    pairs = columns.items() if isinstance(columns, Mapping) else [x.rpartition(":")[::2] for x in columns.split(",") if x.strip()]
    return Schema(tuple((n.strip(), SPELLINGS.get(k.strip().lower(), UNKNOWN)) for n, k in pairs))


def explain_sql(text: str, columns: Mapping[str, Any] | str, target: str = "sql") -> str:
    """The SQL of a sentence over described tables: one table's columns, or {table: columns}."""
    plan = parse(text)
    many = isinstance(columns, Mapping) and any(not isinstance(v, str) for v in columns.values())
    schemas = {t: described(c) for t, c in columns.items()} if many else {plan.table: described(columns)}
    return write_as(check(plan, lambda n: lookup(schemas, n), text), target)


def lookup(schemas: dict[str, Schema], name: str) -> Schema:
    if name not in schemas:
        raise PlainError(f"the columns of `{name}` were not described")
    return schemas[name]
