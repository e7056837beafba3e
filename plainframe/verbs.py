"""Steps and functions as Python builders: table >> keep(col.region == "West") >> take(10).

Builders write the grammar's text, and what they write is read by the one parser, so a refusal has
its caret under the same words whichever way a pipeline was made.
"""

from __future__ import annotations

import inspect
import sys
from typing import Any

from pyspark.sql import DataFrame

from .api import run_in
from .plans.diagnostics import PlainError
from .plans.render import literal
from .plans.vocabulary import FUNCTIONS
from .sources.tables import is_table


class Expr:
    """An expression's text; operators on it make more text. Tables that it names come along."""

    def __init__(self, text: str, brings: dict[str, Any] | None = None, name: str | None = None, down: bool = False):
        self.text, self.brings, self.column, self.down = text, brings or {}, name, down

    def _with(self, form: str, *others: Any) -> Expr:
        brings = dict(self.brings)
        for o in others:
            brings |= o.brings if isinstance(o, Expr) else {}
        return Expr(form, brings)

    def _infix(self, op: str, other: Any, flipped: bool = False) -> Expr:
        a, b = (write(other), self.text) if flipped else (self.text, write(other))
        out = self._with(f"({a} {op} {b})", other)
        out.pair = (self, other) if op == "is" else None
        return out

    def __eq__(self, other):  # type: ignore[override]
        if other is None:
            raise PlainError("nothing equals None: write .is_missing()")
        return self._infix("is", other)

    def __ne__(self, other):  # type: ignore[override]
        return self._infix("is not", other)

    __hash__ = None  # type: ignore[assignment]
    __lt__ = lambda self, o: self._infix("<", o)
    __le__ = lambda self, o: self._infix("<=", o)
    __gt__ = lambda self, o: self._infix(">", o)
    __ge__ = lambda self, o: self._infix(">=", o)
    __add__ = lambda self, o: self._infix("+", o)
    __sub__ = lambda self, o: self._infix("-", o)
    __mul__ = lambda self, o: self._infix("*", o)
    __truediv__ = lambda self, o: self._infix("/", o)
    __radd__ = lambda self, o: self._infix("+", o, True)
    __rsub__ = lambda self, o: self._infix("-", o, True)
    __rmul__ = lambda self, o: self._infix("*", o, True)
    __rtruediv__ = lambda self, o: self._infix("/", o, True)
    __and__ = lambda self, o: self._infix("and", o)
    __or__ = lambda self, o: self._infix("or", o)

    def __invert__(self) -> Expr:
        return self._with(f"not {self.text}" if self.text.startswith("matching(") else f"(not {self.text})")

    def __neg__(self) -> Expr:
        return self._with(f"(0 - {self.text})")

    def __mod__(self, other) -> Expr:
        raise PlainError("write remainder(a, b)")

    def __bool__(self) -> bool:
        raise PlainError("an expression is neither true nor false before it meets rows: write & for and, | for or, ~ for not, each side in parentheses")

    def starts(self, x: Any) -> Expr:
        return self._infix("starts", x)

    def ends(self, x: Any) -> Expr:
        return self._infix("ends", x)

    def contains(self, x: Any) -> Expr:
        return self._infix("contains", x)

    def is_in(self, values) -> Expr:
        kinds = sorted(set(values), key=lambda v: (str(type(v)), v))
        return self._with(f"({self.text} in {{{', '.join(map(write, kinds))}}})")

    def is_missing(self) -> Expr:
        return self._with(f"({self.text} is missing)")

    def __repr__(self) -> str:
        return self.text


def write(x: Any) -> str:
    """A value as the grammar writes it."""
    if isinstance(x, Expr):
        return x.text
    if hasattr(x, "item") and not isinstance(x, (str, int, float)):
        x = x.item()
    if isinstance(x, str) and '"' in x:
        raise PlainError('a text cannot hold a double quote: the grammar has no way to write one')
    if x is None or isinstance(x, (str, bool, int, float)):
        return f"(0 - {literal(-x)})" if isinstance(x, (int, float)) and not isinstance(x, bool) and x < 0 else literal(x)
    raise PlainError(f"{x!r} is not a value of the grammar")


class _Columns:
    """col.region or col["order date"]."""

    def __getattr__(self, name: str) -> Expr:
        if name.startswith("__"):
            raise AttributeError(name)
        return self[name]

    def __getitem__(self, name: str) -> Expr:
        if not name or any(c in name for c in "[],"):
            raise PlainError(f"{name!r} cannot be written as a column: names hold no brackets or commas")
        return Expr(f"[{name}]", name=name)


col = _Columns()
name, kind, value = Expr("name"), Expr("kind"), Expr("value")


class Pipeline:
    """A table and steps so far: lazy, never changed."""

    def __init__(self, table: str, tables: dict[str, Any], steps: tuple[str, ...] = ()):
        self.table, self.tables, self.steps = table, tables, steps

    def __rshift__(self, step: Step) -> Pipeline:
        if not isinstance(step, Step):
            raise PlainError("a pipeline goes on with a step, such as `>> take(10)`")
        tables = dict(self.tables)
        for n, t in step.brings.items():
            if n in tables and tables[n] is not t:
                raise PlainError(f"two different tables are both called `{n}`: give one another name")
            tables[n] = t
        return Pipeline(self.table, tables, (*self.steps, step.text))

    def written(self) -> str:
        return "\n".join([self.table, *(f"  then {s}" for s in self.steps)])

    def dataframe(self, session=None) -> DataFrame:
        return run_in(self.written(), self.tables, {}, session)

    def __repr__(self) -> str:
        rows = self.dataframe().limit(20)
        return rows._show_string(20, 20, False) if hasattr(rows, "_show_string") else str(rows)

    def _repr_html_(self) -> str:
        return self.dataframe().limit(20).toPandas().to_html(index=False)


class Step:
    def __init__(self, text: str, *parts: Any):
        self.text, self.brings = text, {}
        for p in parts:
            self.brings |= p.brings if isinstance(p, Expr) else p if isinstance(p, dict) else {}

    def __rrshift__(self, table: Any) -> Pipeline:
        if not is_table(table):
            raise PlainError("a pipeline opens on a table")
        found = _name_of(table)
        return Pipeline(found, {found: table}) >> self


def _name_of(table: Any) -> str:
    """The name the caller knows a table by."""
    frame = inspect.currentframe()
    while frame and frame.f_globals.get("__name__") == __name__:
        frame = frame.f_back
    while frame:
        for scope in (frame.f_locals, frame.f_globals):
            for n, x in scope.items():
                if x is table and n.isidentifier() and not n.startswith("_"):
                    return n
        frame = frame.f_back
    return "table"


def _names(cols: tuple) -> str:
    out = []
    for c in cols:
        if isinstance(c, str):
            c = col[c]
        if not isinstance(c, Expr) or c.column is None:
            raise PlainError(f"a column is needed here, not {c!r}")
        out.append(c.column)
    return f"[{', '.join(out)}]"


def _by(by: Any) -> str:
    return "" if by is None else f" by {_names(tuple(by) if isinstance(by, (list, tuple)) else (by,))}"


class Chosen:
    """Columns by a condition, or all but some; with what is done to each."""

    def __init__(self, text: str, done: Expr | None = None):
        self.text, self.done = text, done


def where(condition: Expr, done: Expr | None = None) -> Chosen:
    return Chosen(f"where {write(condition)}", done)


def all_but(*columns) -> Chosen:
    return Chosen(f"all_but {_names(columns)}")


def where_any(condition: Expr, test: Expr) -> Expr:
    return Expr(f"any {write(condition)} as {write(test)}")


def where_every(condition: Expr, test: Expr) -> Expr:
    return Expr(f"every {write(condition)} as {write(test)}")


def descending(column: Expr) -> Expr:
    return Expr(column.text, name=column.column, down=True)


def _choice(names: tuple) -> str:
    return names[0].text if len(names) == 1 and isinstance(names[0], Chosen) else _names(names)


def keep(condition: Expr) -> Step:
    if not isinstance(condition, Expr):
        raise PlainError('`keep` takes a condition, such as col.region == "West"')
    return Step(f"keep where {condition.text}", condition)


def pick(*names) -> Step:
    return Step(f"pick {_choice(names)}")


def _computed(step: str, across: tuple, by: Any, values: dict) -> Step:
    if across:
        if len(across) > 1 or values or across[0].done is None:
            raise PlainError(f"`{step}` takes named values, or one `where(condition, value)`")
        return Step(f"{step} {across[0].text} as {write(across[0].done)}{_by(by)}")
    if not values:
        raise PlainError(f"`{step}` needs a value: {step}(margin=col.revenue - col.cost)")
    return Step(f"{step} {', '.join(f'{col[n].text} as {write(v)}' for n, v in values.items())}{_by(by)}", *values.values())


def add(*across, by=None, **values) -> Step:
    return _computed("add", across, by, values)


def summarize(*across, by=None, **values) -> Step:
    return _computed("summarize", across, by, values)


def sort(*keys, missing: str = "last") -> Step:
    if missing not in ("first", "last"):
        raise PlainError('missing values stand "first" or "last"')
    parts = [f"{_names((k,))}{' descending' if isinstance(k, Expr) and k.down else ''}" for k in keys]
    return Step(f"sort {', '.join(parts)}{' missing first' if missing == 'first' else ''}")


def take(n: int, *, by=None, ties: bool = False) -> Step:
    return Step(f"take {n}{_by(by)}{' with ties' if ties else ''}")


def take_last(n: int, *, by=None, ties: bool = False) -> Step:
    return Step(f"take_last {n}{_by(by)}{' with ties' if ties else ''}")


def _keys(by: Any) -> str:
    if by is None:
        return ""
    parts = []
    for k in by if isinstance(by, (list, tuple)) else [by]:
        pair = getattr(k, "pair", None)
        parts.append(f"{_names((pair[0],))} is {_names((pair[1],))}" if pair else _names((k,)))
    return ", ".join(parts)


def _other(other: Any) -> tuple[str, dict]:
    if isinstance(other, str):
        return other, {}
    if not is_table(other):
        raise PlainError("another table is needed here")
    n = _name_of(other)
    return n, {n: other}


def join(other, *, by=None, unmatched: str = "this") -> Step:
    n, brings = _other(other)
    keys = _keys(by)
    more = f' unmatched "{unmatched}"' if unmatched != "this" else ""
    return Step(f"join {n}{' by ' + keys if keys else ''}{more}", brings)


def matching(other, *, by=None) -> Expr:
    n, brings = _other(other)
    keys = _keys(by)
    return Expr(f"matching({n}{', by ' + keys if keys else ''})", brings)


def add_rows(other) -> Step:
    n, brings = _other(other)
    return Step(f"add_rows {n}", brings)


def add_combinations(*names, by=None) -> Step:
    return Step(f"add_combinations {_names(names)}{_by(by)}")


def drop_duplicates() -> Step:
    return Step("drop_duplicates")


def rename(**pairs) -> Step:
    return Step(f"rename {', '.join(f'{col[n].text} as {write(c if isinstance(c, Expr) else col[c])}' for n, c in pairs.items())}")


def drop_missing(*names) -> Step:
    return Step(f"drop_missing {_names(names)}" if names else "drop_missing")


def fill_missing(**values) -> Step:
    return Step(f"fill_missing {', '.join(f'{col[n].text} as {write(v)}' for n, v in values.items())}")


def _pattern(p: Any) -> str:
    return p.text if isinstance(p, Expr) else f'"{p}"' if "{" in p else f"[{p}]"


def lengthen(*names, name=None, value=None) -> Step:
    parts = ([f"name {_pattern(name)}"] if name is not None else []) + ([f"value {_names((value,))}"] if value is not None else [])
    return Step(f"lengthen {_choice(names)}{' as ' + ', '.join(parts) if parts else ''}")


def widen(name=None, value=None, by=None, missing=None, giving=None) -> Step:
    parts = ([f"name {_pattern(name)}"] if name is not None else []) + ([f"value {write(col[value] if isinstance(value, str) else value)}"] if value is not None else [])
    more = _by(by) + (f" missing {write(missing)}" if missing is not None else "") + (f" giving {_names(tuple(giving))}" if giving else "")
    return Step(f"widen{' ' + ', '.join(parts) if parts else ''}{more}")


def when(*pairs, otherwise: Any = ...) -> Expr:
    parts = [write(p) for p in pairs] + ([f"otherwise {write(otherwise)}"] if otherwise is not ... else [])
    return Expr(f"when({', '.join(parts)})")


def look_up(of, *pairs, otherwise: Any = ...) -> Expr:
    parts = [write(of), *map(write, pairs)] + ([f"otherwise {write(otherwise)}"] if otherwise is not ... else [])
    return Expr(f"look_up({', '.join(parts)})")


def rank(column: Expr) -> Expr:
    return Expr(f"rank({column.text}{' descending' if column.down else ''})")


def _function(fn: str):
    def build(*args) -> Expr:
        return Expr(f"{fn}({', '.join(map(write, args))})")

    build.__name__, build.__doc__ = fn, f"The grammar's `{fn}`."
    return build


for _fn in FUNCTIONS:
    if _fn != "rank":
        globals()[_fn] = _function(_fn)


def collect(pipeline: Pipeline, session=None) -> DataFrame:
    """The pipeline's rows, as a lazy DataFrame."""
    if not isinstance(pipeline, Pipeline):
        raise PlainError("`collect` takes a pipeline")
    return pipeline.dataframe(session)


__all__ = [
    "Expr", "Pipeline", "add", "add_combinations", "add_rows", "all_but", "col", "collect", "descending", "drop_duplicates", "drop_missing", "fill_missing",
    "join", "keep", "kind", "lengthen", "look_up", "matching", "name", "pick", "rename", "sort", "summarize", "take", "take_last", "value", "when",
    "where", "where_any", "where_every", "widen", *FUNCTIONS,
]
del sys
