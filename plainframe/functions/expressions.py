"""Expressions of the grammar as Spark columns: built-in functions only."""

from __future__ import annotations

import functools
import operator
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, Window, functions as F

from ..operators.ordering import Key, one_way, packed
from ..plans import nodes as N
from ..plans.vocabulary import FUNCTIONS


@dataclass
class Env:
    """Where an expression stands: its columns, and what aggregates and windows become there."""

    column: Callable[[str], Column]
    aggregate: Callable[[N.Call], Column] | None = None
    window: Callable[[N.Call], Column] | None = None


_OPS = {
    "+": operator.add, "-": operator.sub, "*": operator.mul, "is": operator.eq, "is not": operator.ne, "<": operator.lt, "<=": operator.le,
    ">": operator.gt, ">=": operator.ge, "and": operator.and_, "or": operator.or_, "starts": Column.startswith, "ends": Column.endswith, "contains": Column.contains,
}


def compile(e: N.Node, env: Env) -> Column:
    sub = lambda x: compile(x, env)
    if isinstance(e, N.Col):
        return env.column(e.name)
    if isinstance(e, N.Lit):
        return F.lit(e.value)
    if isinstance(e, N.Binary):
        if e.op == "/":
            return sub(e.left).cast("double") / sub(e.right).cast("double")
        return _OPS[e.op](sub(e.left), sub(e.right))
    if isinstance(e, N.Not):
        return ~sub(e.of)
    if isinstance(e, N.IsMissing):
        return sub(e.of).isNotNull() if e.negated else sub(e.of).isNull()
    if isinstance(e, N.In):
        found = sub(e.of).isin([x.value for x in e.items])
        return ~found if e.negated else found
    if isinstance(e, N.When):
        out = functools.reduce(lambda c, pair: c.when(sub(pair[0]), sub(pair[1])), e.branches, F)
        return out.otherwise(sub(e.otherwise)) if e.otherwise else out
    if isinstance(e, N.LookUp):
        of = sub(e.of)
        out = functools.reduce(lambda c, pair: c.when(of == F.lit(pair[0].value), F.lit(pair[1].value)), e.pairs, F)
        return out.otherwise(sub(e.otherwise))
    role = FUNCTIONS[e.name].role
    if role == "aggregate":
        return env.aggregate(e)
    if role == "window":
        return env.window(e)
    return _SCALARS[e.name](*map(sub, e.args))


def _remainder(a: Column, b: Column) -> Column:
    """The sign is the divisor's."""
    return ((a % b) + b) % b


_SCALARS: dict[str, Callable[..., Column]] = {
    "first_present": F.coalesce,
    "join_text": F.concat,
    "lower": F.lower,
    "upper": F.upper,
    "to_number": lambda x: x.cast("double"),
    "to_text": lambda x: x.cast("string"),
    "to_date": lambda x: x.cast("date"),
    "round_below": lambda x: F.floor(x).cast("bigint"),
    "round_above": lambda x: F.ceil(x).cast("bigint"),
    "trim": F.trim,
    "replace_text": F.replace,
    "split_text": F.split_part,
    "characters": F.char_length,
    "between": lambda x, low, high: x.between(low, high),
    "remainder": _remainder,
    "year": F.year,
    "month": F.month,
    "day": F.dayofmonth,
    "weekday": lambda x: F.weekday(x) + 1,
    "hour": F.hour,
}


def _median(x: Column) -> Column:
    """The middle of a group's values, sorted; large tables go by operators.medians instead."""
    s = F.array_sort(F.collect_list(x.cast("double")))
    middle = lambda s: (F.get(s, F.floor((F.size(s) - 1) / 2).cast("int")) + F.get(s, F.floor(F.size(s) / 2).cast("int"))) / 2
    return F.element_at(F.transform(F.array(s), middle), 1)


def aggregate(e: N.Call, arg: Callable[[N.Node], Column], order: list[Key], rank: str | None = None, mask: Column | None = None) -> Column:
    """An aggregate over rows, those of mask if given. order: the rows' order, none if empty; rank: a column that counts rows in it."""
    only = (lambda c: c) if mask is None else (lambda c: F.when(mask, c))
    x = only(arg(e.args[0])) if e.args else None
    if e.name == "row_count":
        return F.count(F.lit(1) if mask is None else F.when(mask, 1))
    plain = {"total": F.sum, "average": F.avg, "median": _median, "smallest": F.min, "largest": F.max, "standard_deviation": F.stddev_samp, "unique_count": F.count_distinct}
    if e.name in plain:
        return plain[e.name](x)
    if rank:
        key, down = F.col(rank), False
    elif order and one_way(order):
        key, down = packed(order), order[0].descending
    else:
        key = None
    if e.name in ("first", "last"):
        if key is None:
            held = (F.first if e.name == "first" else F.last)(F.struct(x.alias("x")) if mask is None else F.when(mask, F.struct(x.alias("x"))), ignorenulls=mask is not None)
            return held["x"]
        pick = F.min_by if (e.name == "first") != down else F.max_by
        return pick(x, only(key))
    sep = e.args[1].value
    if key is None:
        return F.when(F.count(x) > 0, F.array_join(F.collect_list(x), sep))
    rows = F.array_sort(F.collect_list(F.when(x.isNotNull(), F.struct(key.alias("key"), x.alias("x")))))
    texts = F.transform(F.reverse(rows) if down else rows, lambda r: r["x"])
    return F.when(F.count(x) > 0, F.array_join(texts, sep))


def reach(e: N.Call) -> int:
    """How many rows back or ahead a window function looks."""
    if e.name in ("previous", "following"):
        return e.args[1].value if len(e.args) == 2 else 1
    return e.args[1].value - 1 if len(e.args) == 2 else 0


def window(e: N.Call, arg: Callable[[N.Node], Column], by: list[Column], order: list[Key]) -> Column:
    """A window function: by partitions, order is the rows' order."""
    over = Window.partitionBy(*by) if by else Window.partitionBy()
    ordered = over.orderBy(*(k.by for k in order)) if order else over
    upto = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    if e.name == "rank":
        c = arg(e.args[0])
        return F.rank().over(over.orderBy(c.desc_nulls_last() if e.descending else c.asc_nulls_last())).cast("bigint")
    if e.name == "row_number":
        return F.row_number().over(ordered).cast("bigint")
    if e.name == "running_total":
        return F.sum(arg(e.args[0])).over(upto)
    if e.name in ("previous", "following"):
        return (F.lag if e.name == "previous" else F.lead)(arg(e.args[0]), reach(e)).over(ordered)
    if e.name == "latest":
        return F.last(arg(e.args[0]), ignorenulls=True).over(upto)
    agg, n = e.args
    x = arg(agg.args[0])
    frame = ordered.rowsBetween(-(n.value - 1), Window.currentRow)
    plain = {"total": F.sum, "average": F.avg, "median": lambda c: F.percentile(c, 0.5), "smallest": F.min, "largest": F.max, "standard_deviation": F.stddev_samp}
    return F.when(F.count(x).over(frame) == n.value, plain[agg.name](x).over(frame))
