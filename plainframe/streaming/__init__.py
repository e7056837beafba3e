"""Sentences over Structured Streaming: an extension, with the same parser, checker and compiler.

Steps that see one row at a time run as they are, as do joins with tables at rest. `summarize` needs
a time column to wait by: rows are grouped by windows of it, and a window is given out once the
watermark has passed it. `drop_duplicates` forgets rows after the watermark. Steps that need all
rows at once, such as sort, take and ordered windows, are refused.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, functions as F

from ..api import checked, find_tables
from ..operators.compiler import _STEPS, Frame, load
from ..plans import nodes as N
from ..plans.checker import has, is_role
from ..plans.diagnostics import PlainError
from ..plans.parser import parse

#: Aggregates whose state stays small.
AGGREGATES = ("total", "average", "smallest", "largest", "standard_deviation", "row_count")
_STATELESS = (N.Keep, N.Pick, N.Add, N.Rename, N.FillMissing, N.DropMissing, N.Lengthen)


def _refuse(step: N.Node, why: str, text: str):
    raise PlainError(f"on a stream, {why}", step.span, text)


def run_stream(text: str, time: str | None = None, watermark: str | None = None, window: str | None = None, **tables: Any) -> DataFrame:
    """A streaming DataFrame. time: the column that rows are dated by; watermark: how long to wait for late rows; window: length of the windows that `summarize` groups by, given out as window_start and window_end."""
    found = find_tables(parse(text).tables(), tables)
    plan = checked(text, found)
    frame = load(found[plan.plan.table])
    if time:
        if not watermark:
            raise PlainError("a time column needs a watermark: how long to wait for late rows, such as \"10 minutes\"")
        frame.df = frame.df.withWatermark(frame.names[time], watermark)
    for step in plan.plan.steps:
        if isinstance(step, N.Join):
            if found[step.table].isStreaming or step.unmatched == "both":
                _refuse(step, "a join needs the other table at rest, and cannot keep that table's unmatched rows", text)
        elif isinstance(step, N.Summarize):
            frame = _summarize(frame, step, time, window, text)
            continue
        elif isinstance(step, N.DropDuplicates):
            if not time:
                _refuse(step, "`drop_duplicates` needs `time` and `watermark`, to know when to forget a row", text)
            frame = Frame(frame.df.dropDuplicatesWithinWatermark(list(frame.names.values())), frame.names)
            continue
        elif not isinstance(step, _STATELESS):
            _refuse(step, "a step that needs all rows at once has no answer", text)
        if isinstance(step, N.Add) and any(has(v.value, "aggregate", "window") for v in step.values):
            _refuse(step, "a value can only look at its own row", text)
        if isinstance(step, N.Keep) and isinstance(step.condition, N.Not) and isinstance(step.condition.of, N.Matching):
            _refuse(step, "`not matching` has no answer while rows may still come", text)
        frame = _STEPS[type(step).__name__](frame, step, lambda n: found[n])
        frame.order = []
    return frame.df.select(*(F.col(c).alias(n) for n, c in frame.names.items()))


def _summarize(frame: Frame, step: N.Summarize, time: str | None, window: str | None, text: str) -> Frame:
    if not (time and window) or time not in frame.names:
        _refuse(step, "`summarize` needs `time`, `watermark` and `window`, and the time column still there", text)
    for v in step.values:
        for x in N.walk(v.value):
            if is_role(x, "aggregate") and x.name not in AGGREGATES:
                _refuse(step, f"`{x.name}` would have to keep every row", text)
    from ..functions.expressions import Env, aggregate, compile
    from ..operators.compiler import fresh

    env = Env(frame.col, lambda c: aggregate(c, lambda x: compile(x, Env(frame.col)), []))
    names = {n: fresh() for n in [*(c.name for c in step.by), *(v.name for v in step.values)]}
    span = F.window(frame.col(time), window)
    keys = [frame.col(c.name).alias(names[c.name]) for c in step.by]
    df = frame.df.groupBy(span.alias("w"), *keys).agg(*(compile(v.value, env).alias(names[v.name]) for v in step.values))
    start, end = fresh(), fresh()
    df = df.select(F.col("w.start").alias(start), F.col("w.end").alias(end), *names.values())
    return Frame(df, {"window_start": start, "window_end": end} | names)
