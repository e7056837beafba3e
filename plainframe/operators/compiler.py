"""A checked plan as one lazy DataFrame.

Columns live under internal names of their own (c0, c1, ...), never reused, so names that differ only
by case, hold dots or are replaced by a step cannot be confused, and an order keeps its keys after
the columns it was set by are dropped or replaced. A sort only sets the order; rows are ordered
where a step or the end of the plan needs it.
"""

from __future__ import annotations

import functools
import itertools
import operator
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..functions.expressions import Env, aggregate, compile, reach, window
from ..plans import nodes as N
from ..plans.checker import Checked, aggregates, children, is_role
from .global_windows import large, spread, worth_it
from .medians import medians
from .ordering import Key, one_way

_counter = itertools.count()
#: Labels that an open `widen` makes columns of at most.
MOST_LABELS = 10_000


def fresh() -> str:
    return f"c{next(_counter)}"


@dataclass
class Frame:
    df: DataFrame
    names: dict[str, str]  # public to internal, in order
    order: list[Key] = field(default_factory=list)
    stable: bool = True  # False after rows were taken without an order: read such a frame once only
    sorted: bool = False  # True while rows come in the order already

    def col(self, name: str) -> Column:
        return F.col(self.names[name])

    @property
    def kept(self) -> list[str]:
        """Internal columns to carry on: the public ones and those of the order."""
        return list(dict.fromkeys([*self.names.values(), *(k.column for k in self.order)]))

    def select(self, made: dict[str, Column], names: dict[str, str]) -> Frame:
        """One projection: columns made now, all values seeing only this frame."""
        out = replace(self, names=names)
        return replace(out, df=self.df.select(*(made[c].alias(c) if c in made else F.col(c) for c in out.kept)))


def load(df: DataFrame) -> Frame:
    names = {n: fresh() for n in df.columns}
    return Frame(df.toDF(*names.values()), names)


def compile_plan(checked: Checked, table: Callable[[str], DataFrame]) -> DataFrame:
    frame = load(table(checked.plan.table))
    for step in checked.plan.steps:
        was = frame.sorted
        frame = _STEPS[type(step).__name__](frame, step, table)
        top = isinstance(step, N.Take) and not (step.last or step.by or step.ties)
        frame = replace(frame, sorted=top and bool(frame.order) or was and isinstance(step, (N.Pick, N.Rename)))
    df = frame.df.orderBy(*(k.by for k in frame.order)) if frame.order and not frame.sorted else frame.df
    return df.select(*(F.col(c).alias(n) for n, c in frame.names.items()))


def settled(frame: Frame, names: list[str]) -> list[Key]:
    """An order by columns, missing last; columns that have no order are left out."""
    kinds = {f.name: f.dataType for f in frame.df.schema.fields}
    return [Key(frame.names[n]) for n in names if not isinstance(kinds[frame.names[n]], (T.MapType, T.VariantType))]


def _keep(frame: Frame, s: N.Keep, table) -> Frame:
    c, how = s.condition, "left_semi"
    if isinstance(c, N.Not) and isinstance(c.of, N.Matching):
        c, how = c.of, "left_anti"
    if isinstance(c, N.Matching):
        other = load(table(c.table))
        on = [frame.col(k.mine) == other.col(k.theirs) for k in c.keys]
        return replace(frame, df=frame.df.join(other.df, functools.reduce(operator.and_, on), how))
    return replace(frame, df=frame.df.filter(compile(c, Env(frame.col))))


def _pick(frame: Frame, s: N.Pick, table) -> Frame:
    return frame.select({}, {c.name: frame.names[c.name] for c in s.choice.names})


def _ranked(frame: Frame, by: list[str]) -> tuple[Frame, str]:
    """A column that counts a group's rows in order: for orders that go two ways at once."""
    rank = fresh()
    over = Window.partitionBy(*by).orderBy(*(k.by for k in frame.order))
    return replace(frame, df=frame.df.withColumn(rank, F.row_number().over(over))), rank


def _needs_rank(frame: Frame, values) -> bool:
    calls = (x for v in values for x in N.walk(v) if isinstance(x, N.Call))
    return bool(frame.order) and not one_way(frame.order) and any(c.name in ("first", "last", "join_rows") for c in calls)


def _aggregates(e: N.Node) -> list[N.Call]:
    """The aggregates of an expression but those that a window takes."""
    if is_role(e, "aggregate"):
        return [e]
    return [] if is_role(e, "window") else [c for x in children(e) for c in _aggregates(x)]


def _add(frame: Frame, s: N.Add, table) -> Frame:
    by = [frame.names[c.name] for c in s.by]
    values = [v.value for v in s.values]
    calls = list(dict.fromkeys(c for v in values for c in _aggregates(v)))
    held: dict[N.Call, Column] = {}
    if calls:
        rank = None
        source = frame
        if _needs_rank(frame, calls):
            source, rank = _ranked(frame, by)
        made = {c: aggregate(c, lambda x: compile(x, Env(frame.col)), frame.order, rank) for c in calls}
        names = {c: fresh() for c in calls}
        if frame.stable:
            # Groups are summed on the map side and joined back: a table of groups moves, not the rows.
            keys = {b: fresh() for b in by}
            groups = source.df.groupBy(*(F.col(b).alias(keys[b]) for b in by)).agg(*(made[c].alias(names[c]) for c in calls)) if by else source.df.agg(*(made[c].alias(names[c]) for c in calls))
            on = [F.col(b).eqNullSafe(F.col(keys[b])) for b in by]
            df = frame.df.join(groups, functools.reduce(operator.and_, on), "left") if by else frame.df.crossJoin(F.broadcast(groups))  # one row
        else:
            over = Window.partitionBy(*by) if by else Window.partitionBy()
            made |= {c: F.median(compile(c.args[0], Env(frame.col))) for c in calls if c.name == "median"}
            df = source.df.withColumns({names[c]: made[c].over(over) for c in calls if c.name != "unique_count"})
            for c in calls:
                if c.name == "unique_count":
                    df = df.withColumn(names[c], F.size(F.collect_set(compile(c.args[0], Env(frame.col))).over(over)).cast("long"))
        frame = replace(frame, df=df)
        held = {c: F.col(names[c]) for c in calls}
    arg = lambda x: compile(x, Env(frame.col))
    for c in dict.fromkeys(x for v in values for x in N.walk(v) if is_role(x, "window")):
        keys = [Key(frame.names[c.args[0].name], c.descending)] if c.name == "rank" else frame.order
        if not by and frame.stable and worth_it(frame.df, keys):
            name = fresh()
            over = lambda parts, order, c=c, arg=arg: window(c, arg, parts, order)
            frame = replace(frame, df=spread(frame.df, c.name, arg(c.args[0]) if c.name in ("running_total", "latest") else None, keys, name, reach(c), over))
            held[c] = F.col(name)
    env = Env(frame.col, lambda c: held[c], lambda c: held[c] if c in held else window(c, arg, [F.col(b) for b in by], frame.order))
    new = {v.name: fresh() for v in s.values}
    made = {new[v.name]: compile(v.value, env) for v in s.values}
    return frame.select(made, {n: new.get(n, c) for n, c in frame.names.items()} | {n: c for n, c in new.items() if n not in frame.names})


def _summarize(frame: Frame, s: N.Summarize, table) -> Frame:
    by = [c.name for c in s.by]
    rank = None
    if _needs_rank(frame, [v.value for v in s.values]):
        frame, rank = _ranked(frame, [frame.names[n] for n in by])
    arg = lambda x: compile(x, Env(frame.col))
    env = Env(frame.col, lambda c: aggregate(c, arg, frame.order, rank))
    names = {n: fresh() for n in [*by, *(v.name for v in s.values)]}
    keys = [frame.col(n).alias(names[n]) for n in by]
    calls = list(dict.fromkeys(c for v in s.values for c in _aggregates(v.value)))
    if frame.stable and any(c.name == "median" for c in calls) and large(frame.df):
        held = {c: fresh() for c in calls}
        own = [aggregate(c, arg, frame.order, rank).alias(held[c]) for c in calls if c.name != "median"]
        df = frame.df.groupBy(*keys).agg(*own, F.count(F.lit(1)).alias(fresh()))
        for c in calls:
            if c.name == "median":
                middle = medians(frame.df, [frame.names[n] for n in by], arg(c.args[0]), held[c])
                same = functools.reduce(operator.and_, [F.col(names[n]).eqNullSafe(F.col(f"{held[c]}_{i}")) for i, n in enumerate(by)], F.lit(True))
                df = df.join(middle if by else F.broadcast(middle), same, "left")
        env = Env(lambda n: F.col(names[n]), lambda c: F.col(held[c]))
        df = df.select(*(names[n] for n in by), *(compile(v.value, env).alias(names[v.name]) for v in s.values))
    else:
        values = [compile(v.value, env).alias(names[v.name]) for v in s.values]
        df = frame.df.groupBy(*keys).agg(*values) if by else frame.df.agg(*values)
    out = Frame(df, names, stable=frame.stable)
    return replace(out, order=settled(out, by))


def _sort(frame: Frame, s: N.Sort, table) -> Frame:
    keys = [Key(frame.names[k.name], k.descending, s.missing_first) for k in s.keys]
    out = replace(frame, order=keys)
    return replace(out, df=frame.df.select(*out.kept))


def _take(frame: Frame, s: N.Take, table) -> Frame:
    order = [k.flipped() for k in frame.order] if s.last else frame.order
    if s.by:
        place = fresh()
        over = Window.partitionBy(*(frame.col(c.name) for c in s.by)).orderBy(*(k.by for k in order))
        df = frame.df.withColumn(place, (F.rank() if s.ties else F.row_number()).over(over)).filter(F.col(place) <= s.n)
        return replace(frame, df=df.select(*frame.kept))
    if s.ties and s.n:
        # The nth row's keys are the cut; one row, so every task can have it.
        names = [fresh() for _ in order]
        top = frame.df.select(*(k.column for k in order)).orderBy(*(k.by for k in order)).limit(s.n)
        cut = top.orderBy(*(k.flipped().by for k in order)).limit(1).select(*(F.col(k.column).alias(n) for k, n in zip(order, names)))
        within, so_far = F.lit(False), F.lit(True)
        for k, n in zip(order, names):
            before, level = k.upto(F.col(n))
            within, so_far = within | (so_far & before), so_far & level
        return replace(frame, df=frame.df.join(F.broadcast(cut), within | so_far, "inner").select(*frame.kept))
    if order:
        return replace(frame, df=frame.df.orderBy(*(k.by for k in order)).limit(s.n))
    return replace(frame, df=frame.df.limit(s.n), stable=False)


def _join(frame: Frame, s: N.Join, table) -> Frame:
    other = load(table(s.table))
    on = functools.reduce(operator.and_, [frame.col(k.mine) == other.col(k.theirs) for k in s.keys])
    df = frame.df.join(other.df, on, {"this": "left", "none": "inner", "both": "full"}[s.unmatched])
    theirs = {k.theirs for k in s.keys}
    names = dict(frame.names)
    made = {}
    if s.unmatched == "both":
        for k in s.keys:
            names[k.mine] = fresh()
            made[names[k.mine]] = F.coalesce(frame.col(k.mine), other.col(k.theirs))
    names |= {n: c for n, c in other.names.items() if n not in theirs}
    return Frame(df, names, stable=frame.stable).select(made, names)


def _add_rows(frame: Frame, s: N.AddRows, table) -> Frame:
    other = load(table(s.table))
    more = other.df.select(*(other.col(n).alias(c) for n, c in frame.names.items()))
    return Frame(frame.df.select(*frame.names.values()).unionByName(more), frame.names, stable=frame.stable)


def _add_combinations(frame: Frame, s: N.AddCombinations, table) -> Frame:
    by = [frame.names[c.name] for c in s.by]
    columns = [frame.names[c.name] for c in s.columns]
    present = lambda cols: functools.reduce(operator.and_, [F.col(c).isNotNull() for c in cols])
    grid = None
    for c in columns:
        values = frame.df.filter(present([*by, c])).select(*by, c).distinct()
        grid = values if grid is None else grid.join(values, by) if by else grid.crossJoin(values)
    held = frame.df.filter(present(by + columns)).select(*(F.col(c).alias(f"{c}_") for c in by + columns))
    on = functools.reduce(operator.and_, [F.col(c) == F.col(f"{c}_") for c in by + columns])
    absent = grid.join(held, on, "left_anti")
    df = frame.df.select(*frame.names.values())
    return Frame(df.unionByName(absent, allowMissingColumns=True), frame.names, stable=frame.stable)


def _drop_duplicates(frame: Frame, s: N.DropDuplicates, table) -> Frame:
    out = Frame(frame.df.select(*frame.names.values()).distinct(), frame.names, stable=frame.stable)
    return replace(out, order=settled(out, list(out.names)))


def _rename(frame: Frame, s: N.Rename, table) -> Frame:
    to = {v.value.name: v.name for v in s.values}
    return replace(frame, names={to.get(n, n): c for n, c in frame.names.items()})


def _drop_missing(frame: Frame, s: N.DropMissing, table) -> Frame:
    columns = [c.name for c in s.columns] or list(frame.names)
    return replace(frame, df=frame.df.filter(functools.reduce(operator.and_, [frame.col(n).isNotNull() for n in columns])))


def _fill_missing(frame: Frame, s: N.FillMissing, table) -> Frame:
    new = {v.name: fresh() for v in s.values}
    made = {new[v.name]: F.coalesce(frame.col(v.name), compile(v.value, Env(frame.col))) for v in s.values}
    return frame.select(made, {n: new.get(n, c) for n, c in frame.names.items()})


def _lengthen(frame: Frame, s: N.Lengthen, table) -> Frame:
    kept, name_cols, value_cols, rows = s.made
    names = {n: frame.names[n] for n in kept} | {n: fresh() for n in (*name_cols, *value_cols)}
    # One kind of value may come in several types: what a coalesce of them has is common to all.
    common = [F.coalesce(*(frame.col(sources[i]) for _, sources in rows)) for i in range(len(value_cols))]
    kinds = frame.df.select(*(c.alias(f"v{i}") for i, c in enumerate(common))).schema
    each = [
        F.struct(*(F.lit(x).alias(names[n]) for n, x in zip(name_cols, labels)), *(frame.col(src).cast(kinds[i].dataType).alias(names[n]) for i, (n, src) in enumerate(zip(value_cols, sources))))
        for labels, sources in rows
    ]
    made = fresh()
    df = frame.df.select(*(frame.names[n] for n in kept), F.explode(F.array(*each)).alias(made))
    df = df.select(*(frame.names[n] for n in kept), *(F.col(made)[names[n]].alias(names[n]) for n in (*name_cols, *value_cols)))
    out = Frame(df, names, stable=frame.stable)
    return replace(out, order=settled(out, list(names)))


def _raise_if(bad: Column, message: str) -> Column:
    """A filter that lets every row pass or stops the query; as a filter it cannot be pruned."""
    return F.when(bad, F.raise_error(F.lit(message)).cast("boolean")).otherwise(F.lit(True))


def _widen(frame: Frame, s: N.Widen, table) -> Frame:
    parts = [frame.col(n).cast("string") for n in s.name.named]
    single = len(s.name.parts) == 1 and s.name.parts[0][0]
    if s.giving:
        labels = [(c.name, [c.name] if single else s.name.read(c.name)) for c in s.giving]
    else:
        found = frame.df.select(*(p.alias(f"p{i}") for i, p in enumerate(parts))).dropna().distinct().limit(MOST_LABELS + 1).collect()
        if len(found) > MOST_LABELS:
            raise ValueError(f"`widen` would make more than {MOST_LABELS} columns")
        labels = []
        for row in sorted(tuple(r) for r in found):
            pieces = iter(row)
            labels.append(("".join(next(pieces) if is_part else x for is_part, x in s.name.parts), list(row)))
    masks = [functools.reduce(operator.and_, [p == x for p, x in zip(parts, pieces)]) for _, pieces in labels]
    by = [c.name for c in s.by]
    rank = None
    if _needs_rank(frame, [s.value]):
        frame, rank = _ranked(frame, [frame.names[n] for n in by])
    names = {n: fresh() for n in by} | {n: fresh() for n, _ in labels}
    arg = lambda x: compile(x, Env(frame.col))
    cells, guards = [], {}
    many = aggregates(s.value)
    for (n, _), mask in zip(labels, masks):
        rows = F.count(F.when(mask, 1))
        if many:
            env = Env(frame.col, lambda c, mask=mask: aggregate(c, arg, frame.order, rank, mask))
            cell = F.when(rows > 0, compile(s.value, env))
        else:
            cell = F.first(F.when(mask, compile(s.value, Env(frame.col))), ignorenulls=True)
            guards[fresh()] = rows.alias("n"), f"two rows fall into one cell of [{n}]: say how they become one, such as `value total([x])`"
        cells.append(cell.alias(names[n]))
    if s.giving:
        strange = ~functools.reduce(operator.or_, [F.coalesce(m, F.lit(False)) for m in masks])
        odd = fresh()
    df = frame.df.groupBy(*(frame.col(n).alias(names[n]) for n in by)).agg(
        *cells, *(c.alias(g) for g, (c, _) in guards.items()), *([F.count(F.when(strange, 1)).alias(odd)] if s.giving else [F.lit(0).alias(fresh())])
    )
    for g, (_, message) in guards.items():
        df = df.filter(_raise_if(F.col(g) > 1, message))
    if s.giving:
        df = df.filter(_raise_if(F.col(odd) > 0, "a row's name is none of the columns in `giving`"))
    out = Frame(df, names, stable=frame.stable)
    if s.missing is not None:
        filler = compile(s.missing, Env(out.col))
        fills = {n: fresh() for n, _ in labels}
        out = out.select({fills[n]: F.coalesce(out.col(n), filler) for n, _ in labels}, {n: fills.get(n, c) for n, c in names.items()})
    return replace(out, order=settled(out, by))


_STEPS = {
    "Keep": _keep, "Pick": _pick, "Add": _add, "Summarize": _summarize, "Sort": _sort, "Take": _take, "Join": _join, "AddRows": _add_rows,
    "AddCombinations": _add_combinations, "DropDuplicates": _drop_duplicates, "Rename": _rename, "DropMissing": _drop_missing,
    "FillMissing": _fill_missing, "Lengthen": _lengthen, "Widen": _widen,
}
