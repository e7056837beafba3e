"""A checked plan as PySpark code to read: functions F and Window, one assignment per step."""

from __future__ import annotations

from . import nodes as N
from .checker import Checked, aggregates, is_role
from .diagnostics import PlainError


def code(checked: Checked) -> str:
    out = ["from pyspark.sql import Window, functions as F", "", f"df = spark.table({checked.plan.table!r})"]
    order: list[tuple[str, bool, bool]] = []
    count = 0
    schemas = [*checked.entering[1:], checked.leaving]
    for s, before, after in zip(checked.plan.steps, checked.entering, schemas):
        names, hidden = before.names, [k[0] for k in order if k[0] not in after.names]
        if isinstance(s, N.Keep):
            c, how = s.condition, "left_semi"
            if isinstance(c, N.Not) and isinstance(c.of, N.Matching):
                c, how = c.of, "left_anti"
            if isinstance(c, N.Matching):
                on = ", ".join(f"df[{k.mine!r}] == other[{k.theirs!r}]" for k in c.keys)
                out += [f"other = spark.table({c.table!r})", f"df = df.join(other, [{on}], {how!r})"]
            else:
                out.append(f"df = df.filter({_e(c)})")
        elif isinstance(s, N.Pick):
            out.append(f"df = df.select({', '.join(map(repr, after.names + hidden))})")
        elif isinstance(s, N.Add):
            by = [c.name for c in s.by]
            values = ", ".join(f"{v.name!r}: {_e(v.value, by, order)}" for v in s.values)
            out.append(f"df = df.withColumns({{{values}}})")
        elif isinstance(s, N.Summarize):
            values = ", ".join(f"{_e(v.value, None, order)}.alias({v.name!r})" for v in s.values)
            out.append(f"df = df.groupBy({', '.join(repr(c.name) for c in s.by)}).agg({values})")
            order = [(c.name, False, False) for c in s.by]
        elif isinstance(s, N.Sort):
            order = []
            for k in s.keys:
                count += 1
                order.append((f"__order_{count}", k.descending, s.missing_first))
            out.append(f"df = df.withColumns({{{', '.join(f'{o[0]!r}: F.col({k.name!r})' for o, k in zip(order, s.keys))}}})")
        elif isinstance(s, N.Take):
            keys = [(c, not d, not f) for c, d, f in order] if s.last else order
            if s.by or s.ties:
                over = f"Window.partitionBy({', '.join(repr(c.name) for c in s.by)}).orderBy({_keys(keys)})"
                out.append(f"df = df.withColumn('__place', F.{'rank' if s.ties else 'row_number'}().over({over})).filter(F.col('__place') <= {s.n}).drop('__place')")
            else:
                out.append(f"df = df{f'.orderBy({_keys(keys)})' if keys else ''}.limit({s.n})")
        elif isinstance(s, N.Join):
            out.append(f"other = spark.table({s.table!r})" + "".join(f".withColumnRenamed({k.theirs!r}, {k.mine!r})" for k in s.keys if k.mine != k.theirs))
            how = {"this": "left", "none": "inner", "both": "full"}[s.unmatched]
            out.append(f"df = df.join(other, {[k.mine for k in s.keys]!r}, {how!r}).select({', '.join(map(repr, after.names))})")
            order = []
        elif isinstance(s, N.AddRows):
            out.append(f"df = df.select({', '.join(map(repr, names))}).unionByName(spark.table({s.table!r}))")
            order = []
        elif isinstance(s, N.AddCombinations):
            by, cols = [c.name for c in s.by], [c.name for c in s.columns]
            parts = [f"df.select({', '.join(map(repr, [*by, c]))}).dropna().distinct()" for c in cols]
            grid = parts[0] + "".join(f".join({p}, {by!r})" if by else f".crossJoin({p})" for p in parts[1:])
            out += [f"df = df.select({', '.join(map(repr, names))})", f"grid = {grid}", f"df = df.unionByName(grid.join(df, {by + cols!r}, 'left_anti'), allowMissingColumns=True)"]
            order = []
        elif isinstance(s, N.DropDuplicates):
            out.append(f"df = df.select({', '.join(map(repr, names))}).distinct()")
            order = [(n, False, False) for n in names]
        elif isinstance(s, N.Rename):
            to = {v.value.name: v.name for v in s.values}
            out.append(f"df = df.withColumnsRenamed({to!r})")
            order = [(to.get(c, c), d, f) for c, d, f in order]
        elif isinstance(s, N.DropMissing):
            cols = [c.name for c in s.columns] or names
            out.append("df = df.filter(" + " & ".join(f"F.col({c!r}).isNotNull()" for c in cols) + ")")
        elif isinstance(s, N.FillMissing):
            out.append("df = df.withColumns({" + ", ".join(f"{v.name!r}: F.coalesce(F.col({v.name!r}), {_e(v.value)})" for v in s.values) + "})")
        elif isinstance(s, N.Lengthen):
            kept, name_cols, value_cols, rows = s.made
            structs = []
            for labels, sources in rows:
                parts = [f"F.lit({x!r}).alias({n!r})" for n, x in zip(name_cols, labels)] + [f"F.col({x!r}).alias({n!r})" for n, x in zip(value_cols, sources)]
                structs.append(f"F.struct({', '.join(parts)})")
            out.append(f"df = df.select({''.join(f'{n!r}, ' for n in kept)}F.explode(F.array({', '.join(structs)})).alias('__cell')).select({''.join(f'{n!r}, ' for n in kept)}'__cell.*')")
            order = [(n, False, False) for n in (*kept, *name_cols, *value_cols)]
        else:
            if len(s.name.parts) > 1:
                raise PlainError("a `widen` by a pattern has no short spelling in PySpark", s.span, kind="not built yet")
            on, by = s.name.named[0], [c.name for c in s.by]
            values = f", {[c.name for c in s.giving]!r}" if s.giving else ""
            cell = _e(s.value, None, order) if aggregates(s.value) else f"F.first({_e(s.value)}, ignorenulls=True)"
            out.append(f"df = df.groupBy({', '.join(map(repr, by))}).pivot({on!r}{values}).agg({cell})")
            if s.missing is not None:
                out.append("df = df.withColumns({" + ", ".join(f"{c.name!r}: F.coalesce(F.col({c.name!r}), {_e(s.missing)})" for c in s.giving) + "})")
            order = [(n, False, False) for n in by]
    if order:
        out.append(f"df = df.orderBy({_keys(order)})")
    hidden = [k[0] for k in order if k[0].startswith("__order_")]
    if hidden:
        out.append(f"df = df.drop({', '.join(map(repr, hidden))})")
    return "\n".join(out)


def _keys(order) -> str:
    return ", ".join(f"F.col({c!r}).{'desc' if d else 'asc'}_nulls_{'first' if f else 'last'}()" for c, d, f in order)


_SPELLED = {
    "first_present": "coalesce", "join_text": "concat", "lower": "lower", "upper": "upper", "trim": "trim", "replace_text": "replace", "split_text": "split_part",
    "characters": "char_length", "year": "year", "month": "month", "day": "dayofmonth", "hour": "hour",
}
_AGGREGATES = {"total": "sum", "average": "avg", "median": "median", "smallest": "min", "largest": "max", "standard_deviation": "stddev_samp", "unique_count": "count_distinct"}


def _e(e: N.Node, by: list[str] | None = None, order=None) -> str:
    sub = lambda x: _e(x, by, order)
    if isinstance(e, N.Col):
        return f"F.col({e.name!r})"
    if isinstance(e, N.Lit):
        return f"F.lit({e.value!r})"
    if isinstance(e, N.Binary):
        if e.op in ("starts", "ends", "contains"):
            return f"{sub(e.left)}.{ {'starts': 'startswith', 'ends': 'endswith'}.get(e.op, e.op) }({sub(e.right)})"
        return f"({sub(e.left)} {({'is': '==', 'is not': '!=', 'and': '&', 'or': '|'}).get(e.op, e.op)} {sub(e.right)})"
    if isinstance(e, N.Not):
        return f"(~{sub(e.of)})"
    if isinstance(e, N.IsMissing):
        return f"{sub(e.of)}.is{'Not' if e.negated else ''}Null()"
    if isinstance(e, N.In):
        return f"{'(~' if e.negated else ''}{sub(e.of)}.isin({[x.value for x in e.items]!r}){')' if e.negated else ''}"
    if isinstance(e, (N.When, N.LookUp)):
        pairs = [(sub(a), sub(b)) for a, b in e.branches] if isinstance(e, N.When) else [(f"{sub(e.of)} == {sub(a)}", sub(b)) for a, b in e.pairs]
        return "F" + "".join(f".when({a}, {b})" for a, b in pairs) + (f".otherwise({sub(e.otherwise)})" if e.otherwise else "")
    part = f"Window.partitionBy({', '.join(map(repr, by or []))})"
    if is_role(e, "aggregate"):
        if e.name == "unique_count" and by is not None:
            return f"F.size(F.collect_set({sub(e.args[0])}).over({part}))"
        if e.name == "row_count":
            out = "F.count(F.lit(1))"
        elif e.name in _AGGREGATES:
            out = f"F.{_AGGREGATES[e.name]}({sub(e.args[0])})"
        elif e.name == "join_rows":
            key = f"F.struct({', '.join(f'F.col({c!r})' for c, _, _ in order)}, {sub(e.args[0])}.alias('x'))" if order else f"F.struct({sub(e.args[0])}.alias('x'))"
            rows = f"F.array_sort(F.collect_list({key}){f'.over({part})' if by is not None else ''})"
            rows = f"F.reverse({rows})" if order and order[0][1] else rows
            return f"F.array_join(F.transform({rows}, lambda r: r['x']), {e.args[1].value!r})"
        elif order:
            down = order[0][1]
            keys = ", ".join(f"F.col({c!r}).is{'Not' if f != d else ''}Null(), F.col({c!r})" for c, d, f in order)
            out = f"F.{'min_by' if (e.name == 'first') != down else 'max_by'}({sub(e.args[0])}, F.struct({keys}))"
        else:
            out = f"F.{e.name}({sub(e.args[0])})"
        return out if by is None else f"{out}.over({part})"
    if is_role(e, "window"):
        over = f"{part}.orderBy({_keys(order or [])})"
        if e.name == "rank":
            return f"F.rank().over({part}.orderBy({_keys([(e.args[0].name, e.descending, False)])}))"
        if e.name == "row_number":
            return f"F.row_number().over({over})"
        if e.name in ("previous", "following"):
            return f"F.{'lag' if e.name == 'previous' else 'lead'}({_e(e.args[0])}, {e.args[1].value if len(e.args) == 2 else 1}).over({over})"
        if e.name in ("running_total", "latest"):
            fn = f"F.sum({_e(e.args[0])})" if e.name == "running_total" else f"F.last({_e(e.args[0])}, ignorenulls=True)"
            return f"{fn}.over({over}.rowsBetween(Window.unboundedPreceding, 0))"
        agg, n = e.args
        frame = f"{over}.rowsBetween({1 - n.value}, 0)"
        x = _e(agg.args[0])
        fn = f"F.percentile({x}, 0.5)" if agg.name == "median" else f"F.{_AGGREGATES[agg.name]}({x})"
        return f"F.when(F.count({x}).over({frame}) == {n.value}, {fn}.over({frame}))"
    a = [sub(x) for x in e.args]
    if e.name in _SPELLED:
        return f"F.{_SPELLED[e.name]}({', '.join(a)})"
    return {
        "to_number": lambda: f"{a[0]}.cast('double')",
        "to_text": lambda: f"{a[0]}.cast('string')",
        "to_date": lambda: f"{a[0]}.cast('date')",
        "round_below": lambda: f"F.floor({a[0]}).cast('bigint')",
        "round_above": lambda: f"F.ceil({a[0]}).cast('bigint')",
        "between": lambda: f"{a[0]}.between({a[1]}, {a[2]})",
        "remainder": lambda: f"((({a[0]} % {a[1]}) + {a[1]}) % {a[1]})",
        "weekday": lambda: f"(F.weekday({a[0]}) + 1)",
    }[e.name]()
