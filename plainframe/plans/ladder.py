"""The table between steps, drawn as a ladder; a refused plan is drawn as far as it was understood."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from . import nodes as N
from .checker import Checker, check
from .diagnostics import PlainError
from .render import step as written
from .schema import Schema, word

_NOTES = {
    N.Summarize: "one row per group", N.DropDuplicates: "one row of each kind", N.Lengthen: "one row per cell", N.Widen: "one row per group",
    N.AddCombinations: "rows for combinations that were absent",
}


def _note(s: N.Node) -> str:
    if isinstance(s, N.Take):
        return f"at most {s.n} row{'s' * (s.n != 1)}{' per group' if s.by else ''}{', more where they tie' if s.ties else ''}"
    if isinstance(s, N.Join):
        return {"this": "a row may match several", "none": "only rows that match", "both": "rows of both tables"}[s.unmatched]
    if isinstance(s, (N.Summarize, N.Widen)) and not s.by:
        return "one row"
    return _NOTES.get(type(s), "")


@dataclass
class Row:
    """A table as it stands: at the head, or after a step."""

    label: str
    kept: list[tuple[str, str]] = field(default_factory=list)  # name and kind
    new: list[tuple[str, str]] = field(default_factory=list)
    gone: list[str] = field(default_factory=list)
    note: str = ""
    other: tuple[str, list[tuple[str, str]]] | None = None  # the table that the step reads
    refusal: str = ""


def _reads(s: N.Node) -> str | None:
    if isinstance(s, (N.Join, N.AddRows)):
        return s.table
    found = [x.table for x in N.walk(s.condition) if isinstance(x, N.Matching)] if isinstance(s, N.Keep) else []
    return found[0] if found else None


def reading(plan: N.Plan, tables: Callable[[str], Schema], text: str = "") -> list[Row]:
    """The rows of a drawing: all steps, or those before the refused one and that one."""
    schemas, steps, refused, done = [], plan.steps, None, None
    for k in range(len(plan.steps) + 1):
        try:
            done = Checker(tables).check(N.Plan(plan.table, plan.steps[:k], plan.span))
        except PlainError as e:
            refused, steps = e.inside(text), plan.steps[:k]
            break
        schemas.append(done.leaving)
    kinds = lambda of: [(n, word(t)) for n, t in of.columns]
    out = [Row(plan.table, kinds(schemas[0]))] if schemas else [Row(plan.table, refusal=str(refused.args[0]))]
    for before, now, s in zip(schemas, schemas[1:], done.plan.steps if done else ()):
        other = _reads(s)
        out.append(
            Row(
                written(s),
                [x for x in kinds(now) if x[0] in before],
                [x for x in kinds(now) if x[0] not in before],
                [n for n in before.names if n not in now],
                _note(s),
                (other, kinds(tables(other))) if other else None,
            )
        )
    if refused and schemas:
        out.append(Row(written(steps[-1]), refusal=str(refused.args[0])))
    return out


def draw(rows: list[Row]) -> str:
    """The rows as lines of text."""
    signs = [""] + ["├ "] * (len(rows) - 2) + ["└ "] * (len(rows) > 1)
    width = min(44, max(len(s + r.label) for s, r in zip(signs, rows)))
    out = []
    for k, (sign, r) in enumerate(zip(signs, rows)):
        rail = "│ " if k and sign.startswith("├") else "  "
        if r.refusal:
            out += [sign + r.label, *r.refusal.split("\n")]
            break
        cells = "  ".join([n if k else f"{n}:{kind}" for n, kind in r.kept] + [f"+{n}:{kind}" for n, kind in r.new])
        if len(sign + r.label) <= width:
            out.append(f"{(sign + r.label).ljust(width)}  {cells}".rstrip())
        else:
            out += [sign + r.label, f"{rail.ljust(width)}  {cells}".rstrip()]
        if r.gone:
            out.append(f"{rail.ljust(width)}  {'  '.join('-' + n for n in r.gone)}".rstrip())
        if r.note:
            out.append(f"{rail}  {r.note}")
    return "\n".join(out)


__all__ = ["Row", "check", "draw", "reading"]
