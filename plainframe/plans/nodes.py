"""The plan: steps and expressions. Spans say where they stand in the text and do not count in comparisons."""

from __future__ import annotations

from dataclasses import dataclass, field, fields
from typing import Any

from .diagnostics import Span


def _span() -> Any:
    return field(default=(0, 0), compare=False, repr=False)


@dataclass(frozen=True)
class Node:
    pass


@dataclass(frozen=True)
class Col(Node):
    name: str
    span: Span = _span()


@dataclass(frozen=True)
class Lit(Node):
    value: Any  # str, int, float, bool, or None for missing
    span: Span = _span()


@dataclass(frozen=True)
class Selector(Node):
    word: str  # name, kind or value
    span: Span = _span()


@dataclass(frozen=True)
class Binary(Node):
    op: str  # + - * / is, is not, < <= > >=, and, or, starts, ends, contains
    left: Node
    right: Node
    span: Span = _span()


@dataclass(frozen=True)
class Not(Node):
    of: Node
    span: Span = _span()


@dataclass(frozen=True)
class In(Node):
    of: Node
    items: tuple[Lit, ...]
    negated: bool = False
    span: Span = _span()


@dataclass(frozen=True)
class IsMissing(Node):
    of: Node
    negated: bool = False
    span: Span = _span()


@dataclass(frozen=True)
class Call(Node):
    name: str
    args: tuple[Node, ...] = ()
    descending: bool = False  # of rank
    span: Span = _span()


@dataclass(frozen=True)
class When(Node):
    branches: tuple[tuple[Node, Node], ...]
    otherwise: Node | None = None
    span: Span = _span()


@dataclass(frozen=True)
class LookUp(Node):
    of: Node
    pairs: tuple[tuple[Lit, Lit], ...]
    otherwise: Node | None = None
    span: Span = _span()


@dataclass(frozen=True)
class KeyPair(Node):
    mine: str
    theirs: str
    span: Span = _span()


@dataclass(frozen=True)
class Matching(Node):
    table: str
    keys: tuple[KeyPair, ...] = ()
    span: Span = _span()


@dataclass(frozen=True)
class Quantified(Node):
    word: str  # any or every
    selector: Node
    test: Node
    span: Span = _span()


@dataclass(frozen=True)
class Named(Node):
    name: str
    value: Node
    span: Span = _span()


@dataclass(frozen=True)
class SortKey(Node):
    name: str
    descending: bool = False
    span: Span = _span()


@dataclass(frozen=True)
class Choice(Node):
    """Columns by list, by what is left when a list goes, or by a condition on them."""

    names: tuple[Col, ...] = ()
    all_but: bool = False
    where: Node | None = None
    span: Span = _span()


@dataclass(frozen=True)
class Pattern(Node):
    """How labels make a column's name: text pieces and {parts}, in turn. parts: (is a part, text)."""

    parts: tuple[tuple[bool, str], ...]
    span: Span = _span()

    @classmethod
    def single(cls, name: str, span: Span = (0, 0)) -> Pattern:
        return cls(((True, name),), span)

    @property
    def named(self) -> list[str]:
        return [x for is_part, x in self.parts if is_part and x != "value"] if len(self.parts) > 1 else [x for _, x in self.parts]

    @property
    def has_value(self) -> bool:
        return len(self.parts) > 1 and (True, "value") in self.parts

    def read(self, name: str) -> list[str] | None:
        """The parts of a name, each the shortest that fits and not empty; None where it has another shape."""
        out, at = [], 0
        for k, (is_part, x) in enumerate(self.parts):
            if not is_part:
                if not name.startswith(x, at):
                    return None
                at += len(x)
            elif k + 1 == len(self.parts):
                out.append(name[at:])
                at = len(name)
            else:
                end = name.find(self.parts[k + 1][1], at + 1)
                if end < 0:
                    return None
                out.append(name[at:end])
                at = end
        return out if at == len(name) and all(out) else None

    def text(self) -> str:
        return "".join("{" + x + "}" if is_part else x for is_part, x in self.parts)


# Steps.


@dataclass(frozen=True)
class Keep(Node):
    condition: Node
    span: Span = _span()


@dataclass(frozen=True)
class Pick(Node):
    choice: Choice
    span: Span = _span()


@dataclass(frozen=True)
class Add(Node):
    values: tuple[Named, ...]
    by: tuple[Col, ...] = ()
    sweep: tuple[Node, Node] | None = None  # condition on columns, expression over value
    span: Span = _span()


@dataclass(frozen=True)
class Summarize(Node):
    values: tuple[Named, ...]
    by: tuple[Col, ...] = ()
    sweep: tuple[Node, Node] | None = None
    span: Span = _span()


@dataclass(frozen=True)
class Sort(Node):
    keys: tuple[SortKey, ...]
    missing_first: bool = False
    span: Span = _span()


@dataclass(frozen=True)
class Take(Node):
    n: int
    by: tuple[Col, ...] = ()
    ties: bool = False
    last: bool = False
    span: Span = _span()


@dataclass(frozen=True)
class Join(Node):
    table: str
    keys: tuple[KeyPair, ...] = ()
    unmatched: str = "this"
    span: Span = _span()


@dataclass(frozen=True)
class AddRows(Node):
    table: str
    span: Span = _span()


@dataclass(frozen=True)
class AddCombinations(Node):
    columns: tuple[Col, ...]
    by: tuple[Col, ...] = ()
    span: Span = _span()


@dataclass(frozen=True)
class DropDuplicates(Node):
    span: Span = _span()


@dataclass(frozen=True)
class Rename(Node):
    values: tuple[Named, ...]
    span: Span = _span()


@dataclass(frozen=True)
class DropMissing(Node):
    columns: tuple[Col, ...] = ()
    span: Span = _span()


@dataclass(frozen=True)
class FillMissing(Node):
    values: tuple[Named, ...]
    span: Span = _span()


@dataclass(frozen=True)
class Lengthen(Node):
    choice: Choice
    name: Pattern = Pattern.single("name")
    value: str | None = None
    # What the checker found: name columns, value columns, and for each row made its labels and source columns.
    made: tuple | None = None
    span: Span = _span()


@dataclass(frozen=True)
class Widen(Node):
    name: Pattern = Pattern.single("name")
    value: Node = Col("value")
    by: tuple[Col, ...] = ()
    missing: Node | None = None
    giving: tuple[Col, ...] = ()
    span: Span = _span()


@dataclass(frozen=True)
class Plan(Node):
    table: str
    steps: tuple[Node, ...] = ()
    span: Span = _span()

    def tables(self) -> list[str]:
        """Every table the plan reads, in order."""
        out = [self.table]
        for node in walk(self):
            if isinstance(node, (Join, AddRows, Matching)) and node.table not in out:
                out.append(node.table)
        return out


def walk(node: Any):
    """A node and all below it."""
    if isinstance(node, Node):
        yield node
        for f in fields(node):
            if f.name not in ("span", "made"):
                yield from walk(getattr(node, f.name))
    elif isinstance(node, tuple):
        for x in node:
            yield from walk(x)
