"""What is said to the caller: refusals with a caret, and choices made on the caller's behalf."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

Span = tuple[int, int]


@dataclass(frozen=True)
class Diagnostic:
    kind: str  # illegal, not built yet or assumption
    message: str
    span: Span = (0, 0)

    def render(self, text: str) -> str:
        """The line that it is about, with carets under the words, counted in characters."""
        start, end = self.span
        if not text:
            return f"{self.kind}: {self.message}"
        begin = text.rfind("\n", 0, start) + 1
        stop = text.find("\n", start)
        line = text[begin : stop if stop >= 0 else len(text)]
        number = text.count("\n", 0, begin) + 1
        width = max(1, min(end, begin + len(line)) - start)
        return f"{self.kind}: {self.message}\n  line {number}: {line}\n  {' ' * len(f'line {number}: ')}{' ' * (start - begin)}{'^' * width}"


class PlainError(Exception):
    """The one exception of this library: a pipeline was refused, before anything ran."""

    def __init__(self, message: str, span: Span = (0, 0), text: str = "", kind: str = "illegal"):
        self.diagnostic, self.text = Diagnostic(kind, message, span), text
        super().__init__(self.diagnostic.render(text))

    def inside(self, text: str) -> PlainError:
        return self if self.text else PlainError(self.diagnostic.message, self.diagnostic.span, text, self.diagnostic.kind)


def distance(a: str, b: str) -> int:
    """Edits between two words."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def nearest(word: str, known: Iterable[str]) -> str | None:
    """The known word that is meant: at most two edits away, one for short words."""
    found = min(((distance(word.lower(), k.lower()), k) for k in known), default=(9, ""))
    return found[1] if found[0] <= (1 if len(word) <= 4 else 2) else None


def hint(word: str, known: Iterable[str]) -> str:
    close = nearest(word, list(known))
    return f" Did you mean `{close}`?" if close else ""
