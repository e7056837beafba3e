"""python -m plainframe: check, print and draw sentences. Exit 0: done, 1: wrong command line, 2: refused."""

from __future__ import annotations

import argparse
import sys

from .plans import ladder
from .plans.checker import check
from .plans.diagnostics import PlainError
from .plans.parser import parse
from .plans.vocabulary import CONDITIONALS, FUNCTIONS, STEPS, WORDS
from .show import TARGETS, described, lookup, write_as

SEATS = {
    # Where a call may stand: in which steps, for scalars, aggregates and windows.
    "keep where": (True, False, False),
    "add": (True, True, True),
    "add ... by": (True, True, True),
    "summarize": (False, True, False),
    "fill_missing": (True, False, False),
    "widen value": (True, True, False),
}


class _Parser(argparse.ArgumentParser):
    def error(self, message: str):
        print(f"{self.prog}: {message}", file=sys.stderr)
        raise SystemExit(1)


def main(args: list[str] | None = None) -> int:
    p = _Parser(prog="plainframe", description="Check a sentence and write it in another spelling; nothing runs.")
    p.add_argument("sentence", nargs="?", help="the sentence; read from standard input if absent")
    p.add_argument("--columns", action="append", default=[], metavar="LIST", help="name:kind,... of the head table, or table=name:kind,... of another; may repeat")
    p.add_argument("--as", dest="target", default="sql", choices=TARGETS)
    p.add_argument("--draw", action="store_true", help="draw the table between steps")
    p.add_argument("--needs", action="store_true", help="print the tables that the sentence reads")
    p.add_argument("--vocabulary", action="store_true", help="print every word and what it is")
    p.add_argument("--seats", action="store_true", help="print where scalars, aggregates and windows may stand")
    a = p.parse_args(args)
    if a.vocabulary:
        for role, words in (("step", STEPS), ("word", WORDS), ("conditional", CONDITIONALS)):
            print(*(f"{role} {w}" for w in words), sep="\n")
        print(*(f"{f.role} {f.name}" for f in FUNCTIONS.values()), sep="\n")
        return 0
    if a.seats:
        for seat, stands in SEATS.items():
            for role, may in zip(("scalar", "aggregate", "window"), stands):
                print(f"{seat}\t{role}\t{'stands' if may else 'refused'}")
        return 0
    text = a.sentence if a.sentence is not None else sys.stdin.read()
    try:
        plan = parse(text)
        if a.needs:
            print(*plan.tables(), sep="\n")
            return 0
        schemas = {}
        for x in a.columns:
            table, sign, columns = x.partition("=")
            schemas[table if sign else plan.table] = described(columns if sign else x)
        if a.draw:
            print(ladder.draw(ladder.reading(plan, lambda n: lookup(schemas, n), text)))
            return 0
        out = check(plan, lambda n: lookup(schemas, n), text)
        for note in out.assumptions:
            print(note.render(text), file=sys.stderr)
        print(write_as(out, a.target))
        return 0
    except PlainError as e:
        print(e.inside(text), file=sys.stderr)
        return 2
