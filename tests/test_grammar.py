"""The vocabulary walked, round trips, builders, drawing and the command line."""

import subprocess
import sys

import plainframe as pf
import pytest
from hypothesis import given, settings, strategies as st
from plainframe import PlainError, col, queries
from plainframe.plans import render
from plainframe.plans.checker import check
from plainframe.plans.parser import parse
from plainframe.plans.vocabulary import FUNCTIONS, STEPS
from plainframe.show import described

SCHEMA = described("n:number,m:number,s:text,r:text,d:date,at:timestamp,ok:truth")
CALLS = {
    "total": "total([n])", "average": "average([n])", "median": "median([n])", "smallest": "smallest([n])", "largest": "largest([s])",
    "standard_deviation": "standard_deviation([n])", "first": "first([s])", "last": "last([s])", "unique_count": "unique_count([s])", "row_count": "row_count()",
    "join_rows": 'join_rows([s], "-")', "rank": "rank([n] descending)", "row_number": "row_number()", "running_total": "running_total([n])", "previous": "previous([s], 2)",
    "following": "following([s])", "latest": "latest([n])", "rolling": "rolling(median([n]), 2)", "first_present": "first_present([n], [m], 0)", "join_text": 'join_text([s], "-", [r])',
    "lower": "lower([s])", "upper": "upper([s])", "to_number": 'to_number("12.5")', "to_text": "to_text([n])", "to_date": 'to_date("2026-01-05")', "round_below": "round_below([n] / 2)",
    "round_above": "round_above([n] / 2)", "trim": "trim([s])", "replace_text": 'replace_text([s], "a", "b")', "split_text": 'split_text([s], "-", 1)', "characters": "characters([s])",
    "between": "between([n], 1, 2)", "remainder": "remainder([n], 2)", "year": "year([d])", "month": "month([d])", "day": "day([at])", "weekday": "weekday([d])", "hour": "hour([at])",
}


@pytest.fixture(scope="module")
def t(spark):
    return spark.sql("SELECT 1.5D AS n, 2L AS m, 'a-b' AS s, 'x' AS r, date'2026-01-05' AS d, timestamp'2026-01-05 07:08:09' AS at, true AS ok UNION ALL SELECT NULL, 3L, 'c', NULL, date'2026-01-06', NULL, false")


def test_every_function_has_a_call():
    assert set(CALLS) == set(FUNCTIONS)


@pytest.mark.parametrize("name", sorted(CALLS))
def test_every_function_runs(t, name):
    step = "summarize" if FUNCTIONS[name].role == "aggregate" else "add"
    assert pf.run(f"t then sort [m] then {step} [x] as {CALLS[name]}", t=t).count() in (1, 2)


@pytest.mark.parametrize("name", sorted(CALLS))
def test_every_builder_is_exported(name):
    assert callable(getattr(pf, name))


def test_every_step_parses_back():
    used = set()
    for sentence in queries.sentences().values():
        plan = parse(sentence)
        assert parse(render.text(plan)) == plan
        used |= {line.split()[1] for line in render.text(plan).split("\n")[1:]}
    assert used == set(STEPS)


names = st.sampled_from(["n", "m"])
numbers = st.recursive(
    names.map(lambda x: f"[{x}]") | st.integers(0, 99).map(str) | st.decimals(0, 9, places=2).map(str),
    lambda e: st.tuples(e, st.sampled_from("+-*/"), e).map(lambda x: f"({x[0]} {x[1]} {x[2]})") | st.tuples(e, e).map(lambda x: f"first_present({x[0]}, {x[1]})"),
    max_leaves=8,
)


@settings(max_examples=60, deadline=None)
@given(numbers, numbers, st.sampled_from(["is", "is not", "<", ">="]))
def test_expressions_round_trip(a, b, op):
    plan = parse(f"t then keep where {a} {op} {b} then add [x] as {a}")
    check(plan, lambda _: SCHEMA)
    assert parse(render.text(plan)) == plan


def test_canonical_text():
    plan = check(parse('t then keep where not [ok] or [n] + 1 > 2 then sort [n] descending, [m] missing last then take 3'), lambda _: SCHEMA).plan
    assert render.text(plan) == "t\n  then keep where ((not [ok]) or (([n] + 1) > 2))\n  then sort [n] descending, [m]\n  then take 3"


def test_builders_say_what_the_text_says(t):
    built = t >> pf.keep((col.n > 1) | ~col.s.contains("c")) >> pf.add(x=1 - col.n, y=pf.when(col.ok, "yes", otherwise="no"), by=col.r) >> pf.sort(pf.descending(col.m), missing="first") >> pf.take(2)
    assert built.written() == 't\n  then keep where (([n] > 1) or (not ([s] contains "c")))\n  then add [x] as (1 - [n]), [y] as when([ok], "yes", otherwise "no") by [r]\n  then sort [m] descending missing first\n  then take 2'
    assert [r.y for r in pf.collect(built).collect()] == ["yes"]


def test_builders_carry_tables(t, spark):
    other = spark.createDataFrame([("x", 1)], "key string, k long")
    built = t >> pf.join(other, by=col.r == col.key) >> pf.keep(~pf.matching(other, by=col.r == col.key)) >> pf.pick(col.s, col.k)
    assert "join other by [r] is [key]" in built.written() and "not matching(other, by [r] is [key])" in built.written()
    assert [tuple(r) for r in built.dataframe().collect()] == [("c", None)]


def test_builders_refuse():
    with pytest.raises(PlainError, match="neither true nor false"):
        bool(col.a == 1)
    with pytest.raises(PlainError, match="double quote"):
        col.a == 'say "x"'
    assert repr(col.a.is_in({"b", "a"})) == '([a] in {"a", "b"})'


def test_selectors_and_sweeps(t):
    built = t >> pf.add(pf.where(pf.kind == "number", pf.value * 2)) >> pf.pick(pf.where(pf.name.starts("n"))) >> pf.keep(pf.where_any(pf.kind == "number", pf.value > 1))
    assert [r.n for r in built.dataframe().collect()] == [3.0]


def test_show_steps(t):
    drawn = pf.show_steps("t then pick [n, s] then add [x] as [n] * 2 then summarize [a] as total([x]) by [s] then take 1", t=t)
    assert "+x:number" in drawn and "-n" in drawn and "one row per group" in drawn and "at most 1 row" in drawn


def test_show_steps_of_a_refused_plan(t):
    drawn = pf.show_steps("t then pick [n, s] then keep where [zz] > 1", t=t)
    assert "pick [n, s]" in drawn and "there is no column [zz]" in drawn


def test_show_steps_as_a_picture(t):
    from xml.etree import ElementTree

    drawn = pf.show_steps("t then add [x<y] as [n] * 2 then keep where matching(t, by [n]) then summarize [a] as total([n]) by [s] then take 1", t=t)
    root = ElementTree.fromstring(drawn.svg)
    words = [e.text for e in root.iter("{http://www.w3.org/2000/svg}text")]
    assert drawn._repr_html_() == drawn.svg and repr(drawn) == drawn.text == str(drawn)
    assert "x<y" in words and words.count("t") == 2 and "one row per group" in words
    kinds = [e.get("class") for e in root.iter("{http://www.w3.org/2000/svg}rect")]
    assert {"chip", "new", "gone"} == set(kinds)
    width = int(root.get("width"))
    assert all(int(e.get("x")) + int(e.get("width")) <= width for e in root.iter("{http://www.w3.org/2000/svg}rect"))
    refused = pf.show_steps("t then keep where [zz] > 1", t=t)
    assert "there is no column [zz]" in refused.svg
    ElementTree.fromstring(refused.svg)


def test_show_as(t):
    assert "ORDER BY" in pf.show_as("t then sort [n]", "sql", t=t)
    assert "orderBy" in pf.show_as("t then sort [n]", "pyspark", t=t)
    with pytest.raises(PlainError, match="Did you mean `spark`"):
        pf.show_as("t then sort [n]", "sparc", t=t)


def call(*args, text=None):
    p = subprocess.run([sys.executable, "-m", "plainframe", *args], input=text, capture_output=True, text=True)
    return p.returncode, p.stdout, p.stderr


def test_command_line():
    assert call("--needs", "a then join b.c by [x] then add_rows d")[:2] == (0, "a\nb.c\nd\n")
    code, out, _ = call("--columns", "a:number", "--as", "text", text="t then sort [a] descending")
    assert (code, out) == (0, "t\n  then sort [a] descending\n")
    assert call("--columns", "a:number", "t then keep where [b] > 1")[0] == 2
    assert call("--no-such-flag")[0] == 1
    assert "aggregate total" in call("--vocabulary")[1]
    assert "keep where\twindow\trefused" in call("--seats")[1]
    assert "+x:number" in call("--draw", "--columns", "a:number", "t then add [x] as [a]")[1]
