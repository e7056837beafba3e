"""The closed vocabulary: steps, functions and the grammar's own words."""

from __future__ import annotations

from dataclasses import dataclass

# The steps.
STEPS = (
    "keep", "pick", "add", "summarize", "sort", "take", "take_last", "join", "add_rows", "add_combinations",
    "drop_duplicates", "rename", "drop_missing", "fill_missing", "lengthen", "widen",
)
# Words that mean something besides steps and functions.
WORDS = (
    "then", "where", "by", "as", "is", "not", "and", "or", "in", "missing", "yes", "no", "descending", "all_but", "any", "every",
    "name", "kind", "value", "starts", "ends", "contains", "otherwise", "unmatched", "with", "ties", "first", "last", "giving",
)


@dataclass(frozen=True)
class Function:
    name: str
    role: str  # aggregate, window or scalar
    least: int
    most: int | None
    takes: str  # what the arguments are: number, text, date, any
    gives: str  # number, text, truth, date or same (as the first argument)


def _f(role: str, *rows: tuple) -> list[Function]:
    return [Function(r[0], role, *r[1:]) for r in rows]


# The functions with the least and most arguments, what they take and what they give.
FUNCTIONS = {
    f.name: f
    for f in [
        *_f(
            "aggregate",
            ("total", 1, 1, "number", "number"),
            ("average", 1, 1, "number", "number"),
            ("median", 1, 1, "number", "number"),
            ("smallest", 1, 1, "any", "same"),
            ("largest", 1, 1, "any", "same"),
            ("standard_deviation", 1, 1, "number", "number"),
            ("first", 1, 1, "any", "same"),
            ("last", 1, 1, "any", "same"),
            ("unique_count", 1, 1, "any", "number"),
            ("row_count", 0, 0, "any", "number"),
            ("join_rows", 2, 2, "text", "text"),
        ),
        *_f(
            "window",
            ("rank", 1, 1, "any", "number"),
            ("row_number", 0, 0, "any", "number"),
            ("running_total", 1, 1, "number", "number"),
            ("previous", 1, 2, "any", "same"),
            ("following", 1, 2, "any", "same"),
            ("latest", 1, 1, "any", "same"),
            ("rolling", 2, 2, "any", "same"),
        ),
        *_f(
            "scalar",
            ("first_present", 2, None, "any", "same"),
            ("join_text", 2, None, "text", "text"),
            ("lower", 1, 1, "text", "text"),
            ("upper", 1, 1, "text", "text"),
            ("to_number", 1, 1, "any", "number"),
            ("to_text", 1, 1, "any", "text"),
            ("to_date", 1, 1, "any", "date"),
            ("round_below", 1, 1, "number", "number"),
            ("round_above", 1, 1, "number", "number"),
            ("trim", 1, 1, "text", "text"),
            ("replace_text", 3, 3, "text", "text"),
            ("split_text", 3, 3, "any", "text"),
            ("characters", 1, 1, "text", "number"),
            ("between", 3, 3, "any", "truth"),
            ("remainder", 2, 2, "number", "number"),
            ("year", 1, 1, "date", "number"),
            ("month", 1, 1, "date", "number"),
            ("day", 1, 1, "date", "number"),
            ("weekday", 1, 1, "date", "number"),
            ("hour", 1, 1, "timestamp", "number"),
        ),
    ]
}
#: Conditionals have a syntax of their own.
CONDITIONALS = ("when", "look_up")
#: Windows that need no sort before them.
UNORDERED = ("rank",)
#: Aggregates that rolling takes.
ROLLED = ("total", "average", "median", "smallest", "largest", "standard_deviation")
# Spellings of other languages and older ones, and what to write here.
INSTEAD = {
    "TRUE": "yes", "True": "yes", "true": "yes", "FALSE": "no", "False": "no", "false": "no", "NULL": "missing", "null": "missing",
    "NA": "missing", "None": "missing", "NaN": "missing", "ascending": "nothing: a sort ascends unless `descending` is written",
    "filter": "keep where", "select": "pick", "mutate": "add", "group_by": "by", "arrange": "sort", "limit": "take", "distinct": "drop_duplicates",
    "count": "row_count", "sum": "total", "mean": "average", "avg": "average", "min": "smallest", "max": "largest", "stddev": "standard_deviation",
    "coalesce": "first_present", "concat": "join_text", "lag": "previous", "lead": "following", "pivot": "widen", "unpivot": "lengthen",
    "union": "add_rows", "to_whole": "round_below or round_above", "except": "all_but", "like": "starts, ends or contains",
}
