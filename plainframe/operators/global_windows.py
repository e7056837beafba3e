"""Windows over the whole table, in parts: what Spark alone would do in one task.

Window functions without `by` are spread over ranges of the first sort key. For row_number, rank and
running_total each range counts for itself, and starts from the sums of the ranges before it: a table
of a row per range, small enough to broadcast whatever the size of the input. The cuts between ranges
are approximate quantiles, of text by its first bytes; any cuts give the same answer. Rows that tie on
the first key share a range.

The others go by the row numbers so found, in chunks of CHUNK rows. previous, following and rolling
look so many rows back or ahead, and so many rows at a chunk's end are copied to the next one.
latest starts from the last value of the chunks before it.

The quantiles are looked up while the plan is built, so a sentence with such a window over a large
table runs one job of its own before it returns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from .ordering import Key

#: Estimated bytes from which a table is worth the look at its quantiles.
LEAST_BYTES = 256 << 20
#: Rows of a chunk, at least four times as many as a window looks back.
CHUNK = 1_000_000
_CUTTABLE = (T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType, T.StringType)
#: Bytes of a text that its range goes by.
_TEXT_BYTES = 7


def worth_it(df: DataFrame, keys: list[Key]) -> bool:
    if not keys:
        return False
    kind = df.schema[keys[0].column].dataType
    return isinstance(kind, _CUTTABLE) and large(df)


def large(df: DataFrame) -> bool:
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) >= LEAST_BYTES


def _number(c: Column) -> Column:
    """A text's first bytes as a number that never falls as texts rise."""
    return F.conv(F.rpad(F.hex(F.substring(F.encode(c, "UTF-8"), 1, _TEXT_BYTES)), 2 * _TEXT_BYTES, "0"), 16, 10).cast("bigint")


def _range(df: DataFrame, key: Key) -> Column:
    """The number of a row's range, in the order of the sort."""
    n = max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    kind = df.schema[key.column].dataType
    c = F.col(key.column)
    if isinstance(kind, T.StringType):
        c, kind = _number(c), T.LongType()
    cuts = df.agg(F.percentile_approx(c, [k / n for k in range(1, n)], 10_000).alias("cuts")).first().cuts or []
    below = F.size(F.filter(F.array(*(F.lit(x).cast(kind) for x in dict.fromkeys(cuts))), lambda x: x < c)) if cuts else F.lit(0)
    place = -below if key.descending else below
    return F.when(F.col(key.column).isNull(), F.lit(-n - 1 if key.missing_first else n + 1)).otherwise(place)


def spread(df: DataFrame, fn: str, value: Column | None, keys: list[Key], out: str, reach: int = 0, over: Callable[[list[Column], list[Key]], Column] | None = None) -> DataFrame:
    """df with column out: fn over all rows in the order of keys.

    reach: how many rows it looks back or ahead; over: the function for partitions and an order.
    """
    if fn in ("row_number", "rank", "running_total"):
        return _by_ranges(df, fn, value, keys, out)
    place, chunk = f"{out}_place", f"{out}_chunk"
    df = _by_ranges(df, "row_number", None, keys, place)
    size = max(CHUNK, 4 * reach)
    own, k = F.expr(f"(`{place}` - 1) div {size}"), F.pmod(F.col(place) - 1, F.lit(size))
    if fn == "latest":
        return _latest(df.withColumn(chunk, own), value, place, chunk, out, over)
    beyond = (k < reach) if fn == "following" else (k >= size - reach)
    copies = F.when(beyond, F.array(own, own + (-1 if fn == "following" else 1))).otherwise(F.array(own))
    df = df.select("*", F.explode(copies).alias(chunk)).withColumn(out, over([F.col(chunk)], [Key(place)]))
    return df.filter(F.col(chunk) == own).drop(place, chunk)


def _latest(df: DataFrame, value: Column, place: str, chunk: str, out: str, over) -> DataFrame:
    base, last = f"{out}_base", f"{out}_last"
    ends = df.groupBy(chunk).agg(F.max_by(value, F.when(value.isNotNull(), F.col(place))).alias(last))  # a row per chunk
    before = Window.partitionBy(F.lit(0)).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    starts = ends.select(F.col(chunk).alias(f"{chunk}_"), F.last(last, ignorenulls=True).over(before).alias(base))
    df = df.join(starts, F.col(chunk) == F.col(f"{chunk}_"), "left")
    return df.withColumn(out, F.coalesce(over([F.col(chunk)], [Key(place)]), F.col(base))).drop(place, chunk, f"{chunk}_", base)


def _by_ranges(df: DataFrame, fn: str, value: Column | None, keys: list[Key], out: str) -> DataFrame:
    part, base, value_col = f"{out}_part", f"{out}_base", f"{out}_value"
    df = df.withColumns({part: _range(df, keys[0]), **({value_col: value} if value is not None else {})})
    sums = df.groupBy(part).agg((F.sum(value_col) if value is not None else F.count(F.lit(1))).alias(base))
    before = Window.partitionBy(F.lit(0)).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    starts = sums.select(F.col(part).alias(f"{part}_"), F.sum(base).over(before).alias(base))
    inside = Window.partitionBy(part).orderBy(*(k.by for k in keys))
    df = df.join(F.broadcast(starts), F.col(part) == F.col(f"{part}_"), "left")
    if fn == "running_total":
        own = F.sum(value_col).over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow))
        # Missing until the first value, as in one window.
        result = F.when(own.isNull(), F.col(base)).otherwise(F.coalesce(F.col(base), F.lit(0)) + own)
    else:
        own = F.row_number().over(inside) if fn == "row_number" else F.rank().over(inside)
        result = (F.coalesce(F.col(base), F.lit(0)) + own).cast("bigint")
    return df.withColumn(out, result).drop(part, base, value_col, f"{part}_")
