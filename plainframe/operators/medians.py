"""Exact medians of large tables without a group's values in one buffer.

Spark's own median keeps a count for every distinct value of a group in memory. Here two approximate
quantiles of each group, just under and just over its middle, come from bounded sketches; then only
the values between them are counted one by one, with partial sums on the map side, and the middle ones are
found by their places. The values under the lower cut count as one. A few in ten thousand of a
group's values are left to sort, and a sort spills.
"""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame, Window, functions as F

#: The cuts' shares of a group, and the sketch's accuracy: its ranks err by one in so many, half of the cuts' distance from the middle.
CUTS, ACCURACY = (0.4998, 0.5002), 10_000


def medians(df: DataFrame, by: list[str], value: Column, out: str) -> DataFrame:
    """A row for each group of by that has a value: its keys as <out>_0, <out>_1, ..., and the median as out."""
    keys = [f"{out}_{i}" for i in range(len(by))]
    v, n, low, high, many = (f"{out}_{x}" for x in ("v", "n", "low", "high", "many"))
    rows = df.select(*(F.col(b).alias(k) for b, k in zip(by, keys)), value.cast("double").alias(v)).filter(F.col(v).isNotNull())
    sketch = F.percentile_approx(v, list(CUTS), ACCURACY)
    cuts = rows.groupBy(*keys).agg(F.count(v).alias(n), sketch.alias(low)).select(*(F.col(k).alias(f"{k}_") for k in keys), n, F.get(low, F.lit(0)).alias(low), F.get(low, F.lit(1)).alias(high))
    on = functools.reduce(operator.and_, [F.col(k).eqNullSafe(F.col(f"{k}_")) for k in keys], F.lit(True))
    cut = rows.join(cuts if keys else F.broadcast(cuts), on)  # without keys a single row
    value_ = F.when(F.col(v) >= F.col(low), F.col(v)).alias(v)
    counted = cut.filter(F.col(v) <= F.col(high)).groupBy(*keys, value_).agg(F.count(F.lit(1)).alias(many), F.first(n).alias(n))
    upto = Window.partitionBy(*keys).orderBy(F.col(v).asc_nulls_first()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = counted.withColumn(many, F.sum(many).over(upto))
    at = lambda rank: F.min(F.when(F.col(many) >= rank, F.col(v)))
    first, second = F.floor((F.col(n) + 1) / 2), F.floor(F.col(n) / 2) + 1
    under = F.coalesce(F.max(F.when(F.col(v).isNull(), F.col(many) - first)), F.lit(-1))
    found = placed.groupBy(*keys).agg(at(first).alias(low), at(second).alias(high), under.alias(n))
    sound = F.when((F.col(n) < 0) & F.col(high).isNotNull(), (F.col(low) + F.col(high)) / 2).otherwise(F.raise_error(F.lit("a median lies outside its cuts")).cast("double"))
    return found.select(*keys, sound.alias(out))
