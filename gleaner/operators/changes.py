"""Percent changes of series, looked up instead of listed.

A draft may name the change between any two points of a series. Listing them takes the square of a series' length; here a series of over SHORT points is walked once from its
end with its later values kept sorted, and for each number of the draft and each point the value it would have to be followed by is looked up by
bisection: n log n for each number. The changes of a shorter one are few and sorted at once. Of all changes only the nearest on either side of a number can match it, as rounding keeps order, so two per number and series
come out and are judged as a listed change would be.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.functions.numeric import rounded, significant
from gleaner.operators import tolerance
from gleaner.operators.stages import Stages, broadcast_if_few
from gleaner.operators.verify import bare, owned_sets

#: Into so many parts a key's numbers are dealt, so that no row holds all of a large draft's.
PARTS = 16
#: Points of a series up to which its changes are sorted at once.
SHORT = 64


def nearest_changes(values: list[float | None], wanted: list[float]) -> list[tuple[float | None, float | None]]:
    """For each wanted percentage the largest change at or below it and the least at or above it, of changes from a value to a later, different one; changes from zero don't count."""
    if len(values) <= SHORT:
        points = np.array([v for v in values if v is not None and v == v], np.float64)
        i, j = np.triu_indices(len(points), 1)
        a, b = points[i], points[j]
        use = (a != 0) & (a != b)
        c = np.sort((b[use] - a[use]) / np.abs(a[use]) * 100)
        low, high = np.searchsorted(c, wanted, "right") - 1, np.searchsorted(c, wanted, "left")
        return [(float(c[x]) if x >= 0 else None, float(c[y]) if y < len(c) else None) for x, y in zip(low.tolist(), high.tolist(), strict=True)]
    below: list[float | None] = [None] * len(wanted)
    above: list[float | None] = [None] * len(wanted)
    later: list[float] = []
    for a in reversed(values):
        if a is None or a != a:
            continue
        if a != 0 and later:
            for i, p in enumerate(wanted):
                target = a + abs(a) * p / 100
                # a little around the target, so that the rounding of the division can't hide a neighbour
                for j in range(bisect_left(later, target) - 2, bisect_right(later, target) + 2):
                    b = _other(later, j, a, -1 if j < bisect_left(later, target) else 1)
                    if b is None:
                        continue
                    c = (b - a) / abs(a) * 100
                    if c <= p and (below[i] is None or c > below[i]):
                        below[i] = c
                    if c >= p and (above[i] is None or c < above[i]):
                        above[i] = c
        insort(later, a)
    return list(zip(below, above, strict=True))


def _other(later: list[float], at: int, a: float, way: int) -> float | None:
    """The value at a place of the sorted list, or, where that is a itself, the next different one that way."""
    if not 0 <= at < len(later):
        return None
    if later[at] != a:
        return later[at]
    at = bisect_left(later, a) - 1 if way < 0 else bisect_right(later, a)
    return later[at] if 0 <= at < len(later) else None


def bound_changes(numbers: DataFrame, series: DataFrame, key: str) -> DataFrame:
    """(key, number, evidence_id): numbers (as text) of a draft and the series of their key that have a change which matches them, within rounding.

    series: key, evidence_id, period, value, one row per point. A change counts with four significant digits, two decimals or one.
    """
    asked = numbers.select(key, "number").distinct().withColumn("v", bare(F.col("number")).try_cast("double")).filter(F.col("v").isNotNull() & ~F.isnan("v"))
    dealt = asked.groupBy(key, F.pmod(F.xxhash64("number"), F.lit(PARTS)).alias("part")).agg(F.collect_list(F.struct("number", "v")).alias("asked"))
    whole = series.groupBy(key, "evidence_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("period", "value"))), lambda p: p["value"]).alias("points"))
    both = whole.join(dealt, key).select(key, "evidence_id", "points", F.col("asked.number").alias("numbers"), F.col("asked.v").alias("wanted"))
    kinds = {f.name: f.dataType.simpleString() for f in both.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for k, e, points, said, wanted in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for number, v, ends in zip(said, wanted, nearest_changes(points, wanted), strict=True):
                    # as near as rounding can bring a change to the number
                    most = max(tolerance.ABSOLUTE, abs(v) * tolerance.RELATIVE) + 0.06
                    rows += [(k, e, number, v, c) for c in ends if c is not None and abs(c - v) <= most + abs(c) * 1e-3]
            columns = list(zip(*rows, strict=True)) or [()] * 5
            types = (batch.schema.field(0).type, batch.schema.field(1).type, pa.string(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[key, "evidence_id", "number", "v", "change"])

    near = both.mapInArrow(run, f"`{key}` {kinds[key]}, evidence_id {kinds['evidence_id']}, number string, v double, change double")
    change = F.col("change")
    shown = F.array(significant(change, 4).try_cast("double"), rounded(change, 2).cast("decimal(38,2)").cast("double"), rounded(change, 1).cast("decimal(38,1)").cast("double"))
    return near.filter(F.exists(shown, lambda c: tolerance.within(c, F.col("v")))).select(key, "number", "evidence_id").distinct()


def bound_changes_shared(numbers: DataFrame, series: DataFrame, owners: DataFrame, key: str, group: str) -> DataFrame:
    """As bound_changes, where series belong to groups that many keys share (owners: key, group): a number is looked up once for all keys of a group that name it."""
    stages = Stages(numbers.sparkSession)
    sets = owned_sets(owners, key, group)
    wanted = numbers.select(key, "number").join(sets, key).select("sets", "number").distinct()
    found = bound_changes(wanted.select(F.explode("sets").alias(group), "number").distinct(), series, group)
    each = sets.select("sets").distinct().select("sets", F.explode("sets").alias(group)).join(found, group)
    ids = stages.put(each.groupBy("sets", "number").agg(F.collect_set("evidence_id").alias("ids")))
    # numbers and groups meet by key, so that numbers are shuffled once
    asked = numbers.select(key, "number").repartition(F.col(key)).distinct().join(sets, key)
    return asked.join(broadcast_if_few(ids), ["sets", "number"]).select(key, "number", F.explode("ids").alias("evidence_id"))
