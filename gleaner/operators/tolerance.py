"""Joins of figures within a tolerance, the larger of an absolute and a relative one, as equi-joins on bands.

A number looks for values g with |g - v| <= max(ABSOLUTE, RELATIVE * |v|). Small numbers meet values in linear bands, large ones in
logarithmic bands of each sign; which of both a number uses depends on it alone, so a pair meets once. Bands are a trifle wider than the tolerance, so a match is at
most one band away.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the rule: the tolerances. From TURN on the relative one is the larger.
ABSOLUTE, RELATIVE = 0.15, 0.005
TURN = ABSOLUTE / RELATIVE
_LINEAR, _LOG = ABSOLUTE * (1 + 1e-6), -math.log1p(-RELATIVE) * (1 + 1e-6)


def within(value: Column, number: Column) -> Column:
    return F.abs(value - number) <= F.greatest(F.lit(ABSOLUTE), F.abs(number) * RELATIVE)


def _linear(x: Column) -> Column:
    return F.struct(F.lit("linear").alias("kind"), F.floor(x / _LINEAR).alias("band"))


def _log(x: Column) -> Column:
    return F.struct(F.when(x < 0, "below").otherwise("above").alias("kind"), F.floor(F.ln(F.abs(x)) / _LOG).alias("band"))


def value_bands(values: DataFrame, value: str) -> DataFrame:
    """values with at: a row for each way a number may look for the value, by linear or logarithmic bands; nulls, NaN and infinities go."""
    x = F.col(value)
    small, large = F.abs(x) <= 2 * TURN, F.abs(x) >= TURN / 2
    usable = values.filter(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return usable.withColumn("at", F.explode(F.filter(F.array(F.when(small, _linear(x)), F.when(large, _log(x))), lambda b: b.isNotNull())))


def _bands(x: Column) -> Column:
    """The three bands in which a number's matches may be; none for nulls, NaN and infinities."""
    own = F.when(F.abs(x) <= TURN, _linear(x)).otherwise(_log(x))
    near = F.transform(F.array(*[F.lit(d) for d in (-1, 0, 1)]), lambda d: F.struct(own["kind"].alias("kind"), (own["band"] + d).alias("band")))
    return F.when(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")), near)


def own_band(number: Column) -> Column:
    """The band a number stands in; null for nulls, NaN and infinities. It meets its matches there, if values have a row for each band that they reach."""
    return F.when(number.isNotNull() & ~F.isnan(number) & (F.abs(number) < float("inf")), F.when(F.abs(number) <= TURN, _linear(number)).otherwise(_log(number)))


def reached(values: DataFrame, value: str) -> DataFrame:
    """values with at: a row for each band whose own numbers may match the value."""
    near = F.transform(F.array(*[F.lit(d) for d in (-1, 0, 1)]), lambda d: F.struct(F.col("at.kind").alias("kind"), (F.col("at.band") + d).alias("band")))
    return value_bands(values, value).withColumn("at", F.explode(near))


def number_bands(numbers: DataFrame, number: str) -> DataFrame:
    """numbers with at: a row for each band in which a match may be."""
    return numbers.withColumn("at", F.explode(_bands(F.col(number))))


def matches(numbers: DataFrame, values: DataFrame, keys: list[str], number: str, value: str) -> DataFrame:
    """numbers, each one to three times, with hit: whether a value of the same keys in one of its bands matches, and once: true for one row of each. A number matches if any of its rows is a hit.

    Of each band just the least and the largest value count: a band below is best met by its largest, one above by its least. In a number's own band the least can miss only if the
    number stands at the band's upper edge, and then the largest is next to it or nothing matches. So a number meets three rows at most, however many values its key has.
    """
    ends = value_bands(values, value).groupBy(*keys, "at").agg(F.min(value).alias("__low"), F.max(value).alias("__high"))
    met = numbers.select("*", F.posexplode_outer(_bands(F.col(number))).alias("__d", "at")).join(ends, [*keys, "at"], "left")
    hit = within(F.col("__low"), F.col(number)) | within(F.col("__high"), F.col(number))
    return met.withColumns({"hit": F.coalesce(hit, F.lit(False)), "once": F.coalesce(F.col("__d") == 0, F.lit(True))}).drop("at", "__d", "__low", "__high")


def pairs(numbers: DataFrame, values: DataFrame, keys: list[str], number: str, value: str) -> DataFrame:
    """numbers joined with all values of the same keys that match, each pair once."""
    met = number_bands(numbers, number).join(value_bands(values, value), [*keys, "at"])
    return met.filter(within(F.col(value), F.col(number))).drop("at")
