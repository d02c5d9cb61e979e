"""Time series keyed by (indicator, subject, source): latest readings, tails, patterns, changes and integrity."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions.numeric import is_monthly, percent_change, period_year
from gleaner.functions.rules import change_kind, direction, not_projection, verdict
from gleaner.operators.common import top_k

KEYS = ["indicator", "subject", "source"]


def latest_readings(measurements: DataFrame, registry: DataFrame | None = None, strict: bool = False) -> DataFrame:
    """Rows at the greatest period (as text) of their indicator, one per indicator (the smallest id of equals).

    As in the reference, projections take part in finding that period but aren't shown, so an indicator whose newest period
    is a projection has no row; ``strict`` leaves projections out beforehand.
    """
    shown = measurements.filter(not_projection(F.col("status")))
    newest = (shown if strict else measurements).groupBy("indicator").agg(F.max("period").alias("period"))
    rows = shown.join(newest, ["indicator", "period"])
    one = rows.groupBy("indicator").agg(F.min_by(F.struct("measurement_id", "subject", "source", "period", "value"), "measurement_id").alias("m")).select("indicator", "m.*")
    if registry is None:
        return one
    return one.join(F.broadcast(registry.select("indicator", "label", "metric_kind", "polarity")), "indicator", "left")


def tail(measurements: DataFrame, n: int, keys: list[str] | None = None) -> DataFrame:
    """The last n periods of each series."""
    return top_k(measurements, keys or KEYS, [F.desc("period"), F.asc("measurement_id")], n)


def patterns(measurements: DataFrame, monotone: bool = True) -> DataFrame:
    """Per annual series: points, first, last, pct_change and direction.

    Two definitions of direction exist: by monotone steps (constant counts as increasing), or by end points.
    """
    annual = measurements.filter(~is_monthly(F.col("period")))
    w = Window.partitionBy(*KEYS).orderBy("period")
    steps = annual.withColumn("step", F.col("value") - F.lag("value").over(w))
    out = steps.groupBy(*KEYS).agg(
        F.count("*").alias("points"), F.min_by("value", "period").alias("first_value"), F.max_by("value", "period").alias("last_value"),
        F.coalesce(F.bool_and(F.col("step") >= 0), F.lit(True)).alias("rising"), F.coalesce(F.bool_and(F.col("step") <= 0), F.lit(True)).alias("falling"),
    )
    first, last = F.col("first_value"), F.col("last_value")
    by_steps = F.when(F.col("rising"), "increasing").when(F.col("falling"), "decreasing").otherwise("mixed")
    by_ends = F.when(last > first, "increasing").when(last < first, "decreasing").otherwise("flat")
    return out.filter("points >= 2").select(*KEYS, "points", "first_value", "last_value", percent_change(first, last).alias("pct_change"), (by_steps if monotone else by_ends).alias("direction"))


def span_top(measurements: DataFrame, least: int = 8, k: int = 3) -> DataFrame:
    """Per subject, the k series with the greatest relative span of their ends, of those with enough points and different ends."""
    ends = measurements.groupBy(*KEYS).agg(F.count("*").alias("points"), F.min_by("value", "period").alias("a"), F.max_by("value", "period").alias("b"))
    span = F.round(F.abs(F.col("b") - F.col("a")) / F.greatest(F.abs("a"), F.lit(1e-9)), 6)
    ends = ends.filter((F.col("points") >= least) & (F.col("a") != F.col("b"))).withColumn("span", span)
    return top_k(ends, ["subject"], [F.desc("span"), F.asc("indicator"), F.asc("source")], k, "place").select(*KEYS, "points", "span", "place")


def movements(measurements: DataFrame, least: int = 6) -> DataFrame:
    """Annual series by the size of their change, of those with enough points and a base."""
    annual = measurements.filter(~is_monthly(F.col("period")) & not_projection(F.col("status")))
    ends = annual.groupBy(*KEYS).agg(F.count("*").alias("points"), F.min_by("value", "period").alias("a"), F.max_by("value", "period").alias("b"))
    change = F.round(F.try_divide(F.col("b") - F.col("a"), F.col("a")) * 100, 1)
    return ends.filter((F.col("points") >= least) & (F.col("a") != 0)).select(*KEYS, "points", change.alias("pct"))


def pairwise_changes(measurements: DataFrame) -> DataFrame:
    """Percent changes between all pairs of a series' annual points, earlier to later, within the series' own array."""
    annual = measurements.filter(~is_monthly(F.col("period")))
    series = annual.groupBy(*KEYS).agg(F.array_sort(F.collect_list(F.struct("period", "value"))).alias("p"))
    one = series.select(*KEYS, "p", F.posexplode("p").alias("i", "a"))
    pair = one.select(*KEYS, "a", F.explode(F.slice("p", F.col("i") + 2, F.greatest(F.size("p"), F.lit(1)))).alias("b"))
    a, b = F.col("a.value"), F.col("b.value")
    return pair.filter((a != 0) & (a != b)).select(*KEYS, F.col("a.period").alias("from_period"), F.col("b.period").alias("to_period"), F.round((b - a) / F.abs(a) * 100, 1).alias("pct"))


def series_table(measurements: DataFrame) -> DataFrame:
    """A series as one row: its points as text, in order, its last status and how many are provisional."""
    point = F.concat(F.col("period"), F.lit("="), F.col("value").cast("decimal(38,2)").cast("string"))
    return measurements.groupBy("indicator", "subject").agg(
        F.array_join(F.array_sort(F.collect_list(F.concat_ws(" ", point, "source"))), "; ").alias("points"),
        F.count("*").alias("n_points"), F.count_if("provisional").alias("n_provisional"), F.max_by("status", F.struct("period", "measurement_id")).alias("last_status"),
    )


def temporal_facts(measurements: DataFrame, this_year: int) -> DataFrame:
    """Per series: span of years, whether monthly, whether its newest annual period is a projection, and whether it is stale."""
    year = period_year(F.col("period"))
    newest = F.max("period")
    out = measurements.groupBy(*KEYS).agg(F.min(year).alias("first_year"), F.max(year).alias("last_year"), F.bool_or(is_monthly(F.col("period"))).alias("monthly"), newest.alias("newest"))
    last = F.col("last_year")
    said = F.concat_ws("; ", F.when((last >= this_year) & ~F.col("monthly"), "projection"), F.when(last <= this_year - 2, F.concat(F.lit("latest is "), last.cast("string"))), F.when(F.col("monthly"), "monthly"))
    return out.select(*KEYS, "first_year", "last_year", "monthly", "newest", (last <= this_year - 2).alias("stale"), said.alias("facts"))


def coverage(measurements: DataFrame, registry: DataFrame) -> DataFrame:
    """Per indicator: rows, years, bounds, distinct subjects and their names; and whether it is registered."""
    year = period_year(F.col("period"))
    out = measurements.groupBy("indicator").agg(
        F.count("*").alias("n_rows"), F.countDistinct(year).alias("years"), F.min("period").alias("lo"), F.max("period").alias("hi"),
        F.countDistinct("subject").alias("subjects"), F.array_join(F.array_sort(F.collect_set("subject")), ",").alias("names"),
    )
    return out.join(F.broadcast(registry.select("indicator", F.lit(True).alias("r"))), "indicator", "left").withColumn("registered", F.coalesce("r", F.lit(False))).drop("r")


def short_series(measurements: DataFrame, most: int = 2) -> DataFrame:
    """Series of so few distinct periods that they are snapshots only."""
    return measurements.groupBy(*KEYS).agg(F.countDistinct("period").alias("periods")).filter(F.col("periods") <= most)


def integrity(measurements: DataFrame, subject: str, least: int = 3) -> DataFrame:
    """Series that fail: several subjects or another one under an indicator and source, or too few periods. Empty: passed."""
    out = measurements.groupBy("indicator", "source").agg(F.countDistinct("subject").alias("subjects"), F.min("subject").alias("a"), F.countDistinct("period").alias("periods"))
    return out.filter((F.col("subjects") != 1) | (F.col("a") != subject) | (F.col("periods") < least)).select("indicator", "source", "subjects", "periods")


def snapshot_changes(snapshots: DataFrame, registry: DataFrame) -> DataFrame:
    """Each problem's newest snapshot against its previous one: new, changed or noise, direction and verdict."""
    problem = ["problem_id"]
    days = snapshots.select(*problem, "taken_at").distinct()
    newest = top_k(days, problem, [F.desc("taken_at")], 2, "n")
    at = newest.groupBy(*problem).agg(F.max(F.when(F.col("n") == 1, F.col("taken_at"))).alias("now"), F.max(F.when(F.col("n") == 2, F.col("taken_at"))).alias("before"))
    rows = snapshots.join(at, problem)
    now = rows.filter("taken_at = now").select(*problem, "indicator", "value", "now", "before")
    old = rows.filter("taken_at = before").select(*problem, "indicator", F.col("value").alias("prev"))
    out = now.join(old, [*problem, "indicator"], "left").join(F.broadcast(registry), "indicator", "left")
    moved = direction(F.col("prev"), F.col("value"))
    return out.select(
        *problem, "indicator", "now", "before", "prev", "value", F.round(F.col("value") - F.col("prev"), 4).alias("delta"),
        F.when(F.col("prev").isNull(), "new").otherwise(change_kind(F.col("metric_kind"), F.col("prev"), F.col("value"))).alias("status"),
        F.when(F.col("prev").isNotNull(), moved).alias("direction"), F.when(F.col("prev").isNotNull(), verdict(moved, F.col("polarity"))).alias("verdict"),
    )


def snapshot_report(snapshots: DataFrame) -> DataFrame:
    return snapshots.groupBy("problem_id").agg(F.countDistinct("taken_at").alias("snapshots"), F.count("*").alias("readings"), F.max("taken_at").alias("newest"))


def supersede(old: DataFrame, new: DataFrame, keys: list[str], tolerance: float = 1e-9) -> tuple[DataFrame, DataFrame]:
    """Provisional rows of old met by new values: the new table, and a log of values that changed.

    A new value equal within tolerance clears the flag; another one replaces the value and is logged.
    """
    n = new.select(*keys, F.col("value").alias("__new"))
    joined = old.join(n, keys, "left")
    hit = F.col("provisional") & F.col("__new").isNotNull()
    table = joined.select(*[F.when(hit, F.col("__new")).otherwise(F.col("value")).alias("value") if c == "value" else (F.col("provisional") & ~hit).alias(c) if c == "provisional" else F.col(c) for c in old.columns])
    log = joined.filter(hit & (F.abs(F.col("__new") - F.col("value")) > tolerance)).select(*keys, F.col("value").alias("old_value"), F.col("__new").alias("new_value"))
    return table, log


def macro_rows(rows: DataFrame, existing: DataFrame, low: int = 1990, high: int = 2031) -> DataFrame:
    """New macro readings in the allowed years with their status by year, existing (indicator, period) skipped."""
    year = period_year(F.col("period"))
    status = F.when(year >= 2026, "projection").when(year == 2025, "estimate").otherwise("raw")
    kept = rows.filter(year.between(low, high)).withColumn("status", status)
    return kept.join(existing.select("indicator", "period").distinct(), ["indicator", "period"], "left_anti")





#: Words of an indicator's name that make it a rate.
RATE_WORDS = ["%", "rate", "growth", "inflation", "share"]


def temporal_summary(measurements: DataFrame, registry: DataFrame, this_year: int) -> DataFrame:
    """(series, summary): window, direction by its ends, net change (for rates the ends instead), latest value, newest observed year, and what to be careful about, joined by "; ".

    A bare year from this one on is a projection; a month of this year is an observation.
    """
    year, value, period = period_year(F.col("period")), F.col("value"), F.col("period")
    projected = F.coalesce((year > this_year) | ((year == this_year) & (F.length("period") == 4)), F.lit(False))
    g = measurements.groupBy(*KEYS).agg(
        F.min_by(F.struct("period", "value"), "period").alias("a"), F.max_by(F.struct("period", "value"), "period").alias("b"), F.count_if(projected).alias("n"), F.max(F.when(~projected, year)).alias("actual")
    )
    g = g.join(F.broadcast(registry.select("indicator", "label", "unit")), "indicator", "left")
    name = F.lower(F.concat_ws(" ", F.coalesce("label", "indicator"), F.col("unit")))
    rate = F.lit(False)
    for w in RATE_WORDS:
        rate = rate | name.contains(w)
    a, b = F.col("a.value"), F.col("b.value")
    pct = percent_change(a, b)
    shown = lambda c: F.format_number(c, 1)
    change = F.when(rate, F.concat(F.lit("moved from "), shown(a), F.lit(" ("), F.col("a.period"), F.lit(") to "), shown(b), F.lit(" ("), F.col("b.period"), F.lit(")"))).otherwise(
        F.concat(F.lit("net change "), F.when(pct >= 0, "+").otherwise("-"), F.abs(pct).cast("decimal(38,1)").cast("string"), F.lit("%"))
    )
    text = lambda c: F.col(c).cast("string")
    age = this_year - F.col("actual")
    parts = [
        F.concat(F.lit("window "), F.col("a.period"), F.lit("-"), F.col("b.period")), F.concat(F.when(b > a, "increasing").when(b < a, "decreasing").otherwise("flat"), F.lit(" overall")), change,
        F.concat(F.lit("latest value "), shown(b), F.lit(" ("), F.col("b.period"), F.lit(")")), F.coalesce(F.concat(F.lit("latest observed year: "), text("actual")), F.lit("no observed data")),
        F.when(F.col("n") > 0, F.concat(F.lit("WARNING: "), text("n"), F.lit(f" point(s) from {this_year} on are projections"))),
        F.when(age >= 2, F.concat(F.lit("STALENESS: newest observation is "), age.cast("string"), F.lit(" years old"))).when(age <= 1, "NOTE: the newest values are often preliminary"),
    ]
    return g.select(*KEYS, F.concat_ws("; ", *parts).alias("summary"))
