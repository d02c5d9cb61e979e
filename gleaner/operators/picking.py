"""Picking in order: a text is picked unless an earlier picked one is similar, settled in rounds instead of one after another.

The picked texts are the lexicographically first independent set of the graph of similar texts. A group is settled by growing
prefixes of its order. Within a prefix, pairs of similar texts come from a join, and rounds settle them: texts without an earlier unsettled
similar one are picked, those similar to these go, and so on until no pair is left. What was picked is then joined to the rest of
the group, and what it takes leaves before the next, larger prefix is looked at. Prefixes thin out the rest, so
that few pairs are ever listed even where most texts of a group are similar to each other, and no large group meets in one task.
Small groups of ``greedy_distinct`` (SMALL) are shuffled once and walked by a task instead.

Similar texts meet by their rarest tokens (prefix filter): of two sets that share enough, the first tokens of both, in one order of all tokens from
the rarest on, share one. Texts with equal tokens are compared once, by the first of them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions.text import tokens
from gleaner.operators.stages import Stages

#: Fixed value: a word of a title, of four letters at least, Latin or Arabic.
TITLE_WORD = r"[a-zA-Z\u0600-\u06FF]{4,}"
#: The prefixes of each group's order, as shares of its rows.
SHARES = (1 / 16, 1 / 4, 1.0)
#: Rows and characters up to which a group is walked in one task.
SMALL = (4096, 4_000_000)


class Overlap:
    """Similar: so many tokens shared."""

    def __init__(self, least: int) -> None:
        self.least = least

    def prefix(self, size: Column) -> Column:
        return size - (self.least - 1)

    def near(self, shared: Column, a: Column, b: Column) -> Column:
        return shared >= self.least


class Jaccard:
    """Similar: so large a share of all tokens of both."""

    def __init__(self, least: float) -> None:
        self.least = least

    def prefix(self, size: Column) -> Column:
        # a token more than needed, for rounding
        return F.least(size, size - F.ceil(F.lit(self.least) * size).cast("int") + 2)

    def near(self, shared: Column, a: Column, b: Column) -> Column:
        return shared >= self.least * (a + b - shared)


def ranked_sets(df: DataFrame, group: list[str], place: str, text: str, pattern: str, least: int = 1) -> tuple[DataFrame, DataFrame]:
    """(g, place, words): the distinct sets of each group under their first place, tokens from the rarest on; and (g, place, first): each row's. g: the group as a struct, so null is a group like others."""
    sets = df.select(F.struct(*group).alias("g"), F.col(place).alias("place"), F.array_sort(tokens(F.col(text), pattern)).alias("set")).filter(F.size("set") >= least)
    distinct = sets.groupBy("g", "set").agg(F.min("place").alias("first"))
    token = distinct.select("g", "first", F.explode("set").alias("token"))
    rarity = token.groupBy("token").agg(F.count("*").alias("df"))
    words = token.join(rarity, "token").groupBy("g", "first").agg(F.transform(F.array_sort(F.collect_list(F.struct("df", "token"))), lambda x: x["token"]).alias("words"))
    return words.withColumnRenamed("first", "place"), sets.join(distinct, ["g", "set"]).select("g", "place", "first")


def _similar(early: DataFrame, late: DataFrame, how: Overlap | Jaccard) -> DataFrame:
    """(g, a, b): texts of early and of late that are similar, a before b; a pair may come more than once."""
    head = lambda: F.explode(F.slice("words", F.lit(1), F.greatest(how.prefix(F.size("words")), F.lit(0)))).alias("token")
    x = early.select("g", F.col("place").alias("a"), F.col("words").alias("wa"), head())
    y = late.select("g", F.col("place").alias("b"), F.col("words").alias("wb"), head())
    met = x.join(y, ["g", "token"]).filter("a < b")
    return met.filter(how.near(F.size(F.array_intersect("wa", "wb")), F.size("wa"), F.size("wb"))).select("g", "a", "b")


def settle(pairs: DataFrame, stages: Stages) -> DataFrame:
    """(g, b): the texts of pairs (g, a, b), a before b, that the first independent set leaves out."""
    gone = None
    while not pairs.isEmpty():
        picked = pairs.select("g", "a").distinct().join(pairs.select("g", F.col("b").alias("a")).distinct(), ["g", "a"], "left_anti")
        now = stages.put(pairs.join(picked, ["g", "a"], "left_semi").select("g", "b").distinct())
        left = pairs.join(now, ["g", "b"], "left_anti").join(now.withColumnRenamed("b", "a"), ["g", "a"], "left_anti")
        pairs = stages.put(left)
        gone = now if gone is None else gone.unionByName(now)
    return pairs.select("g", "b") if gone is None else gone


def picked(words: DataFrame, how: Overlap | Jaccard, shares: tuple[float, ...] = SHARES) -> DataFrame:
    """(g, place, seed) of the distinct texts that aren't picked: the first picked text that is similar to them.

    words: g, place (a number that orders the group), words (from the rarest token on).
    """
    stages = Stages(words.sparkSession)
    left, taken = stages.put(words), None
    bounds = stages.put(left.groupBy("g").agg(F.percentile_approx("place", F.array(*[F.lit(s) for s in shares]), 10_000).alias("bounds")))
    for i, share in enumerate(shares):
        last = i == len(shares) - 1
        bound = bounds.select("g", F.col("bounds")[i].alias("bound"))
        if last:
            batch, rest = left, left.limit(0)
        else:
            marked = left.join(bound, "g")
            batch, rest = (stages.put(marked.filter(c).drop("bound")) for c in ("place <= bound", "place > bound"))
        pairs = stages.put(_similar(batch, batch, how).distinct())
        gone = stages.put(settle(pairs, stages))
        seeds = batch.join(gone.withColumnRenamed("b", "place"), ["g", "place"], "left_anti")
        mine = pairs.join(gone, ["g", "b"], "left_semi").join(gone.withColumnRenamed("b", "a"), ["g", "a"], "left_anti")
        members = mine if last else mine.unionByName(_similar(seeds, rest, how))
        members = stages.put(members.groupBy("g", F.col("b").alias("place")).agg(F.min("a").alias("seed")))
        taken = members if taken is None else taken.unionByName(members)
        if not last:
            left = stages.put(rest.join(members, ["g", "place"], "left_anti"))
    return taken


def kept_in_order(sets: list[list[str]], threshold: float) -> list[bool]:
    """Of sets in order, which are kept: those whose Jaccard similarity with each one kept before is below the threshold. Equal sets count once; sets without tokens are kept.

    A set looks for similar ones by as many of its tokens as two similar sets must share one of; kept ones are listed under all of theirs.
    """
    held: dict[str, list[int]] = {}
    sizes: list[int] = []
    out = []
    for own in sets:
        n, near = len(own), dict[int, int]()
        needed = max(1, math.ceil(threshold * n))
        # the tokens with the fewest holders come first, so that common ones are read for known candidates only
        order = sorted(own, key=lambda w: len(held.get(w, ())))
        for at, w in enumerate(order):
            if at > n - needed + 1 and not near:
                break
            for i in held.get(w, ()):
                if at <= n - needed + 1 or i in near:
                    near[i] = near.get(i, 0) + 1
        ok = not any(shared >= threshold * (n + sizes[i] - shared) for i, shared in near.items())
        out.append(ok)
        if ok and n:
            for w in own:
                held.setdefault(w, []).append(len(sizes))
            sizes.append(n)
    return out


def _walked(df: DataFrame, group: list[str], order: str, text: str, pattern: str, threshold: float) -> DataFrame:
    """greedy_distinct of groups small enough for one task: a group's sets are shuffled once and walked in order."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "200")
    place = df.schema[order].dataType.simpleString()
    rows = df.select(F.struct(*group).alias("g"), F.struct(F.col(order).alias("place"), tokens(F.col(text), pattern).alias("set")).alias("x"))
    lists = rows.groupBy("g").agg(F.array_sort(F.collect_list("x")).alias("x"))
    lists = lists.select("g", F.transform("x", lambda x: x["place"]).alias("places"), F.transform("x", lambda x: x["set"]).alias("sets"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            g, places, sets = batch.columns
            kept = pa.array([kept_in_order(x, threshold) for x in sets.to_pylist()], pa.list_(pa.bool_()))
            yield pa.RecordBatch.from_arrays([g, places, kept], names=["g", "places", "kept"])

    walked = lists.mapInArrow(run, f"g {lists.schema['g'].dataType.simpleString()}, places array<{place}>, kept array<boolean>")
    return walked.select("g", F.explode(F.arrays_zip("places", "kept")).alias("x")).select("g.*", F.col("x.places").alias("place"), F.col("x.kept").alias("kept"))


def greedy_distinct(df: DataFrame, group: list[str], order: str, text: str, pattern: str, threshold: float, shares: tuple[float, ...] = SHARES, most: tuple[int, int] = SMALL) -> DataFrame:
    """(group, place, kept): in order, a text is kept unless its Jaccard similarity with one kept before reaches the threshold. Texts without tokens are kept.

    Groups of so many rows and characters at most are walked by one task each; larger ones are settled in rounds.
    """
    size = df.groupBy(*group).agg(F.count("*").alias("__n"), F.sum(F.length(text)).alias("__c"))
    large = Stages(df.sparkSession).put(size.filter((F.col("__n") > most[0]) | (F.col("__c") > most[1])).select(*group))
    if large.isEmpty():
        return _walked(df, group, order, text, pattern, threshold)
    same = [df[c].eqNullSafe(large[c]) for c in group]
    return _walked(df.join(large, same, "left_anti"), group, order, text, pattern, threshold).unionByName(_in_rounds(df.join(large, same, "left_semi"), group, order, text, pattern, threshold, shares))


def _in_rounds(df: DataFrame, group: list[str], order: str, text: str, pattern: str, threshold: float, shares: tuple[float, ...]) -> DataFrame:
    """greedy_distinct of groups of any size."""
    words, first = ranked_sets(df, group, order, text, pattern)
    lost = picked(words, Jaccard(threshold), shares).select("g", F.col("place").alias("first"), F.lit(False).alias("__kept"))
    judged = first.join(lost, ["g", "first"], "left").select("g.*", "place", (F.col("__kept").isNull() & (F.col("place") == F.col("first"))).alias("kept"))
    bare = df.filter(F.size(tokens(F.col(text), pattern)) == 0).select(*group, F.col(order).alias("place"), F.lit(True).alias("kept"))
    return judged.unionByName(bare)


def seed_clusters(df: DataFrame, group: list[str], order: str, text: str, pattern: str, shared: int = 3, shares: tuple[float, ...] = SHARES) -> DataFrame:
    """(group, place, cluster): in order, each text not yet taken seeds a cluster of the later free ones that share enough tokens with it; clusters of one are dropped."""
    words, first = ranked_sets(df, group, order, text, pattern, shared)
    taken = picked(words, Overlap(shared), shares).select("g", F.col("place").alias("first"), "seed")
    every = first.join(taken, ["g", "first"], "left").select("g", "place", F.coalesce("seed", "first").alias("cluster"))
    members = every.filter("place <> cluster").select("g", "cluster").distinct()
    return every.join(members, ["g", "cluster"], "left_semi").select("g.*", "place", "cluster")
