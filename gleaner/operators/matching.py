"""Text similarity and matching: token overlaps as joins."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions.text import tokens
from gleaner.operators.common import top_k
from gleaner.operators.stages import Stages, broadcast_if_few

#: Buckets by which jaccard_pairs ranks tokens, two bytes each, and the 64-bit words of a set's sketch.
BUCKETS, SKETCH = 1 << 22, 8
#: Pairs to be compared as whole sets, ids only, that are broadcast at most.
MOST_NEAR = 500_000


def overlaps(left: DataFrame, right: DataFrame, left_id: str, right_id: str, text: str, pattern: str, least: int) -> DataFrame:
    """(left_id, right_id, shared): pairs that share at least so many distinct tokens.

    Texts that have the same tokens are compared once, under the smallest id, and ids joined back. Sets meet by their rarest tokens: of two sets that share least tokens,
    all but the least - 1 most frequent ones of either hold one that is shared, so frequent tokens make no pairs. Sets travel with their rare tokens, so each pair is judged where it is met.
    """

    def distinct(df: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
        sets = df.select(F.col(key).alias("id"), F.array_sort(tokens(F.col(text), pattern)).alias("set")).filter(F.size("set") >= least)
        one = sets.groupBy("set").agg(F.min("id").alias("rep"))
        return one, sets.join(one, "set").select("rep", "id")

    (one, members), (other, others) = distinct(left, left_id), distinct(right, right_id)
    token = one.select("rep", F.explode("set").alias("token"))
    rarity = other.select(F.explode("set").alias("token")).groupBy("token").agg(F.count("*").alias("df"))

    def prefix(df: DataFrame) -> DataFrame:
        # tokens that no set of the other side has can't be shared
        known = df.join(rarity, "token").groupBy("rep").agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("order")).filter(F.size("order") >= least)
        words = F.transform("order", lambda x: x["token"])
        return known.select("rep", words.alias("set"), F.explode(F.slice(words, F.lit(1), F.size("order") - (least - 1))).alias("token"))

    a = prefix(token)
    b = prefix(other.select("rep", F.explode("set").alias("token"))).select(F.col("rep").alias("with"), F.col("set").alias("y"), "token")
    met = a.join(b, "token").select("rep", "with", F.size(F.array_intersect("set", "y")).cast("long").alias("shared")).filter(F.col("shared") >= least).distinct()
    return met.join(members.withColumnRenamed("id", left_id), "rep").join(others.select(F.col("rep").alias("with"), F.col("id").alias(right_id)), "with").select(left_id, right_id, "shared")


def _prefixes(sets: DataFrame, block: list[str], threshold: float) -> DataFrame:
    """(block, rep, size, alone, at, token, s0...): the rarest tokens of each set (block, rep, set) that pairs may meet by, with their places, and the set's sketch.

    Tokens go by hashes and are ordered by how many sets hold one of their bucket, so that no token is shuffled to be ranked; the table of buckets has a fixed size, whatever the vocabulary.
    Any order does, and hashes that collide only add candidates. A sketch holds the parity of the tokens in each of 64 * SKETCH places; tokens of one set alone (alone) aren't in it, and come first.
    """
    hashed = sets.select(*block, "rep", F.transform("set", lambda x: F.xxhash64(x)).alias("h"))
    bucket = hashed.select(F.explode("h").alias("h")).groupBy(F.col("h").bitwiseAND(BUCKETS - 1).cast("int").alias("bucket")).agg(F.least(F.count("*"), F.lit(65535)).cast("int").alias("n")).filter("n > 1").toArrow()
    held = np.ones(BUCKETS, np.uint16)
    held[bucket["bucket"].to_numpy()] = bucket["n"].to_numpy()

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        lists = batch.column("h")
        size = lists.value_lengths().to_numpy()
        h, row = lists.flatten().to_numpy(), np.repeat(np.arange(len(size)), size)
        n = held[h & (BUCKETS - 1)]
        order = np.lexsort((h, n, row))
        h, n, row = h[order], n[order], row[order]
        some = n > 1
        alone = size - np.bincount(row[some], minlength=len(size))
        place = (h[some] >> 32) & (64 * SKETCH - 1)
        parity = (np.bincount(row[some] * 64 * SKETCH + place, minlength=len(size) * 64 * SKETCH) & 1).astype(bool)
        sketch = np.packbits(parity).view(np.int64).reshape(len(size), SKETCH)
        at = np.arange(len(h)) - np.repeat(np.cumsum(size) - size, size)
        # loose for rounding
        kept = some & (at < (size - np.ceil(threshold * size - 1e-6) + 1)[row])
        row = row[kept]
        named = batch.select([*block, "rep"]).take(pa.array(row))
        columns = [*named.columns, *(pa.array(x, pa.int32()) for x in (size[row], alone[row], at[kept])), pa.array(h[kept], pa.int64()), *(pa.array(sketch[row, i]) for i in range(SKETCH))]
        return pa.RecordBatch.from_arrays(columns, names=names)

    def cut_all(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                yield cut(batch.slice(start, 256))

    names = [*block, "rep", "size", "alone", "at", "token", *[f"s{i}" for i in range(SKETCH)]]
    given = hashed.select(*block, "rep").schema
    for name in names[len(given) :]:
        given = given.add(name, "integer" if name in ("size", "alone", "at") else "long")
    return hashed.mapInArrow(cut_all, given)


def jaccard_pairs(df: DataFrame, key: str, text: str, pattern: str, threshold: float, block: list[str] | None = None) -> DataFrame:
    """(a, b, jaccard) of pairs a < b at or above the threshold, exact.

    Prefix filter: pairs at the threshold must share one of their rarest tokens, as many as size - ceil(t * size) + 1, so
    only those are joined on, and only where the tokens before and behind the shared one on both sides can make up the overlap
    (positional filter) and where sketches of the whole sets differ in no more places than the sets may. A pair's shared rare tokens are then counted, and only pairs that can reach the threshold
    with those and what follows both prefixes are compared as whole sets. Equal token sets are compared once, by
    their smallest key, and spread out at the end. The sets are a table in the shared folder, so that texts are cut into tokens once.
    """
    block, stages = block or [], Stages(df.sparkSession)
    sets = stages.put(df.select(key, *block, F.array_sort(tokens(F.col(text), pattern)).alias("set")).filter(F.size("set") > 0).withColumn("same", F.sha2(F.to_json("set"), 256)))
    shared = stages.put(sets.groupBy(*block, "same").agg(F.min(key).alias("rep"), F.first("set").alias("set")))
    prefix = _prefixes(shared, block, threshold)
    # both sides are the same columns under two names, so that they are shuffled once
    here, there = (lambda c, side=side: F.col(f"{side}.{c}") for side in ("x", "y"))
    both = prefix.alias("x").join(prefix.alias("y"), [*block, "token"])
    fits = (here("size") >= threshold * there("size")) & (there("size") >= threshold * here("size"))
    # what both must share; the bounds are kept a little loose for rounding
    least = lambda size, other: F.lit(threshold / (1 + threshold)) * (size + other) - 1e-6
    needed = least(here("size"), there("size"))
    fits = fits & (F.least(here("at"), there("at")) + F.least(here("size") - here("at"), there("size") - there("at")) >= needed)
    # tokens that one of both lacks are alone, or turn one bit of the sketch or turn it back: at least so many are different
    apart = sum((F.bit_count(here(f"s{i}").bitwiseXOR(there(f"s{i}"))) for i in range(SKETCH)), here("alone") + there("alone"))
    fits = (here("rep") < there("rep")) & fits & (apart <= here("size") + there("size") - 2 * needed)
    met = both.filter(fits).select(*block, here("rep").alias("rep"), there("rep").alias("other"), here("size").alias("size"), there("size").alias("other_size"), here("at").alias("at"), there("at").alias("other_at"))
    met = met.groupBy(*block, "rep", "other", "size", "other_size").agg(F.count("*").alias("n"), F.max("at").alias("at"), F.max("other_at").alias("other_at"))
    # up to the last shared token of both prefixes n are shared; behind it that side has none in its prefix whose prefix ends first
    end = lambda size: F.col(size) - F.ceil(F.lit(threshold) * F.col(size) - 1e-6) + 1
    first, second = F.least(F.col("size") - end("size"), F.col("other_size") - F.col("other_at") - 1), F.least(F.col("size") - F.col("at") - 1, F.col("other_size") - end("other_size"))
    # few as a rule: then sets needn't be shuffled to meet them
    near = broadcast_if_few(stages.put(met.filter(F.col("n") + F.greatest(first, second) >= least(F.col("size"), F.col("other_size"))).select(*block, "rep", "other")), MOST_NEAR)
    own = lambda n, s: shared.select(*block, F.col("rep").alias(n), F.col("set").alias(s))
    judged = near.join(own("rep", "x"), [*block, "rep"]).join(own("other", "y"), [*block, "other"])
    both = F.size(F.array_intersect("x", "y"))
    judged = judged.withColumn("jaccard", both / (F.size("x") + F.size("y") - both)).filter(F.col("jaccard") >= threshold).select(*block, F.col("rep").alias("r1"), F.col("other").alias("r2"), "jaccard")
    same = shared.select(*block, F.col("rep").alias("r1"), F.col("rep").alias("r2"), F.lit(1.0).alias("jaccard"))
    member = sets.select(*block, key, "same").join(shared.select(*block, "same", "rep"), [*block, "same"]).select(*block, key, "rep")
    first = member.select(*block, F.col(key).alias("k1"), F.col("rep").alias("r1"))
    second = member.select(*block, F.col(key).alias("k2"), F.col("rep").alias("r2"))
    out = judged.unionByName(same).join(first, [*block, "r1"]).join(second, [*block, "r2"])
    a, b = F.least("k1", "k2"), F.greatest("k1", "k2")
    return out.filter("r1 <> r2 OR k1 < k2").select(*block, a.alias("a"), b.alias("b"), "jaccard")


def contained(new: DataFrame, old: DataFrame, new_id: str, old_id: str, text: str, pattern: str, more_than: float) -> DataFrame:
    """(new_id, old_id, share): texts of which more than that share of tokens is in an old text. Not symmetric."""
    size = new.select(new_id, F.size(tokens(F.col(text), pattern)).alias("size"))
    shared = overlaps(new, old, new_id, old_id, text, pattern, 1).join(size, new_id)
    return shared.withColumn("share", F.col("shared") / F.col("size")).filter(F.col("share") > more_than).select(new_id, old_id, "share")


def contained_classes(new: DataFrame, old: DataFrame, new_id: str, old_id: str, text: str, pattern: str, more_than: float, new_rows: str, old_rows: str) -> DataFrame:
    """As contained, between distinct texts, each under its smallest id, with the numbers of rows that have them."""
    a = new.groupBy(text).agg(F.min(new_id).alias(new_id), F.count("*").alias(new_rows))
    b = old.groupBy(text).agg(F.min(old_id).alias(old_id), F.count("*").alias(old_rows))
    found = contained(a, b, new_id, old_id, text, pattern, more_than)
    return found.join(a.select(new_id, new_rows), new_id).join(b.select(old_id, old_rows), old_id).select(new_id, old_id, "share", new_rows, old_rows)


def verbatim(texts: DataFrame, sources: DataFrame, key: str, text: str, source_text: str, n: int = 8) -> DataFrame:
    """(key, position, gram): the first run of n words of a text that a source has too."""

    def hashed(df: DataFrame, c: str) -> DataFrame:
        """df with __w, its words, and __h, a hash of each run.

        __w is a column of its own, or each run would split the text again; for the same reason __h is exploded with its empty arrays, as
        Spark would otherwise push a filter on it, written out, below.
        """
        df = df.withColumn("__w", F.filter(F.split(F.lower(c), r"\s+"), lambda w: w != ""))
        runs = F.transform(F.sequence(F.lit(0), F.greatest(F.size("__w") - n, F.lit(0))), lambda i: F.xxhash64(*[F.get("__w", i + k) for k in range(n)]))
        return df.withColumn("__h", F.when(F.size("__w") >= n, runs))

    known = hashed(sources.select(F.col(source_text).alias("__s")), "__s").select(F.explode_outer("__h").alias("h")).filter("h IS NOT NULL").distinct()
    grams = hashed(texts.select(key, F.col(text).alias("__t")), "__t").select(key, F.posexplode_outer("__h").alias("position", "h")).filter("h IS NOT NULL")
    hits = grams.join(known, "h", "left_semi").select(key, "position")
    # hashes find the places, words confirm them
    spelled = lambda w, i: F.array_join(F.slice(w, i + 1, n), " ")
    worded = texts.select(F.col(key).alias("__k"), F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "").alias("__w"))
    places = hits.groupBy(key).agg(F.array_sort(F.collect_list("position")).alias("__p"))
    found = places.join(worded, F.col(key) == F.col("__k")).select(key, F.explode("__p").alias("position"), "__w").select(key, "position", spelled(F.col("__w"), F.col("position")).alias("gram"))
    wanted = sources.select(F.filter(F.split(F.lower(source_text), r"\s+"), lambda w: w != "").alias("__w"))
    wanted = wanted.select("__w", F.explode_outer(F.when(F.size("__w") >= n, F.sequence(F.lit(0), F.greatest(F.size("__w") - n, F.lit(0))))).alias("i")).filter("i IS NOT NULL").select(spelled(F.col("__w"), F.col("i")).alias("gram")).distinct()
    exact = found.join(wanted, "gram", "left_semi")
    return exact.groupBy(key).agg(F.min(F.struct("position", "gram")).alias("h")).select(key, "h.position", "h.gram")


def keywords(text: Column, stop: list[str], most: int = 8) -> Column:
    """The first distinct words of five letters or more that aren't stop words."""
    return F.slice(F.filter(tokens(text, "[a-z]{5,}"), lambda w: ~w.isin(stop)), 1, most)


def best_by_keywords(topics: DataFrame, articles: DataFrame, topic_id: str, article_id: str, text: str, title: str, stop: list[str], least: int = 2, k: int = 6) -> DataFrame:
    """(topic_id, article_id, hits): the k articles of each topic whose titles hold most of its keywords, at least so many.

    A keyword counts where it stands within a longer word, too. Each distinct word of the titles is cut into runs of five letters, and a keyword
    meets those words that hold its first five, so all joins are on equal keys.
    """
    own = topics.select(topic_id, F.explode(keywords(F.col(text), stop)).alias("word"))
    words = own.select("word").distinct().withColumn("gram", F.substring("word", 1, 5))
    titled = articles.select(article_id, F.explode(tokens(F.col(title), "[a-z]{5,}")).alias("token"))
    grams = titled.select("token").distinct().withColumn("gram", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("token") - 4), lambda i: F.substring(F.col("token"), i, F.lit(5))))))
    within = grams.join(words, "gram").filter(F.col("token").contains(F.col("word"))).select("token", "word").distinct()
    held = titled.join(within, "token").select(article_id, "word").distinct()
    scored = own.join(held, "word").groupBy(topic_id, article_id).agg(F.count("*").cast("int").alias("hits")).filter(F.col("hits") >= least)
    return top_k(scored, [topic_id], [F.desc("hits"), F.desc(article_id)], k)


def hits(words: Column, text: Column) -> Column:
    """How many of the words the text holds, as substrings."""
    low = F.lower(text)
    return F.size(F.filter(words, lambda w: low.contains(w)))


