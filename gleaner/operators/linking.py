"""Linking evidence to problems by domain and words. Texts repeat, so distinct texts are compared and problems joined back."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions import rules as R
from gleaner.functions.text import jaccard, ngrams, stem, tokens
from gleaner.operators.common import top_k
from gleaner.operators.matching import overlaps
from gleaner.operators.stages import Stages, broadcast_if_few

#: Words too general to corroborate an indicator, region terms, and topic names that domains spell otherwise.
GENERIC_WORDS = ["rate", "total", "annual", "goods", "services", "gross", "current", "share", "index", "growth", "per"]
REGION = ["iran", "iranian", "middle east", "west asia"]
TOPIC_ALIASES = {"agriculture": "agri", "employment": "labour", "urbanization": "housing"}
NEWS_STOP = ["the", "and", "for", "with", "from", "that", "this", "are", "was", "has", "have", "its", "new", "over", "after", "into"]


def findings_to_statements(statements: DataFrame, findings: DataFrame) -> DataFrame:
    """(statement, finding, title, shared): the title's primary domain is one of the statement's, and three words are shared, or two and a region is named."""
    text = findings.select("finding", "title", F.concat_ws(" ", "finding", "title").alias("text")).distinct()
    s = statements.select("statement").distinct().withColumn("text", F.col("statement"))
    near = overlaps(s.withColumnRenamed("statement", "sid"), text.select(F.struct("finding", "title").alias("fid"), "text"), "sid", "fid", "text", "[a-z]{4,}", 2)
    low = F.lower(F.concat_ws(" ", "fid.finding", "fid.title"))
    named = F.lit(False)
    for r in REGION:
        named = named | low.contains(r)
    fits = F.array_contains(R.link_domains(F.col("sid")), R.primary_domain(F.col("fid.title")))
    return near.filter(fits & ((F.col("shared") >= 3) | named)).select(F.col("sid").alias("statement"), "fid.finding", "fid.title", "shared")


def series_to_statements(statements: DataFrame, registry: DataFrame, measurements: DataFrame, k: int = 3) -> DataFrame:
    """(statement, indicator, score, place): the k registered series whose topic is one of the statement's domains and whose label's
    words, or their synonym families, meet the statement's; short annual series don't count."""
    counts = measurements.filter(R.not_projection(F.col("status"))).groupBy("indicator").agg(F.count("*").alias("points"), F.bool_or(F.col("period").contains("-")).alias("monthly"))
    r = registry.join(counts, "indicator").filter((F.col("points") >= 5) | F.col("monthly"))
    aliases = F.create_map(*[F.lit(x) for pair in TOPIC_ALIASES.items() for x in pair])
    topics = F.transform(F.split("topics", ","), lambda t: F.coalesce(F.try_element_at(aliases, F.trim(t)), F.trim(t)))
    stems = lambda c: F.array_distinct(F.transform(tokens(c, "[a-z]{4,}"), lambda w: stem(w)))
    words = F.array_except(stems(F.col("label")), F.array(*[F.lit(w) for w in GENERIC_WORDS]))
    r = r.select("indicator", topics.alias("topics"), words.alias("words"), R.families(words).alias("families"))
    s = statements.select("statement").distinct()
    s = s.select("statement", R.link_domains(F.col("statement")).alias("domains"), stems(F.col("statement")).alias("own"), R.families(stems(F.col("statement"))).alias("own_families"))
    # by topic, not pair by pair; explode would look for empty domains in each problem's statement, before equal ones are one
    met = s.withColumn("topic", F.explode_outer("domains")).join(r.withColumn("topic", F.explode(F.array_distinct("topics"))), "topic").drop("topic", "domains", "topics").distinct()
    score = F.size(F.array_intersect("words", "own")) + F.size(F.array_intersect("families", "own_families"))
    scored = met.withColumn("score", score).filter("score > 0")
    return top_k(scored, ["statement"], [F.desc("score"), F.asc("indicator")], k, "place").select("statement", "indicator", "score", "place")


def news_scores(statements: DataFrame, titles: DataFrame, least: int = 2, k: int = 6) -> DataFrame:
    """(statement, title, score, place): shared words, two more where Iran is named; the k best, older ones first of equals.

    Words of a statement are ordered by how many titles have them. Each word has a list of champions, its oldest titles, those that name Iran first;
    scored exactly, a statement's champions give a score that its k best reach at least (a threshold). A title that reaches it shares so many words
    with the statement that one of the rarest is among them, all but as many as the threshold less one; only the lists of these are
    read, and common words are looked up for the titles found there. A title that names Iran and shares no word reaches the threshold only where fewer than
    k titles score above 2; then fewer than k such titles share a word, so the 2 k oldest are enough.
    """
    bonus = 2
    stop = F.array(*[F.lit(w) for w in NEWS_STOP])
    own = lambda c: F.array_except(tokens(F.col(c), "[a-z]{3,}"), stop)
    named = F.lower("title").contains("iran")
    t = titles.groupBy("title").agg(F.min("dt").alias("dt")).select("title", "dt", named.alias("iran"), own("title").alias("words"))
    lists = t.select(F.explode("words").alias("w"), "title", "dt", "iran")
    rarity = lists.groupBy("w").agg(F.count("*").alias("df"))
    said = statements.select("statement").distinct().select("statement", own("statement").alias("own"))
    order = said.select("statement", F.explode("own").alias("w")).join(rarity, "w").groupBy("statement").agg(F.transform(F.array_sort(F.collect_list(F.struct("df", "w"))), lambda x: x["w"]).alias("order"))
    s = said.join(order, "statement", "left").select("statement", "own", F.coalesce("order", F.array().cast("array<string>")).alias("order"))
    score = F.size(F.array_intersect("own", "words")) + F.when(F.col("iran"), bonus).otherwise(0)

    def scored(pairs: DataFrame) -> DataFrame:
        """Of (statement, title): statement, title, dt, score."""
        return pairs.distinct().join(t, "title").join(said, "statement").select("statement", "title", "dt", score.alias("score"))

    champions = top_k(lists, ["w"], [F.desc("iran"), F.asc_nulls_first("dt"), F.asc("title")], 2 * k).select("w", "title")
    first = scored(s.select("statement", F.explode("order").alias("w")).join(champions, "w").select("statement", "title"))
    place = Window.partitionBy("statement").orderBy(F.desc("score"))
    reached = first.withColumn("r", F.row_number().over(place)).filter(F.col("r") == k).select("statement", "score")
    bounds = s.join(reached, "statement", "left").withColumn("least", F.greatest(F.lit(least), F.coalesce("score", F.lit(0))))
    # a word is read for titles that name Iran, and, if it is among the rarer ones, for all
    read = bounds.select("statement", "least", F.size("order").alias("m"), F.posexplode("order").alias("at", "w"))
    met = read.filter(F.col("at") <= F.col("m") - (F.col("least") - bonus)).join(lists.select("w", "title", "iran"), "w")
    found = met.filter(F.col("iran") | (F.col("at") <= F.col("m") - F.col("least"))).select("statement", "title")
    oldest = t.filter("iran").orderBy(F.asc_nulls_first("dt"), "title").limit(2 * k).select("title", F.lit(bonus).alias("least"))
    unshared = bounds.filter(F.col("least") <= bonus).select("statement", F.lit(bonus).alias("least")).join(F.broadcast(oldest), "least").select("statement", "title")
    best = scored(found.unionByName(unshared)).filter(F.col("score") >= least)
    return top_k(best, ["statement"], [F.desc("score"), F.asc_nulls_first("dt"), F.asc("title")], k, "place").select("statement", "title", "score", "place")


def opening_similarity(texts: DataFrame, ledger: DataFrame, group: str, key: str, text: str, pattern: str, first: int = 12, n: int = 3) -> DataFrame:
    """(key, similarity): the greatest Jaccard similarity of a text's opening n-grams with those of its group's ledger, itself aside."""
    grams = lambda c: F.array_distinct(ngrams(F.slice(F.regexp_extract_all(F.lower(c), F.lit(pattern), F.lit(0)), 1, first), n))
    own = texts.select(group, key, grams(F.col(text)).alias("a"))
    old = ledger.select(group, F.col(key).alias("__old"), grams(F.col(text)).alias("b"))
    pairs = own.join(old, group).filter(F.col(key) != F.col("__old"))
    best = pairs.groupBy(key).agg(F.max(F.when((F.size("a") > 0) & (F.size("b") > 0), jaccard(F.col("a"), F.col("b"))).otherwise(0.0)).alias("similarity"))
    return own.select(key).join(best, key, "left").select(key, F.coalesce("similarity", F.lit(0.0)).alias("similarity"))


def opening_similarity_to_others(posts: DataFrame, ledger: DataFrame, owner: str, key: str, text: str, order: str, pattern: str, first: int = 12, n: int = 3, last: int = 20) -> DataFrame:
    """(key, similarity): the greatest Jaccard similarity of a post's opening n-grams with those of the last ledger entries of other owners.

    No owner has more than ``last`` of the newest 2 * last entries kept of at most ``last`` for each, so each post finds its last entries of others among these.
    Openings repeat: distinct ones are compared, by the grams they share.
    """
    grams = lambda c: F.array_distinct(ngrams(F.slice(F.regexp_extract_all(c, F.lit(pattern), F.lit(0)), 1, first), n))
    newest = top_k(ledger.select(owner, F.col(key).alias("__entry"), order, text), [owner], [F.desc(order), F.desc("__entry")], last)
    newest = newest.orderBy(F.desc(order), F.desc("__entry")).limit(2 * last)
    placed = newest.withColumn("r", F.row_number().over(Window.orderBy(F.desc(order), F.desc("__entry"))))  # of 2 * last rows
    entries = placed.select("r", F.col(owner).alias("__owner"), grams(F.coalesce(text, F.lit(""))).alias("b"))
    own = placed.groupBy(F.col(owner).alias("__p")).agg(F.collect_list("r").alias("own"))
    mine = posts.select(key, owner, grams(F.coalesce(text, F.lit(""))).alias("a"))
    kinds = mine.select("a").distinct().filter(F.size("a") > 0)
    shared = kinds.select("a", F.explode("a").alias("g")).join(entries.filter(F.col("__owner").isNotNull()).select("r", "__owner", "b", F.explode("b").alias("g")), "g").select("a", "r", "__owner", jaccard(F.col("a"), F.col("b")).alias("s")).distinct()
    # an opening's similarities are one row of at most 2 * last entries; owners without an entry share the best of the last ones
    near = shared.groupBy("a").agg(F.collect_list(F.struct("r", "__owner", "s")).alias("near"), F.max(F.when(F.col("r") <= last, F.col("s"))).alias("best"))
    met = mine.join(F.broadcast(own), F.col(owner) == F.col("__p"), "left").join(broadcast_if_few(Stages(posts.sparkSession).put(near)), "a", "left")
    seen = lambda x: (x["__owner"] != F.col(owner)) & (x["r"] - F.size(F.filter("own", lambda y: y < x["r"])) <= last)
    best = F.when(F.col(owner).isNull(), 0.0).when(F.col("own").isNull(), F.col("best")).otherwise(F.array_max(F.transform(F.filter("near", seen), lambda x: x["s"])))
    return met.select(key, F.coalesce(best, F.lit(0.0)).alias("similarity"))
