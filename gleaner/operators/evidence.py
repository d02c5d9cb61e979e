"""Joins over the evidence graph: citations, provenance, orphans, pairs, coverage and panel views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions.rules import not_rejected
from gleaner.operators.common import top_k
from gleaner.operators.stages import Stages

#: Problems of one set of topics that travel as one row.
BLOCK = 4096


def cited(evidence: DataFrame, questions: DataFrame, kind: str) -> DataFrame:
    """Evidence of one kind with its question and problem: the kind is filtered before the join."""
    return evidence.filter(F.col("evidence_type") == kind).join(questions.select("question_id", "problem_id"), "question_id")


def finding_citations(findings: DataFrame, studies: DataFrame, evidence: DataFrame, questions: DataFrame) -> DataFrame:
    """Findings of accepted studies with the questions and problems that cite them."""
    good = studies.filter(not_rejected(F.col("quality")))
    known = findings.join(good, "study_id")
    return cited(evidence, questions, "finding").join(known, F.col("evidence_id") == F.col("finding_id"))


def provenance(findings: DataFrame, studies: DataFrame) -> DataFrame:
    return findings.join(studies, "study_id", "left")


def orphans(findings: DataFrame, evidence: DataFrame, kind: str = "finding") -> DataFrame:
    links = evidence.filter(F.col("evidence_type") == kind)
    return findings.join(links, F.col("finding_id") == F.col("evidence_id"), "left_anti")


def resolve_aliases(names: DataFrame, entities: DataFrame) -> DataFrame:
    """(name, entity_id): the first entity (smallest id) whose name or an alias of whose equals name, case and outer blanks aside; null if none."""
    each = entities.select("entity_id", F.explode(F.array_prepend(F.coalesce("aliases", F.array().cast("array<string>")), F.col("entity_name"))).alias("alias"))
    keyed = each.select(F.lower(F.trim("alias")).alias("key"), "entity_id").filter("key <> ''").groupBy("key").agg(F.min("entity_id").alias("entity_id"))
    wanted = names.select("name").distinct().withColumn("key", F.lower(F.trim("name")))
    return wanted.join(keyed, "key", "left").select("name", "entity_id")


def resolve_subjects(measurements: DataFrame, local: DataFrame, known: DataFrame) -> DataFrame:
    """Subject ids by priority: an entity of the same artifact, then one of that name anywhere, else null."""
    near = local.groupBy("artifact_id", "name").agg(F.min("entity_id").alias("near"))
    far = known.groupBy("name").agg(F.min("entity_id").alias("far"))
    return measurements.join(near, ["artifact_id", "name"], "left").join(far, "name", "left").withColumn("entity_id", F.coalesce("near", "far")).drop("near", "far")


def pairs_sharing(cited_findings: DataFrame, columns: list[str]) -> DataFrame:
    """(question_id, a_id, b_id): pairs of a question's findings that share a value in any of the columns, each once.

    Blocked by question and value, so only findings that share both meet.
    """
    found = None
    base = cited_findings.select("question_id", "finding_id", *columns).distinct()
    for c in columns:
        side = base.filter(F.col(c).isNotNull()).select("question_id", "finding_id", F.col(c).alias("v"))
        other = side.select("question_id", F.col("finding_id").alias("b_id"), "v")
        part = side.withColumnRenamed("finding_id", "a_id").join(other, ["question_id", "v"]).filter("a_id < b_id").select("question_id", "a_id", "b_id")
        found = part if found is None else found.unionByName(part)
    return found.distinct()


def cross_source_pairs(measurements: DataFrame) -> DataFrame:
    """Readings of one indicator, subject and period from two sources."""
    m = measurements.select("indicator", "subject", "period", "source", "value")
    other = m.select("indicator", "subject", "period", F.col("source").alias("other_source"), F.col("value").alias("other_value"))
    return m.join(other, ["indicator", "subject", "period"]).filter("source < other_source")


def representative_pairs(measurements: DataFrame) -> DataFrame:
    """Pairs of different indicators of a subject and source, each by its newest reading."""
    newest = measurements.groupBy("subject", "source", "indicator").agg(F.max(F.struct("period", "value")).alias("m")).select("subject", "source", "indicator", F.col("m.period").alias("period"), F.col("m.value").alias("value"))
    other = newest.select("subject", "source", F.col("indicator").alias("b_indicator"), F.col("period").alias("b_period"), F.col("value").alias("b_value"))
    return newest.join(other, ["subject", "source"]).filter("indicator < b_indicator")


def topic_links(topics: DataFrame, generic: list[str], generic_weight: float = 0.25, least: float = 1.0) -> DataFrame:
    """(a, b, score): problems sharing topics; a generic topic counts less, and at least one specific one is needed.

    Topics are few and problems many, so pairs are counted over the distinct sets of topics. The members of a set are dealt into blocks of about BLOCK and pairs of blocks
    are dealt out evenly, so that no task lists all pairs of a large set.
    """
    spark = topics.sparkSession
    own = Stages(spark).put(topics.select("problem_id", "topic").distinct())
    members, linked = topic_classes(own, generic, generic_weight, least)
    size = members.groupBy("class").agg(F.count("*").alias("n"))
    block = F.pmod(F.xxhash64("problem_id"), F.ceil(F.col("n") / BLOCK)).alias("block")
    blocks = members.join(size, "class").groupBy("class", block).agg(F.collect_list("problem_id").alias("ids"))
    place = blocks.select("class", "block")
    unit = linked.select("a", "b", "score").join(place.toDF("a", "i"), "a").join(place.toDF("b", "j"), "b").filter("a <> b OR i <= j")
    met = unit.join(blocks.toDF("a", "i", "x"), ["a", "i"]).join(blocks.toDF("b", "j", "y"), ["b", "j"])
    dealt = met.repartition(int(spark.conf.get("spark.sql.shuffle.partitions"))).withColumn("p", F.explode("x")).withColumn("q", F.explode("y"))
    return dealt.filter("a <> b OR i <> j OR p < q").select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"), "score")


def topic_classes(topics: DataFrame, generic: list[str], generic_weight: float = 0.25, least: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """What topic_links gives, without its pairs: (problem_id, class) of all problems with topics, and (a, b, score, links) of linked classes, a <= b.

    A class holds the problems of one set of topics and goes by its smallest id; links counts the pairs of problems between two classes, or within one. The result grows with the
    sets of topics, not with the pairs of problems; ``topic_links_of`` expands it for given problems.
    """
    weight = F.when(F.col("topic").isin(generic), generic_weight).otherwise(1.0)
    sets = topics.select("problem_id", "topic").distinct().groupBy("problem_id").agg(F.sort_array(F.collect_list("topic")).alias("s"))
    classes = sets.groupBy("s").agg(F.min("problem_id").alias("class"), F.count("*").alias("n"))
    one = classes.select(F.col("class").alias("a"), F.col("n").alias("na"), F.explode("s").alias("topic")).withColumn("w", weight)
    other = classes.select(F.col("class").alias("b"), F.col("n").alias("nb"), F.explode("s").alias("topic"))
    shared = one.join(other, "topic").filter("a <= b").groupBy("a", "b", "na", "nb").agg(F.sum("w").alias("score"), F.max("w").alias("m"))
    pairs = F.when(F.col("a") == F.col("b"), F.expr("na * (na - 1) div 2")).otherwise(F.col("na") * F.col("nb"))
    linked = shared.filter((F.col("score") >= least) & (F.col("m") >= 1.0)).select("a", "b", "score", pairs.alias("links")).filter("links > 0")
    return sets.join(classes, "s").select("problem_id", "class"), linked


def topic_links_of(asked: DataFrame, members: DataFrame, linked: DataFrame) -> DataFrame:
    """(problem_id, other, score): all links of the asked problems (problem_id), from classes and their links."""
    both = linked.select("a", "b", "score").unionByName(linked.filter("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"), "score"))
    own = asked.join(members, "problem_id").join(both, F.col("class") == F.col("a")).select("problem_id", "b", "score")
    return own.join(members.select(F.col("problem_id").alias("other"), F.col("class").alias("b")), "b").filter("other <> problem_id").select("problem_id", "other", "score")


def value_bands(numbers: DataFrame, values: DataFrame, width: float = 0.051) -> DataFrame:
    """Numbers and values less than width apart: an equi-join on bands of that width and their neighbours, then the exact test."""
    band = F.floor(F.col("value") / width)
    banded = values.withColumn("__band", band)
    near = numbers.withColumn("__band", F.explode(F.array(*[F.floor(F.col("number") / width) + d for d in (-1, 0, 1)])))
    return near.join(banded, "__band").filter(F.abs(F.col("value") - F.col("number")) < width).drop("__band")


def histogram(df: DataFrame, column: Column, name: str) -> DataFrame:
    return df.groupBy(column.alias(name)).agg(F.count("*").alias("n"))


def top_rows(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    return top_k(df, keys, order, k, "place")


def subjects(questions: DataFrame, links: DataFrame, entities: DataFrame) -> DataFrame:
    """(question_id, entity_id, name): the first entity, by id, of each question's problem."""
    first = links.join(entities, "entity_id").groupBy("problem_id").agg(F.min_by(F.struct("entity_id", "name"), "entity_id").alias("e"))
    return questions.join(first, "problem_id").select("question_id", "e.entity_id", "e.name")


def interventions(links: DataFrame, levers: DataFrame, key: str) -> DataFrame:
    """A problem's interventions; one that states its relevance counts as verified."""
    return links.join(levers, key).withColumn("verified", F.coalesce(F.trim("relevance"), F.lit("")) != "")
