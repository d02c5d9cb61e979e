"""Priority of extracted artifacts from source reliability, novelty and analytical density."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions.numeric import clamp

WEIGHTS = {"reliability": 0.35, "novelty": 0.35, "density": 0.30}
HIGH, MEDIUM = 0.70, 0.40


def reliability(tier: Column) -> Column:
    """1 for tier 1 down to 0 for tier 5; 0.5 without a tier."""
    # least and greatest skip nulls, so the missing tier is told first
    return F.when(tier.isNull(), 0.5).otherwise(1 - (F.least(F.greatest(tier, F.lit(1)), F.lit(5)) - 1) / 4)


def density(claims: Column, measurements: Column, entities: Column) -> Column:
    parts = 0.5 * F.least(claims / 10, F.lit(1.0)) + 0.4 * F.least(measurements / 3, F.lit(1.0)) + 0.1 * F.least(entities / 10, F.lit(1.0))
    return clamp(parts, 0.0, 1.0)


def reason(priority: Column, rel: Column, nov: Column, dens: Column) -> Column:
    def signal(value: Column, high: float, low: float, what: str) -> Column:
        return F.when(value >= high, f"high {what}").when(value < low, f"low {what}")

    said = F.concat_ws(", ", signal(rel, 0.75, 0.40, "source reliability"), signal(nov, 0.70, 0.30, "novelty"), signal(dens, 0.70, 0.30, "analytical density"))
    return F.concat(priority, F.lit(" priority: "), F.when(said == "", "mixed priority signals").otherwise(said))


def novelty(artifact_entities: DataFrame) -> DataFrame:
    """(artifact_id, entities, novelty): the share of an artifact's entities that no other artifact has.

    Entities of one artifact only are known by their least and greatest artifact, so the count needs no distinct,
    and a window isn't needed either: lone entities are counted where they are.
    """
    pairs = artifact_entities.select("artifact_id", "entity").distinct()
    lone = pairs.groupBy("entity").agg(F.min("artifact_id").alias("artifact_id"), F.max("artifact_id").alias("other")).filter("artifact_id = other")
    per = pairs.groupBy("artifact_id").agg(F.count("*").alias("entities"))
    alone = lone.groupBy("artifact_id").agg(F.count("*").alias("lone"))
    return per.join(alone, "artifact_id", "left").select("artifact_id", "entities", (F.coalesce("lone", F.lit(0)) / F.col("entities")).alias("novelty"))


def score(artifacts: DataFrame, sources: DataFrame, artifact_entities: DataFrame, counts: DataFrame) -> DataFrame:
    """Per extracted artifact: parts, priority_score (4 digits, ties up), priority and reason. counts: artifact_id, claims, measurements."""
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    df = artifacts.filter("status = 'extracted'").select("artifact_id", "source").join(sources, "source", "left").join(novelty(artifact_entities), "artifact_id", "left").join(counts, "artifact_id", "left")
    df = df.select("artifact_id", reliability(F.col("tier")).alias("reliability"), zero("novelty").alias("novelty"), density(zero("claims"), zero("measurements"), zero("entities")).alias("density"))
    total = sum((w * F.col(k) for k, w in WEIGHTS.items()), F.lit(0.0))
    df = df.withColumn("priority_score", F.round(clamp(total, 0.0, 1.0) + 1e-9, 4))
    df = df.withColumn("priority", F.when(F.col("priority_score") >= HIGH, "high").when(F.col("priority_score") >= MEDIUM, "medium").otherwise("low"))
    return df.withColumn("reason", reason(F.col("priority"), F.col("reliability"), F.col("novelty"), F.col("density")))
