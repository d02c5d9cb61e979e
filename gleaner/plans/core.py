"""Queries: priority, deduplication, series, snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.functions import rules as R
from gleaner.functions import text as T
from gleaner.operators import priority, series
from gleaner.operators.common import insert_absent, latest, top_k, undirected, upsert
from gleaner.plans.registry import query
from gleaner.plans.tables import Tables

_COUNTS = "counts AS (SELECT artifact_id, count(*) AS claims, count(*) FILTER (regexp_matches(proposition, '[0-9]')) AS measurements FROM claims GROUP BY 1)"
_GATE4 = "+" + _COUNTS + """, lone AS (SELECT entity FROM artifact_entities GROUP BY 1 HAVING count(DISTINCT artifact_id) = 1),
nov AS (SELECT e.artifact_id, count(*) AS entities, count(l.entity) / count(*) AS novelty FROM artifact_entities e LEFT JOIN lone l USING (entity) GROUP BY 1),
parts AS (SELECT a.artifact_id, CASE WHEN s.tier IS NULL THEN 0.5 ELSE 1 - (least(greatest(s.tier, 1), 5) - 1) / 4 END AS reliability, coalesce(n.novelty, 0) AS novelty,
  0.5 * least(coalesce(c.claims, 0) / 10, 1.0) + 0.4 * least(coalesce(c.measurements, 0) / 3, 1.0) + 0.1 * least(coalesce(n.entities, 0) / 10, 1.0) AS density
  FROM artifacts a LEFT JOIN sources s USING (source) LEFT JOIN nov n USING (artifact_id) LEFT JOIN counts c USING (artifact_id) WHERE a.status = 'extracted'),
p AS (SELECT *, round(0.35 * reliability + 0.35 * novelty + 0.30 * density + 1e-9, 4) AS priority_score FROM parts),
scored AS (SELECT *, CASE WHEN priority_score >= 0.7 THEN 'high' WHEN priority_score >= 0.4 THEN 'medium' ELSE 'low' END AS priority FROM p)"""
_REASON = """SELECT artifact_id, round(reliability, 6) AS reliability, round(novelty, 6) AS novelty, round(density, 6) AS density, priority_score, priority,
priority || ' priority: ' || coalesce(nullif(concat_ws(', ', CASE WHEN reliability >= 0.75 THEN 'high source reliability' WHEN reliability < 0.4 THEN 'low source reliability' END,
CASE WHEN novelty >= 0.7 THEN 'high novelty' WHEN novelty < 0.3 THEN 'low novelty' END, CASE WHEN density >= 0.7 THEN 'high analytical density' WHEN density < 0.3 THEN 'low analytical density' END), ''), 'mixed priority signals') AS reason FROM scored"""
_G = ("artifacts", "sources", "claims", "artifact_entities")


def _scored(t: Tables) -> DataFrame:
    counts = t.claims().groupBy("artifact_id").agg(F.count("*").alias("claims"), F.count_if(F.col("proposition").rlike("[0-9]")).alias("measurements"))
    return priority.score(t.artifacts(), t.sources(), t.artifact_entities(), counts)


@query(_GATE4 + _REASON, *_G)
def gate4_priority(t: Tables) -> DataFrame:
    return _scored(t).select("artifact_id", *[F.round(c, 6).alias(c) for c in ("reliability", "novelty", "density")], "priority_score", "priority", "reason")


@query(_GATE4 + "SELECT priority, count(*) AS artifacts, round(avg(priority_score), 4) AS mean_score FROM scored GROUP BY 1", *_G)
def gate4_tallies(t: Tables) -> DataFrame:
    return _scored(t).groupBy("priority").agg(F.count("*").alias("artifacts"), F.round(F.avg("priority_score"), 4).alias("mean_score"))


@query("SELECT content_hash, min(artifact_id) AS artifact_id, count(*) AS copies, count(DISTINCT source) AS sources FROM artifacts GROUP BY 1", "artifacts")
def content_hash_dedupe(t: Tables) -> DataFrame:
    return t.artifacts().groupBy("content_hash").agg(F.min("artifact_id").alias("artifact_id"), F.count("*").alias("copies"), F.countDistinct("source").alias("sources"))


@query("SELECT source, count(*) AS rows_seen, count(DISTINCT content_hash) AS new_hashes, count(*) - count(DISTINCT content_hash) AS duplicates FROM artifacts GROUP BY 1", "artifacts")
def duplicate_report(t: Tables) -> DataFrame:
    out = t.artifacts().groupBy("source").agg(F.count("*").alias("rows_seen"), F.countDistinct("content_hash").alias("new_hashes"))
    return out.withColumn("duplicates", F.col("rows_seen") - F.col("new_hashes"))


@query("SELECT min(artifact_id) AS artifact_id, content_hash FROM artifacts WHERE lang <> 'en' AND content_hash NOT IN (SELECT content_hash FROM artifacts WHERE lang = 'en') GROUP BY content_hash", "artifacts")
def insert_if_absent(t: Tables) -> DataFrame:
    a = t.artifacts().select("artifact_id", "content_hash", "lang")
    return insert_absent(a.filter("lang <> 'en'"), a.filter("lang = 'en'"), ["content_hash"], [F.asc("artifact_id")]).drop("lang")


@query(
    "SELECT n.measurement_id, n.indicator, n.subject, n.source, n.period, n.value FROM measurements n WHERE source <> 'src0' AND NOT EXISTS (SELECT 1 FROM measurements o WHERE o.source = 'src0' AND o.indicator = n.indicator AND o.subject = n.subject AND o.period = n.period)",
    "measurements",
)
def measurement_get_or_create(t: Tables) -> DataFrame:
    m = t.measurements().select("measurement_id", "indicator", "subject", "source", "period", "value")
    keys = ["indicator", "subject", "period"]
    return m.filter("source <> 'src0'").join(m.filter("source = 'src0'").select(*keys), keys, "left_anti").select("measurement_id", "indicator", "subject", "source", "period", "value")


@query(
    "WITH old AS (SELECT 'P' || p_partkey AS indicator, p_name AS label, lower(p_type) AS metric_kind, p_brand AS unit FROM part), new AS (SELECT 'P' || l_partkey AS indicator, any_value(p_name) || ' in bulk' AS label, 'bulk' AS metric_kind, CAST(CAST(max(l_quantity) AS INT) AS VARCHAR) AS unit FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_quantity >= 50 GROUP BY l_partkey UNION ALL SELECT 'S' || s_suppkey, s_name, 'balance', 'USD' FROM supplier) SELECT * FROM old WHERE indicator NOT IN (SELECT indicator FROM new) UNION ALL SELECT * FROM new"
)
def registry_upsert(t: Tables) -> DataFrame:
    """A registry of all parts takes in what bulk sales say of them, and the suppliers as new indicators."""
    part = t.raw("part")
    old = part.select(F.concat(F.lit("P"), "p_partkey").alias("indicator"), F.col("p_name").alias("label"), F.lower("p_type").alias("metric_kind"), F.col("p_brand").alias("unit"))
    bulk = t.raw("lineitem").filter("l_quantity >= 50").groupBy("l_partkey").agg(F.max("l_quantity").cast("int").cast("string").alias("unit"))
    known = bulk.join(part, F.col("p_partkey") == F.col("l_partkey")).select(F.concat(F.lit("P"), "l_partkey").alias("indicator"), F.concat("p_name", F.lit(" in bulk")).alias("label"), F.lit("bulk").alias("metric_kind"), "unit")
    fresh = t.raw("supplier").select(F.concat(F.lit("S"), "s_suppkey").alias("indicator"), F.col("s_name").alias("label"), F.lit("balance").alias("metric_kind"), F.lit("USD").alias("unit"))
    return upsert(old, known.unionByName(fresh), ["indicator"])


@query("SELECT question_id, evidence_type, evidence_id, max(line) AS line FROM question_evidence GROUP BY ALL", "question_evidence")
def link_upsert_last_wins(t: Tables) -> DataFrame:
    return latest(t.question_evidence(), ["question_id", "evidence_type", "evidence_id"], "line")


@query("SELECT DISTINCT least(a.l_partkey, b.l_partkey) AS a_id, greatest(a.l_partkey, b.l_partkey) AS b_id, a.l_orderkey AS question_id FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber - 1")
def undirected_edges(t: Tables) -> DataFrame:
    line = t.raw("lineitem").select(F.col("l_orderkey").alias("question_id"), F.col("l_partkey").alias("a_id"), F.col("l_linenumber").alias("line"))
    after = line.select("question_id", F.col("a_id").alias("b_id"), (F.col("line") - 1).alias("line"))
    pairs = line.join(after, ["question_id", "line"])
    return undirected(pairs.select("question_id", "a_id", "b_id"), "a_id", "b_id", ["question_id"]).select("a_id", "b_id", "question_id")


_NEWEST = "m AS (SELECT *, max(period) OVER (PARTITION BY indicator) AS newest FROM measurements)"


@query(
    "+" + _NEWEST + " SELECT m.indicator, measurement_id, subject, source, period, value, label, metric_kind, polarity FROM m LEFT JOIN registry r ON r.indicator = m.indicator WHERE period = newest AND status <> 'projection' QUALIFY row_number() OVER (PARTITION BY m.indicator ORDER BY measurement_id) = 1",
    "measurements", "registry",
)
def latest_readings(t: Tables) -> DataFrame:
    return series.latest_readings(t.measurements(), t.registry())


@query(
    "+m AS (SELECT *, max(period) OVER (PARTITION BY indicator) AS newest FROM measurements WHERE status <> 'projection') SELECT indicator, measurement_id, subject, source, period, value FROM m WHERE period = newest QUALIFY row_number() OVER (PARTITION BY indicator ORDER BY measurement_id) = 1",
    "measurements",
)
def latest_readings_strict(t: Tables) -> DataFrame:
    return series.latest_readings(t.measurements(), strict=True)


def _tail_sql(n: int) -> str:
    return f"SELECT measurement_id, period, value FROM measurements QUALIFY row_number() OVER (PARTITION BY indicator, subject, source ORDER BY period DESC, measurement_id) <= {n}"


@query(_tail_sql(6), "measurements")
def trend_tail6(t: Tables) -> DataFrame:
    return series.tail(t.measurements(), 6).select("measurement_id", "period", "value")


@query(_tail_sql(26), "measurements")
def series_tail26(t: Tables) -> DataFrame:
    return series.tail(t.measurements(), 26).select("measurement_id", "period", "value")


_ANNUAL = "annual AS (SELECT *, value - lag(value) OVER (PARTITION BY indicator, subject, source ORDER BY period) AS step FROM measurements WHERE length(period) = 4)"
_PATTERN = "SELECT indicator, subject, source, count(*) AS points, first(value ORDER BY period) AS first_value, last(value ORDER BY period) AS last_value, round((last(value ORDER BY period) - first(value ORDER BY period)) / abs(first(value ORDER BY period)) * 100, 1) + 0.0 AS pct_change, {} AS direction FROM annual GROUP BY ALL HAVING count(*) >= 2"


@query("+" + _ANNUAL + _PATTERN.format("CASE WHEN coalesce(bool_and(step >= 0), true) THEN 'increasing' WHEN coalesce(bool_and(step <= 0), true) THEN 'decreasing' ELSE 'mixed' END"), "measurements")
def series_patterns_monotone(t: Tables) -> DataFrame:
    return series.patterns(t.measurements())


@query("+" + _ANNUAL + _PATTERN.format("CASE WHEN last(value ORDER BY period) > first(value ORDER BY period) THEN 'increasing' WHEN last(value ORDER BY period) < first(value ORDER BY period) THEN 'decreasing' ELSE 'flat' END"), "measurements")
def series_patterns_endpoint(t: Tables) -> DataFrame:
    return series.patterns(t.measurements(), monotone=False)


@query(
    "+e AS (SELECT indicator, subject, source, count(*) AS points, first(value ORDER BY period) AS a, last(value ORDER BY period) AS b FROM measurements GROUP BY ALL), s AS (SELECT *, round(abs(b - a) / greatest(abs(a), 1e-9), 6) AS span FROM e WHERE points >= 8 AND a <> b) SELECT indicator, subject, source, points, span, row_number() OVER (PARTITION BY subject ORDER BY span DESC, indicator, source) AS place FROM s QUALIFY place <= 3",
    "measurements",
)
def series_span_top3(t: Tables) -> DataFrame:
    return series.span_top(t.measurements())


@query(
    "+e AS (SELECT indicator, subject, source, count(*) AS points, first(value ORDER BY period) AS a, last(value ORDER BY period) AS b FROM measurements WHERE length(period) = 4 AND status <> 'projection' GROUP BY ALL) SELECT indicator, subject, source, points, round((b - a) / a * 100, 1) + 0.0 AS pct FROM e WHERE points >= 6 AND a <> 0",
    "measurements",
)
def movements(t: Tables) -> DataFrame:
    return series.movements(t.measurements())


@query(
    "SELECT a.indicator, a.subject, a.source, a.period AS from_period, b.period AS to_period, round((b.value - a.value) / abs(a.value) * 100, 1) + 0.0 AS pct FROM measurements a JOIN measurements b ON a.indicator = b.indicator AND a.subject = b.subject AND a.source = b.source AND a.period < b.period WHERE length(a.period) = 4 AND length(b.period) = 4 AND a.value <> 0 AND a.value <> b.value",
    "measurements",
)
def pairwise_pct_change(t: Tables) -> DataFrame:
    return series.pairwise_changes(t.measurements())


@query(
    "SELECT indicator, subject, array_to_string(list_sort(list(period || '=' || CAST(CAST(value AS DECIMAL(38,2)) AS VARCHAR) || ' ' || source)), '; ') AS points, count(*) AS n_points, count(*) FILTER (provisional) AS n_provisional, last(status ORDER BY period, measurement_id) AS last_status FROM measurements GROUP BY ALL",
    "measurements",
)
def series_by_subject(t: Tables) -> DataFrame:
    return series.series_table(t.measurements())


@query(
    "+s AS (SELECT indicator, subject, source, min(TRY_CAST(period[1:4] AS INT)) AS first_year, max(TRY_CAST(period[1:4] AS INT)) AS last_year, bool_or(regexp_matches(period, '^[0-9]{4}-[0-9]{2}')) AS monthly, max(period) AS newest FROM measurements WHERE source <> 'src2' OR length(period) = 4 GROUP BY ALL) SELECT *, last_year <= 2001 AS stale, concat_ws('; ', CASE WHEN last_year >= 2003 AND NOT monthly THEN 'projection' END, CASE WHEN last_year <= 2001 THEN 'latest is ' || last_year END, CASE WHEN monthly THEN 'monthly' END) AS facts FROM s",
    "measurements",
)
def temporal_facts(t: Tables) -> DataFrame:
    return series.temporal_facts(t.measurements().filter("source <> 'src2' OR length(period) = 4"), 2003)


@query("SELECT measurement_id, CASE WHEN TRY_CAST(period[1:4] AS INT) >= 2001 THEN 'projection' WHEN TRY_CAST(period[1:4] AS INT) = 2000 THEN 'recent' ELSE 'historical' END AS vintage FROM measurements", "measurements")
def vintage_class(t: Tables) -> DataFrame:
    return t.measurements().select("measurement_id", R.vintage(F.col("period"), 2001).alias("vintage"))


@query("SELECT indicator, subject, source, max(period) AS newest FROM measurements GROUP BY ALL HAVING max(TRY_CAST(period[1:4] AS INT)) <= 2001", "measurements")
def stale_series(t: Tables) -> DataFrame:
    return series.temporal_facts(t.measurements(), 2003).filter("stale").select("indicator", "subject", "source", "newest")


@query(
    "SELECT m.indicator, count(*) AS n_rows, count(DISTINCT period[1:4]) AS years, min(period) AS lo, max(period) AS hi, count(DISTINCT subject) AS subjects, string_agg(DISTINCT subject, ',' ORDER BY subject) AS names, bool_or(r.indicator IS NOT NULL) AS registered FROM measurements m LEFT JOIN registry r ON m.indicator = r.indicator GROUP BY 1",
    "measurements", "registry",
)
def registry_coverage(t: Tables) -> DataFrame:
    return series.coverage(t.measurements(), t.registry())


@query("SELECT indicator, subject, source, count(DISTINCT period) AS periods FROM measurements WHERE period >= '2001-10' GROUP BY ALL HAVING count(DISTINCT period) <= 2", "measurements")
def snapshot_only_series(t: Tables) -> DataFrame:
    """Series that the newest two months of the data alone would give."""
    return series.short_series(t.measurements().filter("period >= '2001-10'"))


@query("SELECT indicator, source, count(DISTINCT subject) AS subjects, count(DISTINCT period) AS periods FROM measurements GROUP BY ALL HAVING count(DISTINCT subject) <> 1 OR min(subject) <> 'IRAN' OR count(DISTINCT period) < 3", "measurements")
def integrity_check(t: Tables) -> DataFrame:
    return series.integrity(t.measurements(), "IRAN")


_KINDS = "kinds(indicator, metric_kind, polarity) AS (VALUES ('click', 'rate', 'good'), ('view', 'level', 'good'), ('purchase', 'level', 'bad'), ('error', 'index', 'bad'))"


@query(
    "+" + _KINDS + """, d AS (SELECT DISTINCT problem_id, taken_at FROM snapshots), n AS (SELECT *, row_number() OVER (PARTITION BY problem_id ORDER BY taken_at DESC) AS k FROM d),
b AS (SELECT problem_id, max(taken_at) FILTER (k = 1) AS now, max(taken_at) FILTER (k = 2) AS before FROM n WHERE k <= 2 GROUP BY 1),
j AS (SELECT s.problem_id, s.indicator, now, before, p.value AS prev, s.value, k.metric_kind, k.polarity FROM snapshots s JOIN b USING (problem_id) LEFT JOIN snapshots p ON p.problem_id = s.problem_id AND p.indicator = s.indicator AND p.taken_at = before LEFT JOIN kinds k ON k.indicator = s.indicator WHERE s.taken_at = now),
c AS (SELECT *, CASE WHEN value = prev THEN 'unchanged' WHEN value > prev THEN 'up' ELSE 'down' END AS dir FROM j)
SELECT problem_id, indicator, now, before, prev, value, round(value - prev, 4) AS delta, CASE WHEN prev IS NULL THEN 'new' WHEN (CASE WHEN coalesce(metric_kind, 'level') IN ('level', 'count') THEN abs(value - prev) > abs(prev) * 0.01 ELSE abs(value - prev) >= CASE metric_kind WHEN 'index' THEN 1.0 ELSE 0.5 END END) THEN 'changed' ELSE 'noise' END AS status,
CASE WHEN prev IS NOT NULL THEN dir END AS direction, CASE WHEN prev IS NULL THEN NULL WHEN dir = 'unchanged' OR polarity IS NULL THEN 'neutral' WHEN (dir = 'up' AND polarity = 'good') OR (dir = 'down' AND polarity = 'bad') THEN 'improved' ELSE 'worsened' END AS verdict FROM c""",
    "snapshots",
)
def snapshot_changes(t: Tables) -> DataFrame:
    kinds = t.spark.createDataFrame([("click", "rate", "good"), ("view", "level", "good"), ("purchase", "level", "bad"), ("error", "index", "bad")], "indicator string, metric_kind string, polarity string")
    return series.snapshot_changes(t.snapshots(), kinds)


@query("SELECT problem_id, count(DISTINCT taken_at) AS snapshots, count(*) AS readings, max(taken_at) AS newest FROM snapshots GROUP BY 1", "snapshots")
def snapshot_report(t: Tables) -> DataFrame:
    return series.snapshot_report(t.snapshots())


@query(
    "SELECT o.indicator, o.subject, o.period, o.value AS old_value, n.value AS new_value FROM measurements o JOIN measurements n ON n.indicator = o.indicator AND n.subject = o.subject AND n.period = o.period WHERE o.source = 'src0' AND n.source = 'src1' AND o.provisional AND abs(n.value - o.value) > 1e-9",
    "measurements",
)
def supersede_log(t: Tables) -> DataFrame:
    m = t.measurements()
    return series.supersede(m.filter("source = 'src0'"), m.filter("source = 'src1'"), ["indicator", "subject", "period"])[1]


@query(
    "SELECT o.measurement_id, coalesce(CASE WHEN o.provisional THEN n.value END, o.value) AS value, o.provisional AND n.value IS NULL AS provisional FROM measurements o LEFT JOIN measurements n ON n.indicator = o.indicator AND n.subject = o.subject AND n.period = o.period AND n.source = 'src1' WHERE o.source = 'src0'",
    "measurements",
)
def supersede_table(t: Tables) -> DataFrame:
    m = t.measurements()
    return series.supersede(m.filter("source = 'src0'"), m.filter("source = 'src1'"), ["indicator", "subject", "period"])[0].select("measurement_id", "value", "provisional")


@query("SELECT artifact_id, pos, proposition, score FROM (SELECT *, len(regexp_extract_all(proposition, '[0-9]')) + 2 * len(regexp_extract_all(lower(proposition), '%|percent|billion|million|thousand')) AS score FROM claims) QUALIFY row_number() OVER (PARTITION BY artifact_id ORDER BY score DESC, pos) <= 10", "claims")
def top_quant_claims(t: Tables) -> DataFrame:
    scored = t.claims().withColumn("score", T.quantity_score(F.col("proposition")))
    return top_k(scored, ["artifact_id"], [F.desc("score"), F.asc("pos")], 10).select("artifact_id", "pos", "proposition", "score")
