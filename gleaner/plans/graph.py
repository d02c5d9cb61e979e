"""Queries: joins and aggregates over the evidence graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.functions import rules as R
from gleaner.functions import text as T
from gleaner.operators import evidence as E
from gleaner.operators.common import top_k
from gleaner.plans.registry import query
from gleaner.plans.tables import Tables

_CITED = "cited AS (SELECT e.*, q.problem_id FROM question_evidence e JOIN questions q USING (question_id))"
_EQ = ("question_evidence", "questions")


@query("+" + _CITED + " SELECT problem_id, count(*) AS links, count(DISTINCT evidence_id) AS parts, count(DISTINCT question_id) AS questions FROM cited WHERE evidence_type = 'measurement' GROUP BY 1", *_EQ)
def evidence_three_way(t: Tables) -> DataFrame:
    c = E.cited(t.question_evidence(), t.questions(), "measurement")
    return c.groupBy("problem_id").agg(F.count("*").alias("links"), F.countDistinct("evidence_id").alias("parts"), F.countDistinct("question_id").alias("questions"))


@query("SELECT measurement_id, label, polarity, metric_kind FROM measurements m LEFT JOIN registry r ON m.indicator = r.indicator WHERE status <> 'projection'", "measurements", "registry")
def evidence_enriched_left(t: Tables) -> DataFrame:
    m = t.measurements().filter(R.not_projection(F.col("status")))
    return m.join(F.broadcast(t.registry()), "indicator", "left").select("measurement_id", "label", "polarity", "metric_kind")


@query("SELECT measurement_id, label FROM measurements JOIN registry USING (indicator)", "measurements", "registry")
def evidence_registered(t: Tables) -> DataFrame:
    return t.measurements().join(F.broadcast(t.registry()), "indicator").select("measurement_id", "label")


@query("+" + _CITED + " SELECT problem_id, count(*) AS links, count(DISTINCT f.study_id) AS studies FROM cited c JOIN findings f ON f.finding_id = c.evidence_id JOIN studies s ON s.study_id = f.study_id WHERE evidence_type = 'finding' AND quality IS DISTINCT FROM 'rejected' GROUP BY 1", *_EQ, "findings", "studies")
def finding_citations(t: Tables) -> DataFrame:
    c = E.finding_citations(t.findings(), t.studies(), t.question_evidence(), t.questions())
    return c.groupBy("problem_id").agg(F.count("*").alias("links"), F.countDistinct("study_id").alias("studies"))


@query("SELECT finding_id, statement, title, year, quality FROM findings LEFT JOIN studies USING (study_id)", "findings", "studies")
def findings_provenance_left(t: Tables) -> DataFrame:
    return E.provenance(t.findings(), t.studies()).select("finding_id", "statement", "title", "year", "quality")


@query("SELECT finding_id, statement FROM findings JOIN studies USING (study_id) WHERE quality IS DISTINCT FROM 'rejected'", "findings", "studies")
def accepted_findings(t: Tables) -> DataFrame:
    return t.findings().join(t.studies(), "study_id").filter(R.not_rejected(F.col("quality"))).select("finding_id", "statement")


@query("SELECT DISTINCT problem_id, proposition FROM claims JOIN orders ON o_orderkey = artifact_id JOIN problems ON problem_id = o_custkey", "claims", "problems")
def claims_for_problem(t: Tables) -> DataFrame:
    links = t.raw("orders").select(F.col("o_orderkey").alias("artifact_id"), F.col("o_custkey").alias("problem_id"))
    return t.claims().join(links, "artifact_id").join(t.problems().select("problem_id"), "problem_id").select("problem_id", "proposition").distinct()


@query("SELECT p.problem_id, coalesce(n.n_name, '?') AS topic_name FROM problems p LEFT JOIN (SELECT DISTINCT lower(c_mktsegment) AS topic, c_mktsegment AS n_name FROM customer) n USING (topic)", "problems")
def problems_with_topic(t: Tables) -> DataFrame:
    topics = t.raw("customer").select(F.lower("c_mktsegment").alias("topic"), F.col("c_mktsegment").alias("name")).distinct()
    return t.problems().join(topics, "topic", "left").select("problem_id", F.coalesce("name", F.lit("?")).alias("topic_name"))


@query("SELECT finding_id, intervention FROM findings f WHERE NOT EXISTS (SELECT 1 FROM question_evidence e WHERE e.evidence_type = 'finding' AND e.evidence_id = f.finding_id AND e.line = 1)", "findings", "question_evidence")
def orphans_not_exists(t: Tables) -> DataFrame:
    """Findings that no question has as its first evidence."""
    return E.orphans(t.findings(), t.question_evidence().filter("line = 1")).select("finding_id", "intervention")


@query("SELECT artifact_id, source FROM artifacts WHERE status = 'extracted' AND artifact_id NOT IN (SELECT user_id FROM events)", "artifacts")
def unlinked_not_in(t: Tables) -> DataFrame:
    linked = t.raw("events").select(F.col("user_id").alias("artifact_id")).filter("artifact_id IS NOT NULL")
    return t.artifacts().filter("status = 'extracted'").join(linked, "artifact_id", "left_anti").select("artifact_id", "source")


@query("SELECT question_id, problem_id FROM questions WHERE question_id IN (SELECT question_id FROM question_evidence WHERE evidence_type = 'measurement')", "questions", "question_evidence")
def citing_semi(t: Tables) -> DataFrame:
    return t.questions().join(t.question_evidence().filter("evidence_type = 'measurement'"), "question_id", "left_semi").select("question_id", "problem_id")


@query("SELECT status, min(problem_id) AS next_id FROM problems p WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = problem_id AND o_orderstatus = 'P') GROUP BY 1", "problems")
def next_ready(t: Tables) -> DataFrame:
    published = t.raw("orders").filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("problem_id"))
    return t.problems().join(published, "problem_id", "left_anti").groupBy("status").agg(F.min("problem_id").alias("next_id"))


@query(
    "+e AS (SELECT s_suppkey AS entity_id, lower(trim(unnest([s_name, 'sup ' || s_suppkey, 'nation ' || s_nationkey]))) AS key FROM supplier), k AS (SELECT key, min(entity_id) AS entity_id FROM e GROUP BY 1), n AS (SELECT DISTINCT unnest([' ' || s_name, 'SUP ' || s_suppkey, 'Nation ' || s_nationkey, 'nobody ' || s_suppkey]) AS name FROM supplier) SELECT name, entity_id FROM n LEFT JOIN k ON k.key = lower(trim(name))",
    "studies",
)
def alias_resolution(t: Tables) -> DataFrame:
    s = t.raw("supplier")
    named = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    entities = s.select(F.col("s_suppkey").alias("entity_id"), F.col("s_name").alias("entity_name"), F.array(named("sup ", "s_suppkey"), named("nation ", "s_nationkey")).alias("aliases"))
    names = s.select(F.explode(F.array(named(" ", "s_name"), named("SUP ", "s_suppkey"), named("Nation ", "s_nationkey"), named("nobody ", "s_suppkey"))).alias("name"))
    return E.resolve_aliases(names, entities)


_FOUND = "f AS (SELECT DISTINCT question_id, finding_id, intervention, outcome FROM question_evidence JOIN findings ON finding_id = evidence_id WHERE evidence_type = 'finding')"


@query("+" + _FOUND + " SELECT DISTINCT a.question_id, a.finding_id AS a_id, b.finding_id AS b_id FROM f a JOIN f b ON a.question_id = b.question_id AND a.finding_id < b.finding_id AND (a.intervention = b.intervention OR a.outcome = b.outcome)", "question_evidence", "findings")
def finding_pairs_shared_key(t: Tables) -> DataFrame:
    c = t.question_evidence().filter("evidence_type = 'finding'").join(t.findings(), F.col("evidence_id") == F.col("finding_id"))
    return E.pairs_sharing(c, ["intervention", "outcome"])


@query("SELECT a.indicator, a.subject, a.period, a.source, a.value, b.source AS other_source, b.value AS other_value FROM measurements a JOIN measurements b ON a.indicator = b.indicator AND a.subject = b.subject AND a.period = b.period AND a.source < b.source", "measurements")
def cross_source_pairs(t: Tables) -> DataFrame:
    return E.cross_source_pairs(t.measurements())


@query("+n AS (SELECT subject, source, indicator, max(period) AS period, last(value ORDER BY period) AS value FROM measurements GROUP BY ALL) SELECT a.subject, a.source, a.indicator, a.period, a.value, b.indicator AS b_indicator, b.period AS b_period, b.value AS b_value FROM n a JOIN n b ON a.subject = b.subject AND a.source = b.source AND a.indicator < b.indicator", "measurements")
def representative_pairs(t: Tables) -> DataFrame:
    return E.representative_pairs(t.measurements())


@query(
    "+x AS (SELECT DISTINCT p_brand AS topic, ps.l_suppkey AS problem_id FROM lineitem ps JOIN part ON p_partkey = ps.l_partkey), w AS (SELECT *, CASE WHEN topic IN ('Brand#1', 'Brand#2') THEN 0.25 ELSE 1.0 END AS w FROM x) SELECT a.problem_id AS a, b.problem_id AS b, CAST(sum(a.w) AS DOUBLE) AS score FROM w a JOIN w b ON a.topic = b.topic AND a.problem_id < b.problem_id GROUP BY 1, 2 HAVING sum(a.w) >= 1 AND max(a.w) >= 1",
    "studies",
)
def problem_topic_links(t: Tables) -> DataFrame:
    parts = t.raw("part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("topic"))
    topics = t.raw("lineitem").select("l_partkey", F.col("l_suppkey").alias("problem_id")).join(parts, "l_partkey").select("problem_id", "topic")
    return E.topic_links(topics, ["Brand#1", "Brand#2"])


@query("+n AS (SELECT DISTINCT event_type, floor(9000 + value * 2) / 10 AS number FROM events) SELECT event_type, number, count(*) AS hits, min(p_retailprice) AS nearest_low FROM n JOIN part ON abs(p_retailprice - number) < 0.051 GROUP BY 1, 2", "studies")
def value_band_join(t: Tables) -> DataFrame:
    numbers = t.raw("events").select("event_type", (F.floor(9000 + F.col("value") * 2) / 10).alias("number")).distinct()
    values = t.raw("part").select(F.col("p_retailprice").alias("value"))
    return E.value_bands(numbers, values).groupBy("event_type", "number").agg(F.count("*").alias("hits"), F.min("value").alias("nearest_low"))


@query("SELECT 'artifacts' AS stage, count(*) AS n FROM artifacts UNION ALL SELECT 'extracted', count(*) FILTER (status = 'extracted') FROM artifacts UNION ALL SELECT 'claims', count(*) FROM claims UNION ALL SELECT 'problems', count(*) FROM problems UNION ALL SELECT 'questions', count(*) FROM questions UNION ALL SELECT 'links', count(*) FROM question_evidence", "artifacts", "claims", "problems", "questions", "question_evidence")
def funnel_counts(t: Tables) -> DataFrame:
    counts = lambda df, n: df.agg(F.count("*").alias("n")).select(F.lit(n).alias("stage"), "n")
    a = t.artifacts()
    out = counts(a, "artifacts").unionByName(counts(a.filter("status = 'extracted'"), "extracted")).unionByName(counts(t.claims(), "claims"))
    return out.unionByName(counts(t.problems(), "problems")).unionByName(counts(t.questions(), "questions")).unionByName(counts(t.question_evidence(), "links"))


@query("SELECT o_orderstatus AS status, o_orderpriority AS priority, count(*) AS n FROM orders GROUP BY ALL")
def status_histogram(t: Tables) -> DataFrame:
    return t.raw("orders").groupBy(F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority")).agg(F.count("*").alias("n"))


@query("SELECT s.source, s.tier, count(a.artifact_id) AS artifacts, max(a.artifact_id) AS newest FROM sources s LEFT JOIN artifacts a ON a.source = s.source AND a.status = 'extracted' GROUP BY ALL", "sources", "artifacts")
def source_freshness(t: Tables) -> DataFrame:
    per = t.artifacts().filter("status = 'extracted'").groupBy("source").agg(F.count("*").alias("artifacts"), F.max("artifact_id").alias("newest"))
    return t.sources().join(per, "source", "left").withColumn("artifacts", F.coalesce("artifacts", F.lit(0)))


@query("SELECT l_orderkey AS question_id, count(*) FILTER (l_returnflag = 'R') AS conflict, count(*) FILTER (l_returnflag = 'A') AS agree, count(*) FILTER (l_returnflag NOT IN ('R', 'A')) AS other FROM lineitem GROUP BY 1")
def relation_histogram(t: Tables) -> DataFrame:
    flag = F.col("l_returnflag")
    return t.raw("lineitem").groupBy(F.col("l_orderkey").alias("question_id")).agg(F.count_if(flag == "R").alias("conflict"), F.count_if(flag == "A").alias("agree"), F.count_if(~flag.isin("R", "A")).alias("other"))


@query("+" + _CITED + " SELECT q.problem_id, count(DISTINCT q.question_id) AS questions, count(*) FILTER (c.evidence_type = 'measurement') AS measurements, count(*) FILTER (c.evidence_type = 'finding') AS findings, bool_or(c.question_id IS NOT NULL) AS has_evidence, count(*) FILTER (c.evidence_type = 'finding') > 0 AND count(*) FILTER (c.evidence_type = 'measurement') = 0 AS findings_only FROM questions q LEFT JOIN cited c ON c.question_id = q.question_id GROUP BY 1", *_EQ)
def coverage_summary(t: Tables) -> DataFrame:
    j = t.questions().select("question_id", "problem_id").join(t.question_evidence(), "question_id", "left")
    m, f = F.count_if(F.col("evidence_type") == "measurement"), F.count_if(F.col("evidence_type") == "finding")
    out = j.groupBy("problem_id").agg(F.countDistinct("question_id").alias("questions"), m.alias("measurements"), f.alias("findings"), F.count("evidence_type").alias("k"))
    return out.select("problem_id", "questions", "measurements", "findings", (F.col("k") > 0).alias("has_evidence"), ((F.col("findings") > 0) & (F.col("measurements") == 0)).alias("findings_only"))


@query("SELECT o_custkey AS problem_id, count(*) AS rounds, max(o_orderkey) AS last_round, last(o_totalprice ORDER BY o_orderdate, o_orderkey) AS last_score FROM orders GROUP BY 1")
def score_rounds(t: Tables) -> DataFrame:
    return t.raw("orders").groupBy(F.col("o_custkey").alias("problem_id")).agg(F.count("*").alias("rounds"), F.max("o_orderkey").alias("last_round"), F.max_by("o_totalprice", F.struct("o_orderdate", "o_orderkey")).alias("last_score"))


@query("SELECT least(greatest(l_quantity / 10, 0), 2) + least(greatest(l_discount * 100, 0), 2) + least(greatest(l_tax * 100, 0), 1) AS total, count(*) AS n FROM lineitem GROUP BY 1 HAVING total >= 0")
def score_clamped(t: Tables) -> DataFrame:
    part = lambda c, top: F.least(F.greatest(c, F.lit(0)), F.lit(top))
    total = part(F.col("l_quantity") / 10, 2) + part(F.col("l_discount") * 100, 2) + part(F.col("l_tax") * 100, 1)
    return t.raw("lineitem").groupBy(total.alias("total")).agg(F.count("*").alias("n"))


@query("SELECT CASE o_orderstatus WHEN 'F' THEN 'resolved' ELSE 'unresolved' END AS state, count(*) AS issued, count(*) FILTER (o_orderpriority LIKE '1%') AS hits, round(avg(CASE o_orderstatus WHEN 'F' THEN CASE WHEN o_orderpriority LIKE '1%' THEN 1.0 WHEN o_orderpriority LIKE '2%' THEN 0.5 ELSE 0.0 END END), 4) AS mean_score FROM orders GROUP BY 1")
def forecast_record(t: Tables) -> DataFrame:
    p = F.col("o_orderpriority")
    score = F.when(F.col("o_orderstatus") == "F", F.when(p.like("1%"), 1.0).when(p.like("2%"), 0.5).otherwise(0.0))
    state = F.when(F.col("o_orderstatus") == "F", "resolved").otherwise("unresolved")
    return t.raw("orders").groupBy(state.alias("state")).agg(F.count("*").alias("issued"), F.count_if(p.like("1%")).alias("hits"), F.round(F.avg(score), 4).alias("mean_score"))


@query("SELECT question_id, asked + 180 AS due FROM questions WHERE asked + 180 <= DATE '1998-06-30'", "questions")
def due_forecasts(t: Tables) -> DataFrame:
    return t.questions().select("question_id", F.date_add("asked", 180).alias("due")).filter(F.col("due") <= F.lit("1998-06-30").cast("date"))


@query("+m AS (SELECT f.finding_id, f.study_id, substr(f.statement, 1, 120) AS head, f.effect_size, f.intervention, s.year FROM findings f JOIN studies s USING (study_id) WHERE s.quality IS DISTINCT FROM 'rejected'), d AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY study_id, head ORDER BY finding_id) = 1) SELECT study_id, finding_id, row_number() OVER (PARTITION BY study_id ORDER BY effect_size IS NOT NULL DESC, intervention IS NOT NULL DESC, year DESC, finding_id) AS place FROM d QUALIFY place <= 4", "findings", "studies")
def mechanisms_top4(t: Tables) -> DataFrame:
    m = t.findings().join(t.studies().filter(R.not_rejected(F.col("quality"))), "study_id").withColumn("head", F.substring("statement", 1, 120))
    d = top_k(m, ["study_id", "head"], [F.asc("finding_id")], 1)
    order = [F.col("effect_size").isNotNull().desc(), F.col("intervention").isNotNull().desc(), F.desc("year"), F.asc("finding_id")]
    return E.top_rows(d, ["study_id"], order, 4).select("study_id", "finding_id", "place")


@query("+h AS (SELECT DISTINCT regexp_replace(regexp_extract(lower(url), '^[a-z]+://([^/:?#]+)', 1), '^www\\.', '') AS host FROM pages) SELECT 'study' AS kind, title AS name, y AS place FROM (SELECT title, row_number() OVER (ORDER BY year DESC, title) AS y FROM studies) WHERE y <= 3 UNION ALL SELECT 'host', host, y FROM (SELECT host, row_number() OVER (ORDER BY host) AS y FROM h) WHERE y <= 2", "studies")
def citations_3_plus_2(t: Tables) -> DataFrame:
    from pyspark.sql import Window

    studies = t.studies().orderBy(F.desc("year"), "title").limit(3).select(F.lit("study").alias("kind"), F.col("title").alias("name"), F.row_number().over(Window.orderBy(F.desc("year"), "title")).alias("place"))
    hosts = t.raw("pages").select(T.host(F.col("url")).alias("name")).distinct().orderBy("name").limit(2).select(F.lit("host").alias("kind"), "name", F.row_number().over(Window.orderBy("name")).alias("place"))
    return studies.unionByName(hosts)


@query("SELECT problem_id, CASE WHEN count(*) FILTER (evidence_type = 'measurement') >= 2 THEN 'data_spotlight' WHEN count(*) FILTER (evidence_type = 'finding') >= 3 THEN 'listicle' WHEN count(*) FILTER (evidence_type = 'finding') = 1 THEN 'qa' ELSE 'narrative' END AS format FROM question_evidence JOIN questions USING (question_id) GROUP BY 1", *_EQ)
def format_pick(t: Tables) -> DataFrame:
    c = t.question_evidence().join(t.questions().select("question_id", "problem_id"), "question_id")
    g = c.groupBy("problem_id").agg(F.count_if(F.col("evidence_type") == "measurement").alias("m"), F.count_if(F.col("evidence_type") == "finding").alias("f"))
    return g.select("problem_id", R.post_format(F.col("m"), F.col("f"), F.lit(False)).alias("format"))


@query("SELECT question_id, CASE WHEN bool_or(l_shipdate > TIMESTAMP '2001-11-01') THEN 'deferred' WHEN bool_or(evidence_type = 'measurement') THEN 'answered' WHEN bool_or(l_linestatus = 'O') THEN 'unmappable' ELSE 'no_evidence' END AS status FROM question_evidence JOIN lineitem ON l_orderkey = question_id AND l_linenumber = line AND l_partkey = evidence_id GROUP BY 1", "question_evidence")
def question_status_fsm(t: Tables) -> DataFrame:
    g = t.raw("lineitem").groupBy(F.col("l_orderkey").alias("question_id")).agg(
        F.bool_or(F.col("l_shipdate") > F.lit("2001-11-01").cast("timestamp_ntz")).alias("failed"), F.bool_or(F.col("l_returnflag") == "R").alias("evidence"), F.bool_or(F.col("l_linestatus") == "O").alias("unmappable")
    )
    return g.select("question_id", R.question_status(F.col("failed"), F.col("evidence"), F.col("unmappable")).alias("status"))


@query("SELECT q.question_id, string_agg(e.evidence_type || ':' || e.evidence_id, '; ' ORDER BY e.evidence_type, e.evidence_id, e.line) AS answer, count(*) AS n FROM questions q JOIN question_evidence e USING (question_id) GROUP BY 1", *_EQ)
def question_answers(t: Tables) -> DataFrame:
    j = t.questions().select("question_id").join(t.question_evidence(), "question_id")
    each = F.array_sort(F.collect_list(F.struct("evidence_type", "evidence_id", "line")))
    said = F.array_join(F.transform(each, lambda x: F.concat_ws(":", x["evidence_type"], x["evidence_id"].cast("string"))), "; ")
    return j.groupBy("question_id").agg(said.alias("answer"), F.count("*").alias("n"))


@query("SELECT finding_id, CASE WHEN trim(coalesce(intervention, '')) <> '' THEN 'adopt ' || intervention WHEN trim(outcome) <> '' THEN 'target ' || outcome END AS lever, effect_size IS NOT NULL AS grounded FROM findings WHERE study_id IS NOT NULL", "findings")
def solution_levers(t: Tables) -> DataFrame:
    lever = F.when(F.trim(F.coalesce("intervention", F.lit(""))) != "", F.concat(F.lit("adopt "), "intervention")).when(F.trim("outcome") != "", F.concat(F.lit("target "), "outcome"))
    return t.findings().filter("study_id IS NOT NULL").select("finding_id", lever.alias("lever"), F.col("effect_size").isNotNull().alias("grounded")).filter("lever IS NOT NULL")


@query("+" + _CITED + " SELECT problem_id, count(DISTINCT question_id) AS questions, count(*) AS evidence FROM cited GROUP BY 1", *_EQ)
def evidence_per_problem(t: Tables) -> DataFrame:
    c = t.question_evidence().join(t.questions().select("question_id", "problem_id"), "question_id")
    return c.groupBy("problem_id").agg(F.countDistinct("question_id").alias("questions"), F.count("*").alias("evidence"))


@query("SELECT problem_id, statement, status FROM problems WHERE status IN ('ready', 'candidate') AND problem_id >= (SELECT max(problem_id) - 6 FROM problems) ORDER BY problem_id DESC LIMIT 5", "problems")
def newest_proposals(t: Tables) -> DataFrame:
    p = t.problems()
    top = p.agg((F.max("problem_id") - 6).alias("low"))
    return p.filter(F.col("status").isin("ready", "candidate")).join(F.broadcast(top), F.col("problem_id") >= F.col("low")).orderBy(F.desc("problem_id")).limit(5).select("problem_id", "statement", "status")
