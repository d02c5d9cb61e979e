"""Queries: write patterns, links to entities and interventions, ledgers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.operators import evidence as E
from gleaner.operators import records as W
from gleaner.operators.common import top_k, upsert
from gleaner.plans.registry import query
from gleaner.plans.tables import Tables

_LEDGER = "ledger AS (SELECT o_custkey AS problem_id, o_orderkey AS entry, CAST(o_orderdate AS DATE) AS day, o_orderpriority AS indicators FROM orders)"


def _ledger(t: Tables) -> DataFrame:
    return t.raw("orders").select(F.col("o_custkey").alias("problem_id"), F.col("o_orderkey").alias("entry"), F.to_date("o_orderdate").alias("day"), F.col("o_orderpriority").alias("indicators"))


@query("+" + _LEDGER + ", d AS (SELECT max(day) AS today FROM ledger), g AS (SELECT DISTINCT problem_id FROM ledger JOIN problems p USING (problem_id), d WHERE day = today AND p.status = 'published') SELECT p.problem_id, CASE WHEN g.problem_id IS NOT NULL THEN 'ready' ELSE p.status END AS status, (SELECT count(*) FROM ledger l, d WHERE l.problem_id = p.problem_id AND NOT (day = today AND p.status = 'published')) AS entries FROM problems p LEFT JOIN g USING (problem_id)", "problems")
def publish_revert(t: Tables) -> DataFrame:
    ledger = _ledger(t)
    newest = ledger.agg(F.max("day").alias("today")).first()["today"]
    left, problems = W.reverted(ledger, t.problems(), t.problems().filter("status = 'published'").select("problem_id"), "problem_id", "day", F.lit(newest))
    n = left.groupBy("problem_id").agg(F.count("*").alias("entries"))
    return problems.join(n, "problem_id", "left").select("problem_id", "status", F.coalesce("entries", F.lit(0)).alias("entries"))


@query("SELECT finding_id, study_id, statement, CAST(NULL AS VARCHAR) AS population, CASE WHEN study_id IS NULL THEN 'legacy: news-derived' END AS quality FROM findings", "findings")
def schema_migration(t: Tables) -> DataFrame:
    return W.migrated(t.findings(), "finding_id long, study_id long, statement string, population string, quality string", F.col("study_id").isNull(), "legacy: news-derived")


@query("SELECT l_orderkey AS event_id, '  ' || l_returnflag || '  ' <> l_returnflag AS was_padded, l_returnflag AS name, '[' || string_agg(l_partkey, ',' ORDER BY l_linenumber, l_partkey) || ']' AS parts, coalesce(max(CASE WHEN l_tax > 0.04 THEN l_tax END), 0) AS importance, CAST(NULL AS VARCHAR) AS note FROM lineitem GROUP BY l_orderkey, l_returnflag")
def record_insert(t: Tables) -> DataFrame:
    li = t.raw("lineitem").groupBy("l_orderkey", "l_returnflag").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("x"), F.max(F.when(F.col("l_tax") > 0.04, F.col("l_tax"))).alias("importance"))
    rows = li.select(F.col("l_orderkey").alias("event_id"), F.lit(True).alias("was_padded"), F.concat(F.lit("  "), "l_returnflag", F.lit("  ")).alias("name"), F.transform("x", lambda s: s["l_partkey"]).alias("parts"), "importance")
    return W.conformed(rows, "event_id long, was_padded boolean, name string, parts string, importance double, note string", lists=("parts",), trimmed=("name",), zeros=("importance",))


@query("+c AS (SELECT question_id, max(evidence_type) AS answer FROM question_evidence WHERE evidence_type = 'measurement' GROUP BY 1) SELECT q.question_id, CASE WHEN c.question_id IS NOT NULL THEN 'answered' ELSE 'open' END AS status, coalesce(c.answer, 'none yet') AS answer FROM questions q LEFT JOIN c USING (question_id)", "question_evidence", "questions")
def status_updates(t: Tables) -> DataFrame:
    table = t.questions().select("question_id", F.lit("open").alias("status"), F.lit("none yet").alias("answer"))
    changes = t.question_evidence().filter("evidence_type = 'measurement'").groupBy("question_id").agg(F.max("evidence_type").alias("answer")).withColumn("status", F.lit("answered"))
    return W.updated(table, changes, "question_id", ["status", "answer"])


@query("+n AS (SELECT artifact_id AS item, content_hash, length(trim(regexp_replace(content, '\\s+', ' ', 'g'))) AS k FROM artifacts WHERE artifact_id % 3 = 0), o AS (SELECT content_hash, min(artifact_id) AS known FROM artifacts WHERE artifact_id % 3 <> 0 GROUP BY 1), f AS (SELECT content_hash, min(item) AS first FROM n WHERE k >= 200 GROUP BY 1) SELECT item, coalesce(known, first) AS artifact_id, known IS NULL AS is_new, 2 AS source_id FROM n JOIN f USING (content_hash) LEFT JOIN o USING (content_hash) WHERE k >= 200", "artifacts")
def store_item(t: Tables) -> DataFrame:
    a = t.artifacts()
    return W.stored(a.filter("artifact_id % 3 = 0").select(F.col("artifact_id").alias("item"), "content"), a.filter("artifact_id % 3 <> 0"), "content", "item")


@query("+" + _LEDGER + ", n AS (SELECT problem_id, 'fresh ' || problem_id AS indicators FROM problems WHERE problem_id % 4 = 1), m AS (SELECT problem_id, max(entry) AS entry FROM ledger GROUP BY 1) SELECT l.problem_id, l.entry, CASE WHEN m.entry = l.entry AND n.indicators IS NOT NULL THEN n.indicators ELSE l.indicators END AS indicators FROM ledger l JOIN m USING (problem_id) LEFT JOIN n ON n.problem_id = l.problem_id UNION ALL SELECT problem_id, 0, indicators FROM n WHERE problem_id NOT IN (SELECT problem_id FROM ledger)", "problems")
def ledger_attach(t: Tables) -> DataFrame:
    new = t.problems().filter("problem_id % 4 = 1").select("problem_id", F.concat(F.lit("fresh "), F.col("problem_id").cast("string")).alias("indicators"))
    return W.attached(_ledger(t).drop("day"), new, "problem_id", "entry", "indicators")


@query("+" + _LEDGER + ", x AS (SELECT problem_id, indicators, max((day, entry)) AS last_seen FROM ledger GROUP BY 1, 2) SELECT problem_id, indicators, row_number() OVER (PARTITION BY problem_id ORDER BY last_seen DESC, indicators) AS place FROM x QUALIFY place <= 40", "problems")
def recent_indicators(t: Tables) -> DataFrame:
    return W.recent_items(_ledger(t), ["problem_id"], ["day", "entry"], "indicators")


@query("SELECT s.s_suppkey AS study_id, s.s_nationkey AS nation, coalesce(o.k, f.k) AS record_id, o.k IS NULL AND f.k = s_suppkey AS created FROM supplier s JOIN (SELECT s_nationkey, min(s_suppkey) AS k FROM supplier WHERE s_suppkey % 2 = 0 GROUP BY 1) f USING (s_nationkey) LEFT JOIN (SELECT s_nationkey, min(s_suppkey) AS k FROM supplier WHERE s_suppkey % 2 = 1 GROUP BY 1) o USING (s_nationkey) WHERE s_suppkey % 2 = 0")
def study_get_or_create(t: Tables) -> DataFrame:
    s = t.raw("supplier").select(F.col("s_suppkey").alias("study_id"), F.col("s_nationkey").alias("nation"))
    return W.get_or_create(s.filter("study_id % 2 = 0"), s.filter("study_id % 2 = 1"), ["nation"], "study_id")


@query("SELECT p_brand AS topic, CASE WHEN count(*) FILTER (p_size > 25) > 0 THEN 'new ' || max(p_type) FILTER (p_size > 25) ELSE 'old ' || max(p_type) END AS label FROM part WHERE p_size > 25 OR p_partkey % 2 = 0 GROUP BY 1")
def topic_upsert(t: Tables) -> DataFrame:
    p = t.raw("part")
    one = lambda df, mark: df.groupBy(F.col("p_brand").alias("topic")).agg(F.concat(F.lit(mark), F.max("p_type")).alias("label"))
    return upsert(one(p.filter("p_partkey % 2 = 0"), "old "), one(p.filter("p_size > 25"), "new "), ["topic"])


@query("WITH o AS (SELECT l_orderkey AS question_id, l_partkey AS evidence_id, min(l_linenumber) AS line FROM lineitem WHERE l_linenumber <= 2 GROUP BY 1, 2), n AS (SELECT l_orderkey AS question_id, l_partkey % 100 AS evidence_id, min(l_linenumber) AS line FROM lineitem WHERE l_linenumber > 2 GROUP BY 1, 2) SELECT * FROM o UNION ALL SELECT * FROM n WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.question_id = n.question_id AND o.evidence_id = n.evidence_id)")
def link_insert_ignore(t: Tables) -> DataFrame:
    li = t.raw("lineitem")
    old = li.filter("l_linenumber <= 2").groupBy(F.col("l_orderkey").alias("question_id"), F.col("l_partkey").alias("evidence_id")).agg(F.min("l_linenumber").alias("line"))
    new = li.filter("l_linenumber > 2").select(F.col("l_orderkey").alias("question_id"), (F.col("l_partkey") % 100).alias("evidence_id"), F.col("l_linenumber").alias("line"))
    return W.linked_once(new, old, ["question_id", "evidence_id"], [F.asc("line")])


_LOCAL = """m AS (SELECT (l_orderkey * 8 + l_linenumber) * 1000000 + l_partkey AS measurement_id, l_orderkey AS artifact_id, p_brand AS name, min(CASE WHEN l_linenumber = 1 THEN l_suppkey END) AS entity_id FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2, 3),
near AS (SELECT o_orderkey AS artifact_id, 'Brand#' || (o_custkey % 5 + 1) || (o_orderkey % 5 + 1) AS name, o_custkey AS entity_id FROM orders), far AS (SELECT p_brand AS name, min(p_partkey) AS far FROM part WHERE p_size < 30 GROUP BY 1),
r AS (SELECT m.*, coalesce(n.entity_id, far.far) AS resolved FROM m LEFT JOIN near n ON n.artifact_id = m.artifact_id AND n.name = m.name LEFT JOIN far ON far.name = m.name)"""


def _subjects(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    brand = t.raw("part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("name"))
    key = (F.col("l_orderkey") * 8 + F.col("l_linenumber")) * 1_000_000 + F.col("l_partkey")
    m = t.raw("lineitem").join(brand, "l_partkey").groupBy(key.alias("measurement_id"), F.col("l_orderkey").alias("artifact_id"), "name").agg(F.min(F.when(F.col("l_linenumber") == 1, F.col("l_suppkey"))).alias("entity_id"))
    named = F.concat(F.lit("Brand#"), (F.col("o_custkey") % 5 + 1).cast("string"), (F.col("o_orderkey") % 5 + 1).cast("string"))
    local = t.raw("orders").select(F.col("o_orderkey").alias("artifact_id"), named.alias("name"), F.col("o_custkey").alias("entity_id"))
    known = t.raw("part").filter("p_size < 30").select(F.col("p_brand").alias("name"), F.col("p_partkey").alias("entity_id"))
    return m, local, known


@query("WITH " + _LOCAL + " SELECT measurement_id, name, resolved AS entity_id FROM r")
def subject_resolution(t: Tables) -> DataFrame:
    m, local, known = _subjects(t)
    return E.resolve_subjects(m.drop("entity_id"), local, known).select("measurement_id", "name", "entity_id")


@query("WITH " + _LOCAL + " SELECT measurement_id, name, resolved AS entity_id FROM (SELECT m.*, far.far AS resolved FROM m JOIN far USING (name))")
def existing_subjects(t: Tables) -> DataFrame:
    """Subjects resolved to known entities only: nothing is created, what isn't known is left out."""
    m, local, known = _subjects(t)
    none = local.filter("false")
    return E.resolve_subjects(m.drop("entity_id"), none, known).filter("entity_id IS NOT NULL").select("measurement_id", "name", "entity_id")


@query("WITH " + _LOCAL + " SELECT measurement_id, coalesce(entity_id, resolved) AS entity_id FROM r")
def subject_backfill(t: Tables) -> DataFrame:
    m, local, known = _subjects(t)
    resolved = E.resolve_subjects(m.drop("entity_id"), local, known)
    # from a million parts on, two measurements of an artifact may go by one number
    return W.backfilled(m, resolved, ["measurement_id", "artifact_id", "name"]).select("measurement_id", "entity_id")


@query("+f AS (SELECT problem_id, indicator, taken_at + 1 AS taken_at, value FROM snapshots) SELECT * FROM snapshots UNION ALL SELECT * FROM f WHERE NOT EXISTS (SELECT 1 FROM snapshots s WHERE s.problem_id = f.problem_id AND s.indicator = f.indicator AND s.taken_at = f.taken_at)", "snapshots")
def snapshot_append(t: Tables) -> DataFrame:
    s = t.snapshots()
    return W.appended(s, s.withColumn("taken_at", F.date_add("taken_at", 1)), ["problem_id", "indicator", "taken_at"])


_ENTITIES = "pe AS (SELECT DISTINCT o_custkey AS problem_id, l_suppkey AS entity_id FROM orders JOIN lineitem ON l_orderkey = o_orderkey), e AS (SELECT s_suppkey AS entity_id, s_name AS name FROM supplier)"


def _entities(t: Tables) -> tuple[DataFrame, DataFrame]:
    li = t.raw("lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_suppkey").alias("entity_id"))
    links = t.raw("orders").select("o_orderkey", F.col("o_custkey").alias("problem_id")).join(li, "o_orderkey").select("problem_id", "entity_id").distinct()
    return links, t.raw("supplier").select(F.col("s_suppkey").alias("entity_id"), F.col("s_name").alias("name"))


@query("+" + _ENTITIES + ", f AS (SELECT problem_id, min(entity_id) AS entity_id FROM pe JOIN e USING (entity_id) GROUP BY 1) SELECT q.question_id, f.entity_id, e.name FROM questions q JOIN f USING (problem_id) JOIN e ON e.entity_id = f.entity_id", "questions")
def question_subject(t: Tables) -> DataFrame:
    """Each question's subject: the first (smallest id) entity of its problem."""
    links, entities = _entities(t)
    return E.subjects(t.questions(), links, entities)


@query("+" + _ENTITIES + " SELECT problem_id, count(*) AS n, string_agg(name, ', ' ORDER BY entity_id) AS entities FROM pe JOIN e USING (entity_id) GROUP BY 1", "questions")
def problem_entities(t: Tables) -> DataFrame:
    links, entities = _entities(t)
    each = F.array_sort(F.collect_list(F.struct("entity_id", "name")))
    return links.join(entities, "entity_id").groupBy("problem_id").agg(F.count("*").alias("n"), F.array_join(F.transform(each, lambda x: x["name"]), ", ").alias("entities"))


_LEVERS = "pi AS (SELECT DISTINCT o_custkey AS problem_id, l_partkey AS part FROM orders JOIN lineitem ON l_orderkey = o_orderkey), i AS (SELECT p_partkey AS part, p_name AS name, CASE WHEN p_size % 3 = 0 THEN '  ' WHEN p_size % 5 = 0 THEN NULL ELSE p_container END AS relevance, p_size % 7 = 0 AS quarantined FROM (SELECT *, p_brand AS p_container FROM part))"


def _levers(t: Tables) -> tuple[DataFrame, DataFrame]:
    li = t.raw("lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_partkey").alias("part"))
    links = t.raw("orders").select("o_orderkey", F.col("o_custkey").alias("problem_id")).join(li, "o_orderkey").select("problem_id", "part").distinct()
    relevance = F.when(F.col("p_size") % 3 == 0, "  ").when(F.col("p_size") % 5 == 0, F.lit(None)).otherwise(F.col("p_brand"))
    return links, t.raw("part").select(F.col("p_partkey").alias("part"), F.col("p_name").alias("name"), relevance.alias("relevance"), (F.col("p_size") % 7 == 0).alias("quarantined"))


@query("+" + _LEVERS + " SELECT problem_id, part, name, relevance, coalesce(trim(relevance), '') <> '' AS verified FROM pi JOIN i USING (part)", "problems")
def candidate_interventions(t: Tables) -> DataFrame:
    """Interventions of each problem; verified ones state their relevance. Nothing is held back here."""
    links, levers = _levers(t)
    return E.interventions(links, levers, "part").drop("quarantined")


@query("+" + _LEVERS + " SELECT problem_id, part, name, relevance, coalesce(trim(relevance), '') <> '' AS verified FROM pi JOIN i USING (part) WHERE NOT quarantined", "problems")
def dossier_interventions(t: Tables) -> DataFrame:
    links, levers = _levers(t)
    return E.interventions(links, levers.filter(~F.col("quarantined")), "part").drop("quarantined")


@query("+c AS (SELECT DISTINCT o_custkey AS problem_id, proposition FROM claims JOIN orders ON o_orderkey = artifact_id), k AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY problem_id ORDER BY len(regexp_extract_all(proposition, '[0-9]')) DESC, proposition) <= 10) SELECT question_id, problem_id, proposition FROM questions JOIN k USING (problem_id)", "claims", "questions")
def claims_to_every_question(t: Tables) -> DataFrame:
    """The ten claims of a problem with the most figures, to each of its questions."""
    links = t.raw("orders").select(F.col("o_orderkey").alias("artifact_id"), F.col("o_custkey").alias("problem_id"))
    c = t.claims().join(links, "artifact_id").select("problem_id", "proposition").distinct()
    best = top_k(c, ["problem_id"], [F.desc(F.regexp_count("proposition", F.lit("[0-9]"))), F.asc("proposition")], 10)
    return W.cartesian_links(t.questions().select("question_id", "problem_id"), best, "problem_id").select("question_id", "problem_id", "proposition")


@query("SELECT problem_id, question_id AS target FROM questions QUALIFY row_number() OVER (PARTITION BY problem_id ORDER BY asked, question_id) = 1", "questions")
def link_targets(t: Tables) -> DataFrame:
    """The question new links of a problem go to: its first by rank."""
    return t.questions().groupBy("problem_id").agg(F.min_by("question_id", F.struct("asked", "question_id")).alias("target"))


@query("SELECT o_custkey AS post, o_orderkey AS version, o_orderstatus AS status FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def newest_post_versions(t: Tables) -> DataFrame:
    posts = t.raw("orders").select(F.col("o_custkey").alias("post"), F.col("o_orderkey").alias("version"), F.col("o_orderstatus").alias("status"), "o_orderdate")
    return W.newest_versions(posts, "post", ["o_orderdate", "version"]).select("post", "version", "status")


@query("SELECT artifact_id, pos, proposition FROM claims QUALIFY row_number() OVER (PARTITION BY artifact_id ORDER BY pos) <= 14", "claims")
def claims_shown(t: Tables) -> DataFrame:
    return top_k(t.claims(), ["artifact_id"], [F.asc("pos")], 14).select("artifact_id", "pos", "proposition")


@query("+" + "s AS (SELECT c_custkey AS problem_id, n_name AS subject FROM customer JOIN nation ON n_nationkey = c_nationkey), k AS (SELECT subject, count(DISTINCT indicator) AS indicators, count(DISTINCT indicator) FILTER (indicator IN (SELECT indicator FROM registry)) AS registered FROM measurements GROUP BY 1) SELECT problem_id, coalesce(indicators, 0) AS indicators, coalesce(registered, 0) AS registered FROM s LEFT JOIN k USING (subject)", "measurements", "registry")
def problem_indicators(t: Tables) -> DataFrame:
    """Distinct indicators of each problem's subject, and how many of them are registered."""
    known = t.registry().select("indicator", F.lit(True).alias("known"))
    each = t.measurements().select("subject", "indicator").distinct().join(F.broadcast(known), "indicator", "left")
    k = each.groupBy("subject").agg(F.count("*").alias("indicators"), F.count("known").alias("registered"))
    return t.problem_subjects().join(k, "subject", "left").select("problem_id", F.coalesce("indicators", F.lit(0)).alias("indicators"), F.coalesce("registered", F.lit(0)).alias("registered"))
