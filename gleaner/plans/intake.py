"""Queries: intake, retrieval, mentions, stats, forecasts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.operators import intake as I
from gleaner.operators import series as S
from gleaner.operators.common import top_k
from gleaner.plans.registry import query
from gleaner.plans.tables import Tables

_QS = ", ".join(f"'{w}'" for w in I.QUERY_STOP)


def _words(c: str) -> str:
    return rf"list_filter(list_transform(regexp_split_to_array(regexp_replace(regexp_replace(replace(lower({c}), '?', ' '), '^({'|'.join(I.LEADS)})+', ''), ',', ' ', 'g'), '\s+'), lambda w: regexp_replace(w, '^[^a-zA-Z0-9_]+|[^a-zA-Z0-9_]+$', '', 'g')), lambda w: length(w) > 3 AND w NOT IN ({_QS}))"


@query(f"SELECT question_id, CAST(len(list_distinct({_words('question')})) AS VARCHAR) AS n_words, array_to_string(list_sort(list_distinct({_words('question')})), ' ') AS words FROM questions", "questions")
def query_words(t: Tables) -> DataFrame:
    w = I.query_words(F.col("question"))
    return t.questions().select("question_id", F.size(w).cast("string").alias("n_words"), F.array_join(F.array_sort(w), " ").alias("words"))


@query()
def query_phrases(t: Tables) -> DataFrame:
    return I.query_phrases(t.questions(), t.problems())


@query(
    r"WITH a AS (SELECT doc_id AS id, source, lang = 'en' AS preferred, CASE WHEN n_chars % 3 > 0 THEN n_chars END AS at_, array_to_string(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda w: w <> '')[1:8], ' ') AS stem FROM documents), o AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY source, stem ORDER BY id) = 1) SELECT source, id, row_number() OVER (PARTITION BY source ORDER BY preferred DESC, at_ DESC NULLS LAST, id) AS place FROM o QUALIFY place <= 5"
)
def story_hunt(t: Tables) -> DataFrame:
    a = t.raw("documents").select(F.col("doc_id").alias("id"), "source", "text", (F.col("lang") == "en").alias("preferred"), F.when(F.col("n_chars") % 3 > 0, F.col("n_chars")).alias("seen"))
    return I.story_hunt(a, "source", "text", "preferred", "seen").select("source", "id", "place")


@query("+c AS (SELECT problem_id, count(DISTINCT question_id) AS q, count(evidence_id) AS e FROM questions LEFT JOIN question_evidence USING (question_id) GROUP BY 1) SELECT p.problem_id, CASE WHEN coalesce(e, 0) > 0 THEN 'ready' ELSE 'candidate' END AS status FROM problems p LEFT JOIN c USING (problem_id) WHERE status = 'candidate' AND topic IS NOT NULL AND (coalesce(q, 0) > 0 OR coalesce(e, 0) > 0)", "problems", "questions", "question_evidence")
def intake_promotion(t: Tables) -> DataFrame:
    j = t.questions().select("question_id", "problem_id").join(t.question_evidence(), "question_id", "left")
    counts = j.groupBy("problem_id").agg(F.countDistinct("question_id").alias("questions"), F.count("evidence_id").alias("evidence"))
    p = t.problems().withColumn("relevant", F.when(F.col("topic").isNotNull(), "yes").otherwise("no"))
    return I.promotable(p, counts, "relevant")


@query("SELECT artifact_id, CASE WHEN length(content) > 300 THEN content[1:300] || '...' ELSE content END AS summary, 0.8::DOUBLE AS confidence FROM artifacts a WHERE status = 'extracted' AND NOT EXISTS (SELECT 1 FROM events e WHERE e.user_id = a.artifact_id) AND NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = a.artifact_id AND l.quality = 0)", "artifacts")
def eligible_events(t: Tables) -> DataFrame:
    linked = t.raw("events").select(F.col("user_id").alias("artifact_id"))
    verdicts = t.raw("labels").select(F.col("doc_id").alias("artifact_id"), (F.col("quality") == 1).alias("eligible"))
    return I.eligible_events(t.artifacts(), linked, verdicts)


_POST = "p AS (SELECT question_id, question || CASE WHEN question_id % 3 = 0 THEN ' Price index at ' || question_id % 50 WHEN question_id % 3 = 1 THEN ' Exports of goods rose a lot, as all reports that came in over the season agree' ELSE ' Unemployment rate' END AS post FROM questions)"


@query(
    "+" + _POST + r", l AS (SELECT DISTINCT trim(label) AS l, trim(regexp_replace(label, '\s*\([^)]*\)\s*', '', 'g')) AS b FROM registry), h AS (SELECT question_id, post, l, CASE WHEN contains(post, l) THEN l WHEN contains(post, b) THEN b END AS h FROM p CROSS JOIN l) SELECT question_id, l AS label, regexp_matches(substr(post, greatest(instr(post, h) - 40, 1), instr(post, h) - greatest(instr(post, h) - 40, 1) + length(h) + 40), '[0-9]') AS figured FROM h WHERE h IS NOT NULL",
    "questions", "registry",
)
def label_mentions(t: Tables) -> DataFrame:
    k = F.col("question_id")
    said = F.when(k % 3 == 0, F.concat(F.lit(" Price index at "), (k % 50).cast("string"))).when(k % 3 == 1, " Exports of goods rose a lot, as all reports that came in over the season agree").otherwise(" Unemployment rate")
    posts = t.questions().select(k, F.concat("question", said).alias("post"))
    return I.mentions(posts, t.registry(), "question_id", "post", "label")


_STAT_TEXT = "s AS (SELECT o_orderkey AS k, 'در سال 1998 رقم ' || CAST(o_custkey AS VARCHAR) || CASE o_orderkey % 3 WHEN 0 THEN ' درصد' WHEN 1 THEN ' میلیون' ELSE '' END || ' و 0 بود' AS s FROM orders)"


@query("WITH " + _STAT_TEXT + " SELECT k, CAST(o AS DOUBLE) AS total, least(length(CAST(o AS VARCHAR)), 6) + CASE k % 3 WHEN 0 THEN 4 WHEN 1 THEN 3 ELSE 0 END AS score FROM (SELECT k, o_custkey AS o FROM s JOIN orders ON o_orderkey = k) WHERE o > 0 AND NOT (k % 3 = 2 AND o BETWEEN 1300 AND 2100)")
def stat_extraction(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    unit = F.when(k % 3 == 0, " درصد").when(k % 3 == 1, " میلیون").otherwise("")
    s = t.raw("orders").select(k.alias("k"), F.concat(F.lit("در سال 1998 رقم "), F.col("o_custkey").cast("string"), unit, F.lit(" و 0 بود")).alias("s"))
    return s.select("k", F.explode(I.stats(F.col("s"))).alias("x")).groupBy("k").agg(F.sum("x.value").alias("total"), F.max("x.score").alias("score"))


@query("SELECT o_orderkey AS k, CASE o_orderkey % 3 WHEN 0 THEN 'From 5 to 7 days, ' || o_custkey * 1000000 WHEN 1 THEN 'about 12 and ' || o_custkey * 1000 || ' more' ELSE 'Someone has 2.5 apples' END AS plain FROM orders")
def number_words(t: Tables) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey").cast("string")
    text = F.when(k % 3 == 0, F.concat(F.lit("From five to Seven days, "), c, F.lit(" million"))).when(k % 3 == 1, F.concat(F.lit("about dozen and "), c, F.lit(" thousand more"))).otherwise("Someone has 2.5 apples")
    return t.raw("orders").select(k.alias("k"), I.spelled_numbers(text).alias("plain"))


@query(
    "+r AS (SELECT * FROM measurements QUALIFY row_number() OVER (PARTITION BY subject, indicator, source ORDER BY period DESC) <= 6), s AS (SELECT subject, indicator, source, count(*) AS points, last(value ORDER BY period) AS last_value FROM r GROUP BY ALL HAVING count(*) >= 4), w AS (SELECT subject, indicator, source, count(*) AS length FROM measurements GROUP BY ALL) SELECT subject, indicator, source, points, last_value, length FROM s JOIN w USING (subject, indicator, source) QUALIFY row_number() OVER (PARTITION BY subject ORDER BY length DESC, indicator, source) = 1",
    "measurements",
)
def forecast_series(t: Tables) -> DataFrame:
    return I.forecast_series(t.measurements(), ["subject", "indicator", "source"])


@query("SELECT o_orderkey, least(greatest(coalesce(CASE WHEN o_orderkey % 4 > 0 THEN (o_custkey % 100) / 100 END, 0.5), 0.5), 0.95) AS p FROM orders")
def forecast_probability(t: Tables) -> DataFrame:
    return t.raw("orders").select("o_orderkey", I.clamped_probability(F.when(F.col("o_orderkey") % 4 > 0, (F.col("o_custkey") % 100) / 100)).alias("p"))


@query("SELECT n.indicator, n.period, n.value, CASE WHEN n.period[1:4] >= '2026' THEN 'projection' WHEN n.period[1:4] = '2025' THEN 'estimate' ELSE 'raw' END AS status FROM (SELECT indicator, CAST(CAST(period[1:4] AS INT) + 25 AS VARCHAR) AS period, value FROM measurements WHERE length(period) = 4 AND subject = 'NATION_1' UNION ALL SELECT indicator, period, value FROM measurements WHERE length(period) = 4 AND subject = 'NATION_2') n WHERE CAST(n.period AS INT) BETWEEN 1990 AND 2031 AND NOT EXISTS (SELECT 1 FROM measurements m WHERE m.indicator = n.indicator AND m.period = n.period)", "measurements")
def macro_insert(t: Tables) -> DataFrame:
    m = t.measurements()
    annual = m.filter("length(period) = 4").select("indicator", "subject", "period", "value")
    later = annual.filter("subject = 'NATION_1'").withColumn("period", (F.col("period").cast("int") + 25).cast("string"))
    new = later.unionByName(annual.filter("subject = 'NATION_2'")).drop("subject")
    return S.macro_rows(new, m).select("indicator", "period", "value", "status")


@query("SELECT artifact_id, source, row_number() OVER (PARTITION BY source ORDER BY artifact_id) AS place FROM artifacts WHERE status = 'pending' QUALIFY place <= 10", "artifacts")
def pending_scan(t: Tables) -> DataFrame:
    return top_k(t.artifacts().filter("status = 'pending'").select("artifact_id", "source"), ["source"], [F.asc("artifact_id")], 10, "place")


@query("SELECT n_nationkey AS route, last(event_type ORDER BY ts, event_id) AS status, max(ts) AS at_ FROM events JOIN nation ON n_nationkey = user_id % 25 GROUP BY 1")
def keyed_status_replace(t: Tables) -> DataFrame:
    e = t.raw("events").select(F.pmod("user_id", F.lit(25)).alias("route"), "ts", "event_id", "event_type")
    return e.groupBy("route").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("status"), F.max("ts").alias("at_"))


@query("SELECT c_custkey AS problem_id, o.o_orderkey AS forecast_id FROM customer LEFT JOIN (SELECT o_orderkey, TRY_CAST(regexp_extract('problem_id=' || o_custkey || ';x', 'problem_id=([0-9]+);', 1) AS BIGINT) AS p, o_orderdate FROM orders WHERE o_orderstatus <> 'F' QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1) o ON o.p = c_custkey")
def standing_forecast(t: Tables) -> DataFrame:
    conditions = F.concat(F.lit("problem_id="), F.col("o_custkey").cast("string"), F.lit(";x"))
    f = t.raw("orders").filter("o_orderstatus <> 'F'").select(F.regexp_extract(conditions, "problem_id=([0-9]+);", 1).try_cast("long").alias("problem_id"), F.col("o_orderkey").alias("forecast_id"), "o_orderdate")
    newest = top_k(f, ["problem_id"], [F.desc("o_orderdate"), F.desc("forecast_id")], 1).select("problem_id", "forecast_id")
    return t.raw("customer").select(F.col("c_custkey").alias("problem_id")).join(newest, "problem_id", "left")


@query()
def entity_merge(t: Tables) -> DataFrame:
    s = t.raw("supplier")
    existing = s.select(F.col("s_suppkey").alias("entity_id"), F.col("s_name").alias("entity_name"), F.array(F.concat(F.lit("sup "), F.col("s_suppkey").cast("string"))).alias("aliases"))
    new = s.select(F.concat(F.lit("SUP "), (F.col("s_suppkey") + 3).cast("string")).alias("name"), F.array(F.lit("extra")).alias("aliases"))
    return I.merge_entities(existing, new)


