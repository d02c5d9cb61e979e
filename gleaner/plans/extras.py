"""Queries: orders, selections, summaries and text splits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.functions import persian as P
from gleaner.functions import rules as R
from gleaner.functions import text as T
from gleaner.operators import posts as G
from gleaner.operators import series
from gleaner.operators.common import top_k
from gleaner.plans.gates import _in
from gleaner.plans.registry import query
from gleaner.plans.tables import Tables, _list

#: Word stems of war and pressure that put a draft behind others.
_WAR = ["war", "missile", "strike", "military", "retaliat", "escalat", "attack", "sanction", "base", "troops", "defense", "defence", "weapon", "army"]
_DOMAIN = "CASE " + " ".join(f"WHEN regexp_matches(lower({{t}}), '{p}') THEN '{n}'" for n, p in R.DOMAIN_PATTERNS) + " ELSE 'society' END"


@query("+s AS (SELECT " + _DOMAIN.format(t="statement") + " AS domain, count(*) AS n FROM problems WHERE status = 'published' GROUP BY 1), c AS (SELECT problem_id, statement, " + _DOMAIN.format(t="statement") + " AS domain, len(regexp_extract_all(lower(statement), '" + "|".join(_WAR) + "')) AS war FROM problems WHERE status = 'candidate') SELECT problem_id, coalesce(n, 0) AS scarcity, war, row_number() OVER (ORDER BY coalesce(n, 0), war, problem_id) AS place FROM c LEFT JOIN s USING (domain) QUALIFY place <= 50", "problems")
def fresh_order(t: Tables) -> DataFrame:
    """The fifty candidates to draft first: of the domains least published, then with the fewest words of war."""
    from pyspark.sql import Window

    p = t.problems().withColumn("domain", R.domain(F.col("statement")))
    published = p.filter("status = 'published'").groupBy("domain").agg(F.count("*").alias("n"))
    war = F.regexp_count(F.lower("statement"), F.lit("|".join(_WAR)))
    c = p.filter("status = 'candidate'").join(published, "domain", "left").select("problem_id", F.coalesce("n", F.lit(0)).alias("scarcity"), war.alias("war"))
    return c.orderBy("scarcity", "war", "problem_id").limit(50).withColumn("place", F.row_number().over(Window.orderBy("scarcity", "war", "problem_id")))


@query("SELECT measurement_id, indicator, row_number() OVER (PARTITION BY indicator, subject, source ORDER BY TRY_CAST(period[1:4] AS INT) DESC, period, measurement_id) AS place FROM measurements QUALIFY place <= 6", "measurements")
def newest_by_year(t: Tables) -> DataFrame:
    """The six newest readings of a series by year as a number, those of one year in order of the period."""
    year = F.substring("period", 1, 4).try_cast("int")
    return top_k(t.measurements(), ["indicator", "subject", "source"], [F.desc(year), F.asc("period"), F.asc("measurement_id")], 6, "place").select("measurement_id", "indicator", "place")


@query("+c AS (SELECT question_id, count(*) FILTER (evidence_type = 'finding') AS findings, count(*) FILTER (line = 2) AS deferred, bool_or(evidence_id % 40 = 0) AS failed FROM question_evidence GROUP BY 1) SELECT question_id, CASE WHEN failed OR (deferred > 0 AND findings = 0) THEN 'operational' WHEN findings > 0 THEN 'evidence' ELSE 'empty' END AS outcome FROM c", "question_evidence")
def scholarly_outcomes(t: Tables) -> DataFrame:
    kind = F.col("evidence_type")
    c = t.question_evidence().groupBy("question_id").agg(F.count_if(kind == "finding").alias("findings"), F.count_if(F.col("line") == 2).alias("deferred"), F.bool_or(F.col("evidence_id") % 40 == 0).alias("failed"))
    return c.select("question_id", R.scholarly_outcome(F.col("failed"), F.col("deferred"), F.col("findings")).alias("outcome"))


_CODES = "CASE {} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in R.COUNTRY_CODES.items()) + " END"
_WITHIN = "CASE " + " ".join(f"WHEN contains(lower({{}}), '{k}') THEN '{v}'" for k, v in R.COUNTRY_CODES.items()) + " END"


@query("WITH n AS (SELECT c_custkey AS problem_id, [c_mktsegment, CASE WHEN c_custkey % 2 = 0 THEN 'Republic of ' || n_name ELSE ' ' || n_name END, 'Iran'] AS names FROM customer JOIN nation ON n_nationkey = c_nationkey), x AS (SELECT problem_id, list_filter(list_transform(names, lambda m: coalesce(" + _CODES.format("lower(trim(m))") + ", " + _WITHIN.replace("{}", "m") + ")), lambda c: c IS NOT NULL) AS codes FROM n) SELECT problem_id, codes[1] AS country FROM x")
def country_select(t: Tables) -> DataFrame:
    c = t.raw("customer").join(F.broadcast(t.raw("nation")), F.col("n_nationkey") == F.col("c_nationkey"))
    second = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("Republic of "), "n_name")).otherwise(F.concat(F.lit(" "), "n_name"))
    return c.select(F.col("c_custkey").alias("problem_id"), R.country_code(F.array(F.col("c_mktsegment"), second, F.lit("Iran"))).alias("country"))


_YEAR = "TRY_CAST(period[1:4] AS INT)"
_PROJECTED = f"coalesce({_YEAR} > 2000 OR ({_YEAR} = 2000 AND length(period) = 4), false)"


@query(
    f"+g AS (SELECT indicator, subject, source, min(period) AS p0, first(value ORDER BY period) AS a, max(period) AS p1, last(value ORDER BY period) AS b, count(*) FILTER ({_PROJECTED}) AS n, max({_YEAR}) FILTER (NOT {_PROJECTED}) AS actual FROM measurements GROUP BY 1, 2, 3),"
    " r AS (SELECT g.*, lower(concat_ws(' ', coalesce(label, indicator), unit)) AS name, CASE WHEN a <> 0 THEN round((b - a) / abs(a) * 100, 1) END AS pct FROM g LEFT JOIN registry USING (indicator))"
    " SELECT indicator, subject, source, concat_ws('; ', 'window ' || p0 || '-' || p1, CASE WHEN b > a THEN 'increasing' WHEN b < a THEN 'decreasing' ELSE 'flat' END || ' overall', CASE WHEN " + " OR ".join(f"contains(name, '{w}')" for w in series.RATE_WORDS) + " THEN 'moved from ' || format('{:,.1f}', a) || ' (' || p0 || ') to ' || format('{:,.1f}', b) || ' (' || p1 || ')'"
    " ELSE 'net change ' || CASE WHEN pct >= 0 THEN '+' ELSE '-' END || CAST(CAST(abs(pct) AS DECIMAL(30,1)) AS VARCHAR) || '%' END, 'latest value ' || format('{:,.1f}', b) || ' (' || p1 || ')', coalesce('latest observed year: ' || actual, 'no observed data'), CASE WHEN n > 0 THEN 'WARNING: ' || n || ' point(s) from 2000 on are projections' END,"
    " CASE WHEN 2000 - actual >= 2 THEN 'STALENESS: newest observation is ' || (2000 - actual) || ' years old' WHEN 2000 - actual <= 1 THEN 'NOTE: the newest values are often preliminary' END) AS summary FROM r",
    "measurements", "registry",
)
def temporal_summaries(t: Tables) -> DataFrame:
    return series.temporal_summary(t.measurements(), t.registry(), 2000)


@query("SELECT o_orderkey AS forecast_id, CASE o_orderpriority[1] WHEN '1' THEN 'hit' WHEN '2' THEN 'partial' ELSE 'miss' END AS outcome, CASE o_orderpriority[1] WHEN '1' THEN 1.0 WHEN '2' THEN 0.5 ELSE 0.0 END AS score FROM orders WHERE o_orderstatus = 'F'")
def forecast_scores(t: Tables) -> DataFrame:
    first = F.substring("o_orderpriority", 1, 1)
    outcome = F.when(first == "1", "hit").when(first == "2", "partial").otherwise("miss")
    f = t.raw("orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("forecast_id"), outcome.alias("outcome"))
    return f.withColumn("score", R.forecast_score(F.col("outcome")))


#: Topics of a registry and the words by which a text is told to be about them.
TOPIC_WORDS = {"price": ["قیمت", "نان", "نرخ"], "budget": ["بودجه", "یارانه", "بانک"], "place": ["استان", "روستا"]}


@query("SELECT question_id, array_to_string(list_sort(list_filter(list_distinct(regexp_extract_all(question_fa, '[؀-ۿ]{3,}')), lambda w: NOT list_contains(" + _list(P.STOP_WORDS) + ", w))), ' ') AS words, concat_ws(',', " + ", ".join(f"CASE WHEN {_in('question_fa', words)} > 0 THEN '{k}' END" for k, words in sorted(TOPIC_WORDS.items())) + ") AS topics FROM questions", "questions")
def persian_topics(t: Tables) -> DataFrame:
    q = F.col("question_fa")
    return t.questions().select("question_id", F.array_join(F.array_sort(P.content_words(q)), " ").alias("words"), F.array_join(P.topic_keys(q, TOPIC_WORDS), ",").alias("topics"))


@query("WITH a AS (SELECT s_suppkey AS entity_id, ['  Sup  ' || s_suppkey, 'Sup ' || s_suppkey, ' ', s_name, NULL, s_name || chr(9)] AS x FROM supplier) SELECT entity_id, concat_ws('|', 'Sup ' || entity_id, trim(x[4])) AS aliases FROM a")
def aliases_cleaned(t: Tables) -> DataFrame:
    k = F.col("s_suppkey").cast("string")
    x = F.array(F.concat(F.lit("  Sup  "), k), F.concat(F.lit("Sup "), k), F.lit(" "), F.col("s_name"), F.lit(None).cast("string"), F.concat("s_name", F.lit("\t")))
    return t.raw("supplier").select(F.col("s_suppkey").alias("entity_id"), F.array_join(T.clean_aliases(x), "|").alias("aliases"))


_MARKED = r"regexp_replace(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), '\n+', chr(1), 'g')"


@query(
    "WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), s AS (SELECT doc_id, len(list_filter(string_split(" + _MARKED + r", chr(1)), lambda x: x <> '')) AS after_marks, len(list_filter(string_split_regex(regexp_replace(regexp_replace(text, '([0-9])\.([0-9])', '\1' || chr(2) || '\2', 'g'), '([0-9])\.([0-9])', '\1' || chr(2) || '\2', 'g'), '[.!?\n]+'), lambda x: length(trim(x, ' ')) >= 25)) AS long_ones, len(list_filter(regexp_extract_all(text, '[^.!?\n]*[.!?\n]*'), lambda x: x <> '')) AS spans, len(list_filter(string_split_regex(text, '[.!?;:]+'), lambda x: trim(x, ' ') <> '')) AS by_marks FROM d) SELECT * FROM s"
)
def sentence_splits(t: Tables) -> DataFrame:
    """How many sentences each of the four ways of splitting finds: behind marks, long ones with decimals kept whole, spans, by any mark."""
    x = F.col("text")
    n = lambda c: F.size(c)
    return t.raw("documents").select("doc_id", n(T.sentences_after_marks(x)).alias("after_marks"), n(T.long_sentences(x)).alias("long_ones"), n(T.sentence_spans(x)).alias("spans"), n(T.by_marks(x)).alias("by_marks"))


_SCORES = "SELECT problem_id, rounds, last_score FROM (SELECT o_custkey AS problem_id, count(*) AS rounds, last(o_totalprice ORDER BY o_orderdate, o_orderkey) AS last_score FROM orders GROUP BY 1)"


@query("+q AS (SELECT problem_id, count(*) AS questions FROM questions GROUP BY 1), s AS (" + _SCORES + ") SELECT p.problem_id, p.status, coalesce(p.topic, '?') AS topic, coalesce(questions, 0) AS questions, coalesce(rounds, 0) AS rounds, last_score FROM problems p LEFT JOIN q USING (problem_id) LEFT JOIN s USING (problem_id)", "problems", "questions")
def panel_problems(t: Tables) -> DataFrame:
    q = t.questions().groupBy("problem_id").agg(F.count("*").alias("questions"))
    s = t.raw("orders").groupBy(F.col("o_custkey").alias("problem_id")).agg(F.count("*").alias("rounds"), F.max_by("o_totalprice", F.struct("o_orderdate", "o_orderkey")).alias("last_score"))
    p = t.problems().join(q, "problem_id", "left").join(s, "problem_id", "left")
    return p.select("problem_id", "status", F.coalesce("topic", F.lit("?")).alias("topic"), F.coalesce("questions", F.lit(0)).alias("questions"), F.coalesce("rounds", F.lit(0)).alias("rounds"), "last_score")


@query("SELECT role AS channel, count(*) AS turns, count(DISTINCT conv_id) AS conversations, max(turn) AS longest, round(avg(length(text)), 4) AS mean_chars FROM conversations GROUP BY 1")
def panel_channels(t: Tables) -> DataFrame:
    c = t.raw("conversations")
    return c.groupBy(F.col("role").alias("channel")).agg(F.count("*").alias("turns"), F.countDistinct("conv_id").alias("conversations"), F.max("turn").alias("longest"), F.round(F.avg(F.length("text")), 4).alias("mean_chars"))


@query("+l AS (SELECT source, quality FROM labels JOIN documents USING (doc_id)) SELECT source, count(*) AS labelled, count(*) FILTER (quality = 1) AS good, round(count(*) FILTER (quality = 1) / count(*), 4) AS share FROM l GROUP BY 1", "artifacts")
def panel_quality(t: Tables) -> DataFrame:
    j = t.raw("labels").join(t.raw("documents").select("doc_id", "source"), "doc_id")
    g = j.groupBy("source").agg(F.count("*").alias("labelled"), F.count_if(F.col("quality") == 1).alias("good"))
    return g.withColumn("share", F.round(F.col("good") / F.col("labelled"), 4))


@query("+f AS (SELECT study_id, count(*) AS findings, count(*) FILTER (effect_size IS NOT NULL) AS grounded, string_agg(DISTINCT intervention, ', ' ORDER BY intervention) AS levers FROM findings WHERE study_id IS NOT NULL GROUP BY 1) SELECT study_id, findings, grounded, coalesce(levers, '') AS levers, CASE WHEN grounded = 0 THEN 'indicative' WHEN grounded * 2 >= findings THEN 'grounded' ELSE 'mixed' END AS confidence FROM f", "findings")
def solution_analysis(t: Tables) -> DataFrame:
    """Per study its levers, and how well they are grounded."""
    return G.solution_analysis(t.findings().filter("study_id IS NOT NULL"), "study_id")
