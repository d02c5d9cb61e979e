"""Queries: linkers, gates over posts, intake rules, composites."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.functions import persian as P
from gleaner.functions import rules as R
from gleaner.operators import dossier as D
from gleaner.operators import linking as L
from gleaner.operators import posts as G
from gleaner.operators.common import top_k
from gleaner.plans.registry import query
from gleaner.plans.tables import ANGLES, SUBJECTS, Tables, _list, _pick

_EQ = ("question_evidence", "questions")


def _in(column: str, terms: list[str]) -> str:
    return "(" + " + ".join(f"CAST(contains({column}, '{t}') AS INT)" for t in terms) + ")"


def _times(column: str, terms: list[str]) -> str:
    return "(" + " + ".join(f"(length({column}) - length(replace({column}, '{t}', ''))) // {len(t)}" for t in terms) + ")"


_MD = f"""md AS (SELECT o_orderkey AS k, 'Iran ' || {_list(SUBJECTS)}[o_orderkey % 12 + 1] || repeat(' word', CAST(o_orderkey % 90 AS INT)) || repeat(' [finding:7]', CAST(o_orderkey % 7 AS INT)) || CASE WHEN o_orderkey % 3 = 0 THEN ' ```flowchart``` ' ELSE ' Evidence pending ' END
|| CASE WHEN o_orderkey % 5 > 0 THEN '## 🔍 What we don''t yet know What the evidence says How it could be addressed' ELSE ' resolved' END AS md, CASE WHEN o_orderkey % 2 = 0 THEN 'grounded' ELSE 'indicative' END AS confidence FROM orders)"""


def _markdown(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    n = lambda m: (k % m).cast("int")
    md = F.concat(
        F.lit("Iran "), _pick(SUBJECTS, k), F.repeat(F.lit(" word"), n(90)), F.repeat(F.lit(" [finding:7]"), n(7)), F.when(k % 3 == 0, " ```flowchart``` ").otherwise(" Evidence pending "),
        F.when(k % 5 > 0, "## 🔍 What we don't yet know What the evidence says How it could be addressed").otherwise(" resolved"),
    )
    return t.raw("orders").select(k.alias("k"), md.alias("md"), F.when(k % 2 == 0, "grounded").otherwise("indicative").alias("confidence"))


@query(
    "WITH " + _MD + r""", f AS (SELECT k, md, confidence, len(regexp_extract_all(md, '\[(measurement|finding):[0-9]+\]')) AS n, len(regexp_extract_all(md, '\S+')) AS w FROM md),
g AS (SELECT k, NOT (n = 0 AND NOT contains(md, 'Evidence pending')) AND NOT (confidence = 'indicative' AND regexp_matches(md, '(?i)\b(solved|resolved|will fix|guaranteed)\b')) AND contains(md, '## 🔍 What we don''t yet know') AS accuracy_ok,
round(least(0.4, 0.08 * n) + CASE confidence WHEN 'grounded' THEN 0.2 ELSE 0 END + CASE WHEN w BETWEEN 40 AND 600 THEN 0.1 ELSE 0 END + 0.1 + CASE WHEN contains(md, '```') THEN 0.1 ELSE 0 END + CASE WHEN contains(md, 'How it could be addressed') THEN 0.1 ELSE 0 END, 2) AS engagement FROM f)
SELECT k, CAST(engagement AS DOUBLE) AS engagement, accuracy_ok, CASE WHEN NOT accuracy_ok THEN 'HOLD' WHEN engagement >= 0.7 THEN 'PASS' ELSE 'REVISE' END AS decision FROM g"""
)
def post_gate(t: Tables) -> DataFrame:
    return _markdown(t).select("k", G.gate(F.col("md"), F.col("confidence")).alias("g")).select("k", "g.engagement", "g.accuracy_ok", "g.decision")


@query("SELECT p_partkey AS study_id, CASE WHEN p_retailprice * 100 > 150000 THEN 'over_cited' WHEN " + _in("lower(p_name || ' ' || p_type)", G.STUDY_TERMS) + " = 0 THEN 'off_domain' ELSE 'ok' END AS verdict FROM part")
def study_quarantine(t: Tables) -> DataFrame:
    return t.raw("part").select(F.col("p_partkey").alias("study_id"), G.study_audit(F.concat_ws(" ", "p_name", "p_type"), F.col("p_retailprice") * 100).alias("verdict"))


@query("SELECT problem_id, CASE WHEN problem_id % 5 = 0 THEN 'analysis' WHEN status <> 'candidate' THEN 'own_forecast' ELSE 'discard' END AS case_ FROM problems", "problems")
def case_resolver(t: Tables) -> DataFrame:
    return t.problems().select("problem_id", G.case(F.when(F.col("problem_id") % 5 == 0, 1).otherwise(0), F.col("topic").isNotNull(), F.col("status") != "candidate").alias("case_"))


_RECENT = "r AS (SELECT problem_id, string_agg(question_fa, ' ' ORDER BY question_id) AS recent FROM (SELECT * FROM questions QUALIFY row_number() OVER (PARTITION BY problem_id ORDER BY question_id DESC) <= 4) GROUP BY 1)"
_FREE = "[" + ", ".join(f"{_times('recent', G.HOOK_MARKS[h])} < 3" if h in G.HOOK_MARKS else "true" for h in G.HOOKS) + "]"


@query(f"+{_RECENT}, f AS (SELECT problem_id, {_FREE} AS free FROM r) SELECT problem_id, {_list(G.HOOKS)}[coalesce(list_filter(list_transform(range(6), lambda i: (problem_id + i) % 6), lambda k: free[k + 1])[1], problem_id % 6) + 1] AS hook FROM f", "questions")
def hook_rotation(t: Tables) -> DataFrame:
    last = top_k(t.questions(), ["problem_id"], [F.desc("question_id")], 4)
    recent = last.groupBy("problem_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("question_id", "question_fa"))), lambda x: x["question_fa"]), " ").alias("recent"))
    return recent.select("problem_id", G.hook(F.col("problem_id"), F.col("recent")).alias("hook"))


@query("SELECT question_id, " + _in("question_fa[1:260]", G.FRAMING_TELLS) + " AS framing, " + _in("question_fa", G.CAUSAL_STEPS) + " AS steps, " + _times("question_fa", G.PRESCRIPTIONS) + " AS prescriptions FROM questions", "questions")
def post_signals(t: Tables) -> DataFrame:
    q = F.col("question_fa")
    return t.questions().select("question_id", G.framing(q).alias("framing"), G.occurring(q, G.CAUSAL_STEPS).alias("steps"), G.occurrences(q, G.PRESCRIPTIONS).alias("prescriptions"))


@query("SELECT o_orderkey, array_to_string(list_sort(list_distinct(list_filter(list_transform(regexp_extract_all(strftime(o_orderdate, '%Y') || ' or ' || (1990 + o_orderkey % 20), '[0-9]{4}'), lambda x: CAST(x AS INT)), lambda y: y > 1998))), ',') AS years FROM orders")
def future_years(t: Tables) -> DataFrame:
    said = F.concat_ws(" or ", F.year("o_orderdate").cast("string"), (1990 + F.col("o_orderkey") % 20).cast("string"))
    return t.raw("orders").select("o_orderkey", F.array_join(F.transform(G.future_years(said, 1998), lambda x: x.cast("string")), ",").alias("years"))


@query("SELECT o_orderkey AS entry, o_custkey AS problem_id FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) <= 12")
def bounded_ledger(t: Tables) -> DataFrame:
    entries = t.raw("orders").select(F.col("o_orderkey").alias("entry"), F.col("o_custkey").alias("problem_id"), "o_orderdate")
    return G.bounded_ledger(entries, ["problem_id"], ["o_orderdate", "entry"]).select("entry", "problem_id")


@query("SELECT l_orderkey AS post, l_linenumber AS attempt, l_partkey % 5 AS fabrications, l_suppkey % 7 AS errors FROM lineitem WHERE l_returnflag <> 'R' QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY fabrications, errors, attempt) = 1")
def best_attempt(t: Tables) -> DataFrame:
    a = t.raw("lineitem").select(F.col("l_orderkey").alias("post"), F.col("l_linenumber").alias("attempt"), (F.col("l_partkey") % 5).alias("fabrications"), (F.col("l_suppkey") % 7).alias("errors"), (F.col("l_returnflag") != "R").alias("passed"))
    return G.best_attempts(a, "post", "attempt")


@query(
    "WITH c AS (SELECT user_id AS route, ts, event_type IN ('purchase', 'view') AS ok FROM events), l AS (SELECT route, max(ts) AS last_ok FROM c WHERE ok GROUP BY 1), f AS (SELECT c.route, count(*) AS fails, max(ts) AS last_fail FROM c LEFT JOIN l ON l.route = c.route WHERE NOT ok AND (last_ok IS NULL OR ts > last_ok) GROUP BY 1) SELECT r.route, coalesce(fails, 0) AS fails, CASE WHEN fails >= 2 THEN last_fail + to_seconds(CAST(least(1800 * pow(2, least(fails - 2, 20)), 43200) AS INT)) END AS disabled_until FROM (SELECT DISTINCT route FROM c) r LEFT JOIN f ON f.route = r.route"
)
def route_quarantine(t: Tables) -> DataFrame:
    calls = t.raw("events").select(F.col("user_id").alias("route"), "ts", F.col("event_type").isin("purchase", "view").alias("ok"))
    return G.route_state(calls, "route", "ts", "ok")


@query("SELECT p.problem_id, CASE WHEN count(e.evidence_id) FILTER (evidence_type = 'measurement') > 0 AND count(e.evidence_id) FILTER (evidence_type = 'finding') > 0 THEN 'ready' WHEN count(e.evidence_id) > 0 THEN 'thin' ELSE 'candidate' END AS readiness FROM problems p LEFT JOIN questions q ON q.problem_id = p.problem_id LEFT JOIN question_evidence e ON e.question_id = q.question_id GROUP BY 1", "problems", *_EQ)
def readiness(t: Tables) -> DataFrame:
    c = t.question_evidence().join(t.questions().select("question_id", "problem_id"), "question_id").groupBy("problem_id").agg(F.count_if(F.col("evidence_type") == "measurement").alias("m"), F.count_if(F.col("evidence_type") == "finding").alias("f"))
    p = t.problems().select("problem_id").join(c, "problem_id", "left").na.fill(0)
    return p.select("problem_id", F.when((F.col("m") > 0) & (F.col("f") > 0), "ready").when(F.col("m") + F.col("f") > 0, "thin").otherwise("candidate").alias("readiness"))


@query("SELECT p.problem_id, unnest(CASE WHEN c.n IS NOT NULL THEN ['claims', 'macro'] ELSE ['macro'] END) AS question FROM problems p LEFT JOIN (SELECT problem_id, count(*) AS k FROM questions GROUP BY 1) q USING (problem_id) LEFT JOIN (SELECT artifact_id AS problem_id, count(*) AS n FROM claims GROUP BY 1) c USING (problem_id) WHERE coalesce(q.k, 0) < 2", "problems", "questions", "claims")
def question_scaffold(t: Tables) -> DataFrame:
    have = t.questions().groupBy("problem_id").agg(F.count("*").alias("k"))
    claims = t.claims().select(F.col("artifact_id").alias("problem_id"), F.lit(True).alias("has")).distinct()
    p = t.problems().select("problem_id").join(have, "problem_id", "left").join(claims, "problem_id", "left").filter(F.coalesce("k", F.lit(0)) < 2)
    return p.select("problem_id", F.explode(F.when(F.col("has"), F.array(F.lit("claims"), F.lit("macro"))).otherwise(F.array(F.lit("macro")))).alias("question"))


@query("SELECT problem_id, domain FROM (SELECT problem_id, CASE " + " ".join(f"WHEN regexp_matches(lower(statement), '{p}') THEN '{n}'" for n, p in R.DOMAIN_PATTERNS) + " ELSE 'society' END AS domain FROM problems WHERE status = 'ready') QUALIFY row_number() OVER (PARTITION BY domain ORDER BY problem_id) = 1", "problems")
def domain_spread(t: Tables) -> DataFrame:
    d = t.problems().filter("status = 'ready'").select("problem_id", R.domain(F.col("statement")).alias("domain"))
    return d.groupBy("domain").agg(F.min("problem_id").alias("problem_id"))


@query("SELECT measurement_id, value FROM measurements WHERE NOT (indicator = 'AF' AND source = 'src0') UNION ALL SELECT measurement_id || '|fresh', value * 2 FROM measurements WHERE indicator = 'AF' AND source = 'src0'", "measurements")
def series_repair(t: Tables) -> DataFrame:
    m = t.measurements()
    bad = m.select("indicator", "source").distinct().filter("indicator = 'AF' AND source = 'src0'")
    kept = m.join(bad, ["indicator", "source"], "left_anti").select("measurement_id", "value")
    fresh = m.join(bad, ["indicator", "source"], "left_semi").select(F.concat("measurement_id", F.lit("|fresh")).alias("measurement_id"), (F.col("value") * 2).alias("value"))
    return kept.unionByName(fresh)


_F = f"f AS (SELECT DISTINCT {_list(SUBJECTS)}[p_partkey % 12 + 1] AS title, 'Iran ' || {_list(ANGLES)}[p_partkey % 7 + 1] AS finding FROM part)"


def _domain_list(column: str) -> str:
    from gleaner.plans.texts import _link_hit

    return "list_filter([" + ", ".join(f"CASE WHEN {_link_hit(v)} THEN '{k}' END" for k, v in R.LINK_DOMAINS.items()) + "], lambda x: x IS NOT NULL)"


_PRIMARY = "list_max(list_filter([" + ", ".join(
    "{'n': " + " + ".join(f"(length(lower(title)) - length(replace(lower(title), '{x}', ''))) // {len(x)}" for x in v) + f", 'k': {-i}, 'name': '{k}'" + "}" for i, (k, v) in enumerate(R.LINK_DOMAINS.items())
) + "], lambda x: x.n > 0)).name"


@query(
    f"+{_F}, fp AS (SELECT *, {_PRIMARY} AS pd, list_distinct(regexp_extract_all(lower(finding || ' ' || title), '[a-z]{{4,}}')) AS fw FROM f), st AS (SELECT DISTINCT statement, replace(replace(replace(lower(statement), 'purchasing power', ' '), 'households', ' '), 'household', ' ') AS s FROM problems), sd AS (SELECT statement, {_domain_list('s')} AS doms, list_distinct(regexp_extract_all(lower(statement), '[a-z]{{4,}}')) AS sw FROM st) SELECT statement, finding, title, len(list_intersect(fw, sw)) AS shared FROM sd JOIN fp ON list_contains(doms, pd) WHERE len(list_intersect(fw, sw)) >= 2",
    "problems",
)
def finding_linker(t: Tables) -> DataFrame:
    k = F.col("p_partkey")
    findings = t.raw("part").select(_pick(SUBJECTS, k).alias("title"), F.concat(F.lit("Iran "), _pick(ANGLES, k)).alias("finding"))
    return L.findings_to_statements(t.problems(), findings)


@query()
def series_linker(t: Tables) -> DataFrame:
    return L.series_to_statements(t.problems(), t.registry(), t.measurements())


_STOPS = ", ".join(f"'{w}'" for w in L.NEWS_STOP)
_NEWS = f"list_filter(list_distinct(regexp_extract_all(lower({{}}), '[a-z]{{{{3,}}}}')), lambda w: w NOT IN ({_STOPS}))"


@query(
    "+s AS (SELECT DISTINCT statement FROM problems), n AS (SELECT question AS title, min(asked) AS dt FROM questions GROUP BY 1), j AS (SELECT statement, title, dt, len(list_intersect(" + _NEWS.format("statement") + ", " + _NEWS.format("title") + ")) + CASE WHEN contains(lower(title), 'iran') THEN 2 ELSE 0 END AS score FROM s CROSS JOIN n) SELECT statement, title, score, row_number() OVER (PARTITION BY statement ORDER BY score DESC, dt, title) AS place FROM j WHERE score >= 2 QUALIFY place <= 6",
    "problems", "questions",
)
def news_context_scores(t: Tables) -> DataFrame:
    return L.news_scores(t.problems(), t.questions().select(F.col("question").alias("title"), F.col("asked").alias("dt")))


@query(
    "WITH g AS (SELECT doc_id, source, regexp_extract_all(lower(text), '[a-z]+')[1:12] AS w FROM documents), t AS (SELECT doc_id, source, list_distinct(list_transform(range(greatest(len(w) - 2, 0)), lambda i: array_to_string(w[i + 1:i + 3], ' '))) AS a FROM g), l AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id DESC) <= 20) SELECT t.doc_id, round(coalesce(max(CASE WHEN len(t.a) > 0 AND len(l.a) > 0 THEN len(list_intersect(t.a, l.a)) / len(list_distinct(t.a || l.a)) ELSE 0 END), 0), 6) AS similarity FROM t LEFT JOIN l ON l.source = t.source AND l.doc_id <> t.doc_id GROUP BY 1"
)
def opening_trigram_similarity(t: Tables) -> DataFrame:
    d = t.raw("documents").select("doc_id", "source", "text")
    ledger = top_k(d, ["source"], [F.desc("doc_id")], 20)
    return L.opening_similarity(d, ledger, "source", "doc_id", "text", "[a-z]+").withColumn("similarity", F.round("similarity", 6))


@query(
    "+c AS (SELECT DISTINCT q.problem_id, f.finding_id, concat_ws(' | ', title, outcome, intervention) AS said FROM question_evidence e JOIN questions q USING (question_id) JOIN findings f ON f.finding_id = e.evidence_id JOIN studies s ON s.study_id = f.study_id WHERE evidence_type = 'finding' AND quality IS DISTINCT FROM 'rejected') SELECT problem_id, 'statement' AS section, 1 AS n, statement AS body FROM problems UNION ALL SELECT problem_id, 'questions', count(*), string_agg(question, chr(10) ORDER BY asked, question_id) FROM questions GROUP BY 1 UNION ALL SELECT problem_id, 'findings', count(*), string_agg(said, chr(10) ORDER BY finding_id) FROM c GROUP BY 1 UNION ALL SELECT problem_id, 'gaps', count(*), string_agg(question_id::VARCHAR, ',' ORDER BY question_id) FROM questions q WHERE NOT EXISTS (SELECT 1 FROM question_evidence e WHERE e.question_id = q.question_id) GROUP BY 1",
    "problems", *_EQ, "findings", "studies",
)
def dossier_sections(t: Tables) -> DataFrame:
    return D.sections(t.problems(), t.questions(), t.question_evidence(), t.findings(), t.studies())


@query(
    "+c AS (SELECT q.problem_id, e.question_id, f.* FROM question_evidence e JOIN questions q USING (question_id) JOIN findings f ON f.finding_id = e.evidence_id WHERE evidence_type = 'finding'), d AS (SELECT problem_id, count(DISTINCT finding_id) AS direct_evidence, count(DISTINCT study_id) AS supporting_studies FROM c GROUP BY 1), k AS (SELECT problem_id, question_id, intervention, count(DISTINCT outcome) AS k FROM c WHERE intervention IS NOT NULL GROUP BY ALL), x AS (SELECT problem_id, count(*) FILTER (k > 1) AS conflicts FROM k GROUP BY 1), u AS (SELECT problem_id, count(*) AS unresolved FROM questions q WHERE NOT EXISTS (SELECT 1 FROM question_evidence e WHERE e.question_id = q.question_id) GROUP BY 1) SELECT p.problem_id, coalesce(direct_evidence, 0) AS direct_evidence, coalesce(supporting_studies, 0) AS supporting_studies, coalesce(conflicts, 0) AS conflicts, coalesce(unresolved, 0) AS unresolved FROM (SELECT DISTINCT problem_id FROM questions) p LEFT JOIN d USING (problem_id) LEFT JOIN x USING (problem_id) LEFT JOIN u USING (problem_id)",
    *_EQ, "findings",
)
def reasoning_state(t: Tables) -> DataFrame:
    return D.reasoning(t.questions(), t.question_evidence(), t.findings())


@query()
def persian_normalise(t: Tables) -> DataFrame:
    q = F.concat_ws(" ", "question_fa", F.col("asked").cast("string"), F.lit("می شود  ،،"))
    return t.questions().select("question_id", P.normalised(q).alias("normalised"), P.issues(q).alias("issues"))


@query()
def persian_repairs(t: Tables) -> DataFrame:
    said = F.concat_ws(" ", "question_fa", (F.col("question_id") * 7919 + 1_000_000).cast("string"), F.lit("(منبع: بانک) و (منبع: بانک)"))
    out = t.questions().select("question_id", P.round_big_numbers(P.persian_digits(said)).alias("x"))
    return out.select("question_id", P.split_runons(P.dedupe_provider_parens(F.col("x"))).alias("repaired"))
