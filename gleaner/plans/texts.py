"""Queries: classification, similarity, numbers and text functions."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.functions import numeric as N
from gleaner.functions import rules as R
from gleaner.functions import text as T
from gleaner.operators import matching as M
from gleaner.operators import picking as P
from gleaner.operators import verify as V
from gleaner.operators.common import top_k
from gleaner.plans.registry import query
from gleaner.plans.tables import Tables


def _written_out(m: re.Match) -> str:
    return rf"(^|[^\pL\pN_]){m[1]}([^\pL\pN_]|$)"


def _any(column: str, terms: list[str]) -> str:
    return "(" + " OR ".join(f"contains({column}, '{t}')" for t in terms) + ")"


def _count(column: str, terms: list[str]) -> str:
    return "(" + " + ".join(f"CAST(contains({column}, '{t}') AS INT)" for t in terms) + ")"


#: The oracle's engine takes letters beyond ASCII for gaps between words, so its word bounds are written out.
_BOUND = re.compile(r"\\b(\w+)\\b")
_DOMAIN = "CASE " + " ".join(f"WHEN regexp_matches({{t}}, '{_BOUND.sub(_written_out, p)}') THEN '{n}'" for n, p in R.DOMAIN_PATTERNS) + " ELSE 'society' END"


@query("SELECT problem_id, " + _DOMAIN.format(t="lower(statement)") + " AS domain FROM problems", "problems")
def domain_classify(t: Tables) -> DataFrame:
    return t.problems().select("problem_id", R.domain(F.col("statement")).alias("domain"))


@query("SELECT " + _DOMAIN.format(t="lower(statement)") + " AS domain, count(*) AS n FROM problems GROUP BY 1", "problems")
def scarcity_order(t: Tables) -> DataFrame:
    return t.problems().groupBy(R.domain(F.col("statement")).alias("domain")).agg(F.count("*").alias("n"))


@query("SELECT artifact_id, " + _DOMAIN.format(t="lower(content)") + " AS domain FROM artifacts", "artifacts")
def domain_classify_documents(t: Tables) -> DataFrame:
    return t.artifacts().select("artifact_id", R.domain(F.col("content")).alias("domain"))


def _link_hit(terms: list[str]) -> str:
    short, long = [x for x in terms if len(x) < 6], [x for x in terms if len(x) >= 6]
    parts = ([r"regexp_matches(s, '\b(" + "|".join(short) + r")\b')"] if short else []) + [f"contains(s, '{x}')" for x in long]
    return "(" + " OR ".join(parts) + ")"


_CLEAN = "p AS (SELECT problem_id, replace(replace(replace(lower(statement), 'purchasing power', ' '), 'households', ' '), 'household', ' ') AS s FROM problems)"


@query("+" + _CLEAN + " SELECT problem_id, array_to_string(list_filter([" + ", ".join(f"CASE WHEN {_link_hit(v)} THEN '{k}' END" for k, v in R.LINK_DOMAINS.items()) + "], lambda x: x IS NOT NULL), ',') AS domains FROM p", "problems")
def domain_multilabel(t: Tables) -> DataFrame:
    return t.problems().select("problem_id", F.array_join(R.link_domains(F.col("statement")), ",").alias("domains"))


_PRIMARY = "greatest(" + ", ".join("k%d" % i for i in range(len(R.LINK_DOMAINS))) + ")"


@query(
    "+c AS (SELECT problem_id, "
    + ", ".join("(" + " + ".join(f"CAST((length(lower(statement)) - length(replace(lower(statement), '{x}', ''))) / {len(x)} AS INT)" for x in v) + f") AS k{i}" for i, v in enumerate(R.LINK_DOMAINS.values()))
    + f" FROM problems) SELECT problem_id, CASE WHEN {_PRIMARY} = 0 THEN NULL "
    + " ".join(f"WHEN k{i} = {_PRIMARY} THEN '{k}'" for i, k in enumerate(R.LINK_DOMAINS))
    + " END AS domain FROM c",
    "problems",
)
def primary_domain(t: Tables) -> DataFrame:
    return t.problems().select("problem_id", R.primary_domain(F.col("statement")).alias("domain"))


@query("SELECT problem_id, coalesce(nullif(array_to_string(list_filter([" + ", ".join(f"CASE WHEN {_any('lower(statement)', v)} THEN '{k}' END" for k, v in R.NEWS_DOMAINS.items()) + "], lambda x: x IS NOT NULL), ','), ''), 'conflict') AS domains FROM problems", "problems")
def news_domains(t: Tables) -> DataFrame:
    return t.problems().select("problem_id", F.array_join(R.news_domains(F.col("statement")), ",").alias("domains"))


_STRATEGY = f"+h AS (SELECT question_id, {_count('lower(question)', R.QUANT_STRONG)} AS qs, {_count('lower(question)', R.QUANT_WEAK)} AS qw, {_count('lower(question)', R.CURRENT)} AS c, {_count('lower(question)', R.SCHOLARLY)} AS s FROM questions), st AS (SELECT *, CASE WHEN qs >= 1 AND (c >= 1 OR s >= 1) THEN 'mixed' WHEN qs >= 1 THEN 'quantitative_official' WHEN qw >= 1 THEN 'mixed' WHEN c >= 1 AND s <= c + 1 THEN 'current_event' ELSE 'scholarly_study' END AS strategy FROM h) "


@query(_STRATEGY + "SELECT question_id, strategy FROM st", "questions")
def evidence_strategy(t: Tables) -> DataFrame:
    return t.questions().select("question_id", R.evidence_strategy(F.col("question")).alias("strategy"))


@query(_STRATEGY + "SELECT unnest(CASE strategy WHEN 'mixed' THEN ['scholarly', 'quantitative'] WHEN 'quantitative_official' THEN ['quantitative'] WHEN 'current_event' THEN ['current'] ELSE ['scholarly'] END) AS substrate, count(*) AS n FROM st GROUP BY 1", "questions")
def substrate_counts(t: Tables) -> DataFrame:
    s = t.questions().select(F.explode(R.substrates(R.evidence_strategy(F.col("question")))).alias("substrate"))
    return s.groupBy("substrate").agg(F.count("*").alias("n"))


@query("SELECT question_id, CASE " + " ".join(f"WHEN contains(lower(question), '{k}') THEN '{v}'" for k, v in R.INDICATOR_KEYWORDS) + " END AS code FROM questions", "questions")
def indicator_select(t: Tables) -> DataFrame:
    return t.questions().select("question_id", R.indicator_code(F.col("question")).alias("code"))


_GATE = (
    "+f AS (SELECT problem_id, count(*) AS n, bool_or(" + " OR ".join(f"regexp_matches(question_fa, '{p}')" for p in R.BANNED_QUESTIONS) + ") AS banned, count(*) FILTER (" + _any("question_fa", R.SPECIFIC_MARKERS) + ") AS specific, bool_or(" + _any("question_fa", R.NONMACRO_MARKERS) + ") AS nonmacro FROM questions GROUP BY 1) "
    "SELECT problem_id, CASE WHEN n < 3 THEN 'too few questions' WHEN banned THEN 'generic template' WHEN specific < 2 THEN 'fewer than 2 specific questions' WHEN NOT nonmacro THEN 'no non-macro question' ELSE 'ok' END AS reason FROM f"
)


@query(_GATE, "questions")
def question_gate(t: Tables) -> DataFrame:
    q = F.col("question_fa")
    held = lambda terms: T.containing(q, terms) > 0
    banned = q.rlike("|".join(f"(?:{p})" for p in R.BANNED_QUESTIONS))
    g = t.questions().groupBy("problem_id").agg(F.count("*").alias("n"), F.bool_or(banned).alias("banned"), F.count_if(held(R.SPECIFIC_MARKERS)).alias("specific"), F.bool_or(held(R.NONMACRO_MARKERS)).alias("nonmacro"))
    reason = F.when(F.col("n") < 3, "too few questions").when(F.col("banned"), "generic template").when(F.col("specific") < 2, "fewer than 2 specific questions").when(~F.col("nonmacro"), "no non-macro question").otherwise("ok")
    return g.select("problem_id", reason.alias("reason"))


@query("SELECT conv_id, turn, CASE WHEN lower(trim(role)) = 'measurement' THEN 'observation' WHEN lower(trim(role)) IN ('fact', 'statement', 'prediction', 'observation', 'causal', 'relationship') THEN lower(trim(role)) ELSE 'statement' END AS claim_type, CASE WHEN role = 'user' THEN 'person' ELSE 'organization' END AS entity_type, NULL::VARCHAR AS scope FROM conversations")
def claim_normalize(t: Tables) -> DataFrame:
    c = t.raw("conversations")
    kind = F.when(F.col("role") == "user", "personnel").otherwise(F.col("role"))
    return c.select("conv_id", "turn", R.claim_type(F.col("role")).alias("claim_type"), R.entity_type(kind).alias("entity_type"), R.temporal_scope(F.col("role")).alias("scope"))


@query("SELECT problem_id, topic, " + "CASE topic " + " ".join(f"WHEN '{k}' THEN {_any('lower(statement)', v)}" for k, v in R.TOPIC_EVIDENCE.items()) + " ELSE true END AS supported FROM (SELECT problem_id, statement, unnest(['energy', 'trade', 'water', 'labour', 'inflation', 'other']) AS topic FROM problems)", "problems")
def topic_corroboration(t: Tables) -> DataFrame:
    topics = F.explode(F.array(*[F.lit(x) for x in ("energy", "trade", "water", "labour", "inflation", "other")]))
    p = t.problems().select("problem_id", "statement", topics.alias("topic"))
    return p.select("problem_id", "topic", R.topic_supported(F.col("topic"), F.col("statement")).alias("supported"))


_WORDS = "list_distinct(regexp_extract_all(lower({}), '[a-z]{{4,}}'))"


@query("+a AS (SELECT problem_id, unnest(" + _WORDS.format("statement") + ") AS w FROM problems), b AS (SELECT question_id, unnest(" + _WORDS.format("question") + ") AS w FROM (SELECT DISTINCT min(question_id) OVER (PARTITION BY question) AS question_id, question FROM questions)) SELECT problem_id, question_id, count(*) AS shared FROM a JOIN b USING (w) GROUP BY 1, 2 HAVING count(*) >= 3", "problems", "questions")
def token_overlap_links(t: Tables) -> DataFrame:
    distinct = t.questions().groupBy("question").agg(F.min("question_id").alias("question_id")).withColumnRenamed("question", "statement")
    return M.overlaps(t.problems(), distinct, "problem_id", "question_id", "statement", "[a-z]{4,}", 3)


_SETS = "d AS (SELECT item_id, list_sort(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))) AS s FROM benchmark), j AS (SELECT a.item_id AS a, b.item_id AS b, len(list_intersect(a.s, b.s)) / (len(a.s) + len(b.s) - len(list_intersect(a.s, b.s))) AS jaccard FROM d a JOIN d b ON a.item_id < b.item_id WHERE len(a.s) > 0 AND len(b.s) > 0)"


@query("WITH " + _SETS + " SELECT a, b, round(jaccard, 6) AS jaccard FROM j WHERE jaccard >= 0.15")
def jaccard_pairs_benchmark(t: Tables) -> DataFrame:
    return M.jaccard_pairs(t.raw("benchmark"), "item_id", "text", "[a-z0-9]+", 0.15).withColumn("jaccard", F.round("jaccard", 6))


@query(
    "WITH s AS (SELECT doc_id, list_sort(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))) AS s FROM documents), i AS (SELECT doc_id, unnest(s) AS w, len(s) AS n FROM s), c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k, any_value(a.n) AS n, any_value(b.n) AS m FROM i a JOIN i b ON a.w = b.w AND a.doc_id < b.doc_id GROUP BY 1, 2) SELECT a, b, round(k / (n + m - k), 6) AS jaccard FROM c WHERE k / (n + m - k) >= 0.72"
)
def jaccard_pairs(t: Tables) -> DataFrame:
    return M.jaccard_pairs(t.raw("documents"), "doc_id", "text", "[a-z0-9]+", 0.72).withColumn("jaccard", F.round("jaccard", 6))


@query("+ra AS (SELECT statement, min(problem_id) AS problem_id, count(*) AS problems FROM problems GROUP BY 1), rb AS (SELECT p_type || ' economy price market exports crude women housing' AS st, min(p_partkey) AS part_id, count(*) AS parts FROM part GROUP BY 1), a AS (SELECT problem_id, problems, unnest(" + _WORDS.format("statement") + ") AS w, len(" + _WORDS.format("statement") + ") AS n FROM ra), b AS (SELECT part_id, parts, unnest(" + _WORDS.format("st") + ") AS w FROM rb) SELECT problem_id, part_id, round(count(*) / any_value(n), 6) AS share, any_value(problems) AS problems, any_value(parts) AS parts FROM a JOIN b USING (w) GROUP BY 1, 2 HAVING count(*) / any_value(n) > 0.2", "problems")
def containment_dupes(t: Tables) -> DataFrame:
    """Pairs of distinct statements, each under its smallest id, with how many rows have them."""
    parts = t.raw("part").select(F.col("p_partkey").alias("part_id"), F.concat("p_type", F.lit(" economy price market exports crude women housing")).alias("statement"))
    return M.contained_classes(t.problems(), parts, "problem_id", "part_id", "statement", "[a-z]{4,}", 0.2, "problems", "parts").withColumn("share", F.round("share", 6))


@query(
    r"WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '') AS w FROM documents), g AS (SELECT doc_id, unnest(range(greatest(len(w) - 7, 0))) AS position, unnest(list_transform(range(greatest(len(w) - 7, 0)), lambda i: array_to_string(w[i + 1:i + 8], ' '))) AS gram FROM w), bw AS (SELECT list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '') AS w FROM benchmark), b AS (SELECT DISTINCT unnest(list_transform(range(greatest(len(w) - 7, 0)), lambda i: array_to_string(w[i + 1:i + 8], ' '))) AS gram FROM bw) SELECT doc_id, min(position) AS position, first(gram ORDER BY position) AS gram FROM g SEMI JOIN b USING (gram) GROUP BY 1"
)
def verbatim_8gram(t: Tables) -> DataFrame:
    return M.verbatim(t.raw("documents"), t.raw("benchmark"), "doc_id", "text", "text")


@query("+k AS (SELECT problem_id, list_filter(" + "list_distinct(regexp_extract_all(lower(statement), '[a-z]{5,}'))" + ", lambda w: w NOT IN (" + ", ".join(f"'{w}'" for w in R.KEYWORD_STOP) + ")) AS k, statement FROM problems) SELECT problem_id, len(k) AS n_all FROM k", "problems")
def keyword_counts(t: Tables) -> DataFrame:
    return t.problems().select("problem_id", F.size(M.keywords(F.col("statement"), R.KEYWORD_STOP, 1000)).alias("n_all"))


@query("+k AS (SELECT item_id, unnest(list_filter(regexp_extract_all(lower(text), '[a-z]{5,}'), lambda w, i: list_position(regexp_extract_all(lower(text), '[a-z]{5,}'), w) = i AND w NOT IN (" + ", ".join(f"'{w}'" for w in R.KEYWORD_STOP) + "))[1:8]) AS w FROM benchmark), h AS (SELECT artifact_id, w FROM artifacts JOIN (SELECT DISTINCT w FROM k) ON contains(lower(content), w)) SELECT item_id, artifact_id, CAST(count(*) AS INT) AS hits FROM k JOIN h USING (w) GROUP BY 1, 2 HAVING count(*) >= 2 QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY hits DESC, artifact_id DESC) <= 6", "artifacts")
def top_articles_by_keywords(t: Tables) -> DataFrame:
    """Six articles for each benchmark item by the first eight keywords of its text, of which an article holds two at least."""
    return M.best_by_keywords(t.raw("benchmark"), t.artifacts(), "item_id", "artifact_id", "text", "content", R.KEYWORD_STOP)


@query("SELECT page_id, regexp_replace(regexp_extract(lower(url), '^[a-z]+://([^/:?#]+)', 1), '^www\\.', '') AS host FROM pages")
def host_extract(t: Tables) -> DataFrame:
    return t.raw("pages").select("page_id", T.host(F.col("url")).alias("host"))


@query("SELECT p_partkey, regexp_replace(regexp_replace(lower(p_name || ' / ' || p_type), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM part")
def slugify(t: Tables) -> DataFrame:
    return t.raw("part").select("p_partkey", T.slug(F.concat("p_name", F.lit(" / "), "p_type")).alias("slug"))


_PLAIN = "regexp_replace(translate({}, '۰۱۲۳۴۵۶۷۸۹٠١٢٣٤٥٦٧٨٩', '01234567890123456789'), '[,،]', '', 'g')"


@query("SELECT doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(" + _PLAIN.format("text") + r", '[+-]?[0-9]+(?:\.[0-9]+)?%?'))), ' ') AS numbers FROM documents")
def extract_numbers(t: Tables) -> DataFrame:
    return t.raw("documents").select("doc_id", F.array_join(T.numbers_in(F.col("text")), " ").alias("numbers"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS d, translate(translate(strftime(o_orderdate, '%Y-%m-%d'), '0123456789', '۰۱۲۳۴۵۶۷۸۹'), '۰۱۲۳۴۵۶۷۸۹', '0123456789') AS back FROM orders")
def normalise_digits(t: Tables) -> DataFrame:
    d = F.date_format("o_orderdate", "yyyy-MM-dd")
    return t.raw("orders").select("o_orderkey", d.alias("d"), T.ascii_digits(F.translate(d, "0123456789", T.PERSIAN_DIGITS[:10])).alias("back"))


# drafts: sentences made of rounded, scaled and wrong figures; evidence: the orders' own figures
_DRAFTS = """drafts AS (SELECT o_orderkey AS k, 'Total of ' || CASE o_orderkey % 4 WHEN 0 THEN CAST(CAST(round(o_totalprice, 2) AS DECIMAL(18,2)) AS VARCHAR) WHEN 1 THEN CAST(CAST(round(o_totalprice, 1) AS DECIMAL(18,1)) AS VARCHAR) WHEN 2 THEN CAST(CAST(round(o_totalprice * 1.2, 1) AS DECIMAL(18,1)) AS VARCHAR) ELSE CAST(o_orderkey AS VARCHAR) || '%' END || ' in ' || year(o_orderdate) || '. Key ' || o_orderkey AS draft,
'total ' || CAST(CAST(round(o_totalprice, 2) AS DECIMAL(18,2)) AS VARCHAR) || ' on ' || strftime(o_orderdate, '%Y-%m-%d') AS given FROM orders)"""


def _drafts(t: Tables) -> DataFrame:
    key, price = F.col("o_orderkey"), F.col("o_totalprice")
    said = lambda x, d: F.round(x, d).cast(f"decimal(18,{d})").cast("string")
    figure = F.when(key % 4 == 0, said(price, 2)).when(key % 4 == 1, said(price, 1)).when(key % 4 == 2, said(price * 1.2, 1)).otherwise(F.concat(key.cast("string"), F.lit("%")))
    draft = F.concat(F.lit("Total of "), figure, F.lit(" in "), F.year("o_orderdate").cast("string"), F.lit(". Key "), key.cast("string"))
    given = F.concat(F.lit("total "), said(price, 2), F.lit(" on "), F.date_format("o_orderdate", "yyyy-MM-dd"))
    return t.raw("orders").select(key.alias("k"), draft.alias("draft"), given.alias("given"))


_UNMATCHED = (
    _DRAFTS + r", n AS (SELECT k, given, unnest(list_sort(list_distinct(regexp_extract_all(replace(draft, ',', ''), '[+-]?[0-9]+(?:\.[0-9]+)?%?')))) AS number, list_transform(regexp_extract_all(given, '[0-9]+(?:\.[0-9]+)?'), lambda x: CAST(x AS DOUBLE)) AS figures FROM drafts),"
    " b AS (SELECT *, regexp_replace(number, '%+$', '') AS bare, TRY_CAST(regexp_replace(number, '%+$', '') AS DOUBLE) AS v FROM n),"
    " u AS (SELECT k, number FROM b WHERE NOT (contains(given, bare) OR contains(given, number) OR len(list_filter(figures, lambda g: g <> 0 AND (abs(g - v) <= greatest(0.15, abs(v) * 0.005) OR (abs(v) < 10000 AND abs(g - v * 1e9) <= g * 0.01)))) > 0))"
)


@query("WITH " + _UNMATCHED + " SELECT k, number FROM u")
def unmatched_numbers(t: Tables) -> DataFrame:
    d = _drafts(t)
    return V.unmatched(d.select("k", "draft"), d.select("k", "given"), "k", "draft", "given")


@query("WITH " + _UNMATCHED + " SELECT d.k, count(u.number) = 0 AS ok, count(u.number) AS n_unmatched FROM drafts d LEFT JOIN u ON u.k = d.k GROUP BY 1")
def verify_numbers(t: Tables) -> DataFrame:
    d = _drafts(t)
    return V.verified(d.select("k", "draft"), d.select("k", "given"), "k", "draft", "given")


@query(
    r"WITH s AS (SELECT l_orderkey AS k, l_linenumber AS pos, 'Sold ' || CAST(l_quantity AS INT) || ' at ' || CAST(CAST(round(l_extendedprice * (1 + l_linenumber / 500), 2) AS DECIMAL(18,2)) AS VARCHAR) AS sentence FROM lineitem), e AS (SELECT l_orderkey AS k, list(l_extendedprice) || list(l_quantity) AS vs FROM lineitem GROUP BY 1), n AS (SELECT DISTINCT k, pos, sentence, unnest(regexp_extract_all(sentence, '[+-]?[0-9]+(?:\.[0-9]+)?%?')) AS number FROM s), d AS (SELECT DISTINCT k, pos, number FROM n), j AS (SELECT n.k, n.pos, len(list_filter(vs, lambda g: abs(g - CAST(number AS DOUBLE)) <= greatest(0.15, abs(CAST(number AS DOUBLE)) * 0.005))) > 0 AS hit FROM n JOIN e ON e.k = n.k) SELECT k, pos, count(*) AS numbers, count(*) FILTER (hit) AS backed, count(*) = count(*) FILTER (hit) AS fully FROM j GROUP BY 1, 2"
)
def claim_backing(t: Tables) -> DataFrame:
    li = t.raw("lineitem")
    price = F.round(F.col("l_extendedprice") * (1 + F.col("l_linenumber") / 500), 2).cast("decimal(18,2)").cast("string")
    s = li.select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("pos"), F.concat(F.lit("Sold "), F.col("l_quantity").cast("int").cast("string"), F.lit(" at "), price).alias("sentence")).distinct()
    e = li.select(F.col("l_orderkey").alias("k"), F.explode(F.array("l_extendedprice", "l_quantity")).alias("v"))
    return V.backed_sentences(s, e, "k", "sentence", "v")


@query("WITH " + _DRAFTS + r", n AS (SELECT k, list_distinct(regexp_extract_all(draft, '[0-9]+(?:\.[0-9]+)?')) AS own, regexp_extract_all(given, '[0-9]+(?:\.[0-9]+)?') AS asked FROM drafts) SELECT k, len(list_distinct(list_filter(asked, lambda x: NOT list_contains(own, x) AND NOT regexp_matches(x, '^(1[89][0-9]{2}|20[0-9]{2}|1[34][0-9]{2})$')))) AS missing FROM n")
def keystone_missing(t: Tables) -> DataFrame:
    d = _drafts(t)
    return V.missing_keystones(d.select("k", "draft"), d.select("k", "given"), "k", "draft", "given").select("k", F.size("missing").alias("missing"))


@query("SELECT artifact_id, pos FROM (SELECT *, coalesce(lead(proposition) OVER (PARTITION BY artifact_id ORDER BY pos), '') AS following FROM claims) WHERE regexp_matches(lower(proposition), 'tion|keit') AND NOT regexp_matches(lower(proposition), 'ening|ment') AND NOT regexp_matches(lower(following), 'ening|ment')", "claims")
def unexplained_claims(t: Tables) -> DataFrame:
    return V.unexplained(t.claims(), "artifact_id", "proposition", "tion|keit", "ening|ment")


@query(r"SELECT doc_id, len(s) AS n, coalesce(list_max(l), 0) AS longest, round(coalesce(list_sum(l) / len(s), 0), 4) AS mean FROM (SELECT doc_id, s, list_transform(s, lambda x: len(regexp_extract_all(x, '\S+'))) AS l FROM (SELECT doc_id, list_filter(list_transform(string_split_regex(text, '[.\n]+'), lambda x: trim(x, ' ')), lambda x: length(x) >= 1) AS s FROM documents))")
def sentence_stats(t: Tables) -> DataFrame:
    s = t.raw("documents").select("doc_id", T.sentences(F.col("text")).alias("s"))
    s = s.withColumn("l", F.transform("s", lambda x: F.regexp_count(x, F.lit(r"\S+"))))
    total = F.aggregate("l", F.lit(0), lambda a, x: a + x)
    return s.select("doc_id", F.size("s").alias("n"), F.coalesce(F.array_max("l"), F.lit(0)).alias("longest"), F.round(F.coalesce(F.try_divide(total, F.size("s")), F.lit(0.0)), 4).alias("mean"))


@query(r"SELECT doc_id, len(regexp_extract_all(text, '[.,;:]{2,}')) AS doubled, len(regexp_extract_all(text, '  +')) AS spaces, len(regexp_extract_all(text, ' [.,;:]')) AS spaced FROM documents")
def issue_counts(t: Tables) -> DataFrame:
    count = lambda p: F.regexp_count("text", F.lit(p))
    return t.raw("documents").select("doc_id", count("[.,;:]{2,}").alias("doubled"), count("  +").alias("spaces"), count(" [.,;:]").alias("spaced"))


@query("SELECT o_orderkey, CASE WHEN abs(o_totalprice) >= 1e6 THEN CAST(CAST(round(o_totalprice / 1e6, 1) AS DECIMAL(38,1)) AS VARCHAR) || 'M' WHEN abs(o_totalprice) >= 1e3 THEN CAST(CAST(round(o_totalprice / 1e3, 1) AS DECIMAL(38,1)) AS VARCHAR) || 'K' ELSE CAST(CAST(round(o_totalprice, 2) AS DECIMAL(38,2)) AS VARCHAR) END AS shown FROM orders")
def kpi_format(t: Tables) -> DataFrame:
    return t.raw("orders").select("o_orderkey", N.magnitude(F.col("o_totalprice")).alias("shown"))


_JALALI = """d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders), a AS (SELECT d, CAST(d - DATE '1600-03-20' AS BIGINT) AS n FROM d), b AS (SELECT *, n // 12053 AS c, n % 12053 AS r FROM a), c AS (SELECT *, r // 1461 AS q, r % 1461 AS w FROM b),
e AS (SELECT *, CASE WHEN w >= 366 THEN (w - 1) // 365 ELSE 0 END AS y, CASE WHEN w >= 366 THEN (w - 1) % 365 ELSE w END AS l FROM c)"""


@query("WITH " + _JALALI + " SELECT d, (979 + 33 * c + 4 * q + y) || '/' || lpad(CAST(CASE WHEN l < 186 THEN l // 31 ELSE 6 + (l - 186) // 30 END + 1 AS VARCHAR), 2, '0') || '/' || lpad(CAST(CASE WHEN l < 186 THEN l % 31 ELSE (l - 186) % 30 END + 1 AS VARCHAR), 2, '0') AS jalali FROM e")
def jalali_date(t: Tables) -> DataFrame:
    return t.raw("orders").select(F.to_date("o_orderdate").alias("d")).distinct().select("d", N.jalali(F.col("d")).alias("jalali"))


@query()
def greedy_distinct_claims(t: Tables) -> DataFrame:
    claims = t.claims().select("artifact_id", "pos", "proposition")
    return P.greedy_distinct(claims, ["artifact_id"], "pos", "proposition", "[a-z0-9]+", 0.72)


@query()
def title_clusters(t: Tables) -> DataFrame:
    """Each document's first claim as its title, clustered within its source by shared words in Latin or Arabic letters."""
    firsts = top_k(t.claims(), ["artifact_id"], [F.asc("pos")], 1).select("source", "artifact_id", "proposition")
    return P.seed_clusters(firsts, ["source"], "artifact_id", "proposition", P.TITLE_WORD, 3)
