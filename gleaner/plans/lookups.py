"""Queries over joins that avoid listing all pairs: changes looked up, classes of linked problems, gates over whole dossiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.functions import persian as P
from gleaner.operators import changes
from gleaner.operators import dossier as D
from gleaner.operators import evidence as E
from gleaner.operators import linking as L
from gleaner.operators import posts as G
from gleaner.plans.dossiers import _INDEX, _POSTS, _TERMS, _evidence, _in, _list, _near, _posts, significant_sql
from gleaner.plans.extras import TOPIC_WORDS
from gleaner.plans.registry import query
from gleaner.plans.tables import Tables

# percent changes ----------------------------------------------------------------------------------------------------------

_NUMBERS = "nb AS (SELECT DISTINCT problem_id, unnest([CAST(year(asked) AS VARCHAR), question_id % 100 || '%', '-' || question_id % 40 || '.5%']) AS number FROM questions)"


@query("+" + _INDEX + f", {_NUMBERS}, ch AS (SELECT DISTINCT problem_id, evidence_id, TRY_CAST(unnest([SIG, CAST(CAST(round(c, 2) AS DECIMAL(30,2)) AS VARCHAR), CAST(CAST(round(c, 1) AS DECIMAL(30,1)) AS VARCHAR)]) AS DOUBLE) AS g FROM pr), v AS (SELECT *, CAST(replace(number, '%', '') AS DOUBLE) AS v FROM nb) SELECT DISTINCT v.problem_id, number, evidence_id FROM v JOIN ch ON ch.problem_id = v.problem_id AND abs(g - v) <= greatest(0.15, abs(v) * 0.005)".replace("SIG", significant_sql("c", 4)), "problem_subjects", "measurements", "questions")
def change_bound_numbers(t: Tables) -> DataFrame:
    """Numbers of each problem's drafts and the series that have such a percent change, without a list of all changes."""
    _, series = _evidence(t)
    k = F.col("question_id")
    said = F.array(F.year("asked").cast("string"), F.concat((k % 100).cast("string"), F.lit("%")), F.concat(F.lit("-"), (k % 40).cast("string"), F.lit(".5%")))
    return changes.bound_changes_shared(t.questions().select("problem_id", F.explode(said).alias("number")), series, t.problem_subjects(), "problem_id", "subject")


# problems by classes of topics ----------------------------------------------------------------------------------------------

_TOPICS = "x AS (SELECT DISTINCT s_suppkey AS problem_id, p_type AS topic FROM supplier JOIN lineitem ON l_suppkey = s_suppkey JOIN part ON p_partkey = l_partkey WHERE l_quantity >= 49 AND l_discount >= 0.05)"
_CLASSES = f"WITH {_TOPICS}, s AS (SELECT problem_id, list_sort(list(topic)) AS s FROM x GROUP BY 1), c AS (SELECT s, min(problem_id) AS class, count(*) AS n FROM s GROUP BY 1)"


def _topics(t: Tables) -> DataFrame:
    sold = t.raw("lineitem").filter("l_quantity >= 49 AND l_discount >= 0.05").select(F.col("l_suppkey").alias("problem_id"), "l_partkey")
    return sold.join(t.raw("part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_type").alias("topic")), "l_partkey").select("problem_id", "topic").distinct()


@query(_CLASSES + ", e AS (SELECT class, n, unnest(s) AS topic FROM c), w AS (SELECT *, CASE WHEN topic = 'ECONOMY' THEN 0.25 ELSE 1.0 END AS w FROM e) SELECT a.class AS a, b.class AS b, CAST(sum(a.w) AS DOUBLE) AS score, CAST(CASE WHEN a.class = b.class THEN any_value(a.n) * (any_value(a.n) - 1) // 2 ELSE any_value(a.n) * any_value(b.n) END AS BIGINT) AS links FROM w a JOIN w b ON a.topic = b.topic AND a.class <= b.class GROUP BY 1, 2 HAVING sum(a.w) >= 1 AND max(a.w) >= 1 AND links > 0")
def problem_topic_classes(t: Tables) -> DataFrame:
    """Links between classes of problems with the same topics, with how many pairs of problems each stands for."""
    return E.topic_classes(_topics(t), ["ECONOMY"])[1]


@query(f"WITH {_TOPICS}, w AS (SELECT *, CASE WHEN topic = 'ECONOMY' THEN 0.25 ELSE 1.0 END AS w FROM x) SELECT a.problem_id, b.problem_id AS other, CAST(sum(a.w) AS DOUBLE) AS score FROM w a JOIN w b ON a.topic = b.topic AND a.problem_id <> b.problem_id WHERE a.problem_id % 50 = 0 GROUP BY 1, 2 HAVING sum(a.w) >= 1 AND max(a.w) >= 1")
def problem_topic_links_asked(t: Tables) -> DataFrame:
    """All links of the problems whose id 50 divides, expanded from the classes."""
    members, linked = E.topic_classes(_topics(t), ["ECONOMY"])
    asked = t.raw("supplier").select(F.col("s_suppkey").alias("problem_id")).filter("problem_id % 50 = 0")
    return E.topic_links_of(asked, members, linked)


# gates over whole posts and dossiers ------------------------------------------------------------------------------------------

_CLAIM = "o_orderkey AS k, 'The price rose by ' || CASE o_orderkey % 3 WHEN 0 THEN CAST(CAST(round(o_totalprice, 1) AS DECIMAL(18,1)) AS VARCHAR) WHEN 1 THEN CAST(CAST(o_totalprice * 1.3 AS BIGINT) AS VARCHAR) ELSE 'a lot' END || repeat(' and so on', CAST(o_orderkey % 40 AS INT)) AS claim, 'total ' || CAST(CAST(round(o_totalprice, 2) AS DECIMAL(18,2)) AS VARCHAR) || ' on ' || strftime(o_orderdate, '%Y-%m-%d') AS given"


@query(
    "WITH d AS (SELECT " + _CLAIM + r" FROM orders), n AS (SELECT k, given, unnest(list_distinct(regexp_extract_all(claim, '[+-]?[0-9]+(?:\.[0-9]+)?%?'))) AS number, list_transform(regexp_extract_all(given, '[0-9]+(?:\.[0-9]+)?'), lambda x: CAST(x AS DOUBLE)) AS figures FROM d), "
    "u AS (SELECT DISTINCT k FROM n WHERE NOT (contains(given, number) OR len(list_filter(figures, lambda g: g <> 0 AND (abs(g - CAST(number AS DOUBLE)) <= greatest(0.15, CAST(number AS DOUBLE) * 0.005) OR (CAST(number AS DOUBLE) < 10000 AND abs(g - CAST(number AS DOUBLE) * 1e9) <= g * 0.01)))) > 0)) SELECT k, length(claim) <= 320 AND u.k IS NULL AS valid FROM d LEFT JOIN u USING (k)"
)
def insights_against_dossiers(t: Tables) -> DataFrame:
    """Claims short enough whose every figure the dossier backs."""
    k, price = F.col("o_orderkey"), F.col("o_totalprice")
    figure = F.when(k % 3 == 0, F.round(price, 1).cast("decimal(18,1)").cast("string")).when(k % 3 == 1, F.round(price * 1.3).cast("bigint").cast("string")).otherwise("a lot")
    claim = F.concat(F.lit("The price rose by "), figure, F.repeat(F.lit(" and so on"), (k % 40).cast("int")))
    given = F.concat(F.lit("total "), F.round(price, 2).cast("decimal(18,2)").cast("string"), F.lit(" on "), F.date_format("o_orderdate", "yyyy-MM-dd"))
    o = t.raw("orders").select(k.alias("k"), claim.alias("claim"), given.alias("given"))
    return G.valid_insights(o.select("k", "claim"), o.select("k", "given"), "k", "claim", "given")


_FACTS = "f AS (SELECT k, unnest([0, 1]) AS i, CASE (k + i) % 3 WHEN 0 THEN 'increasing' WHEN 1 THEN 'decreasing' ELSE 'mixed' END AS direction, CASE i WHEN 0 THEN figures ELSE ['0.5', CAST(k % 1000 AS VARCHAR) || '.5'] END AS figures FROM post)"


def _contradicts(direction: str, words: list[str]) -> str:
    return f"(direction = '{direction}' AND ({' OR '.join(map(_near, words))}))"


@query(
    "WITH POSTS, FACTS, c AS (SELECT DISTINCT k, 'trend:' || direction AS x FROM (SELECT f.k, f.direction, f.figures, post FROM f JOIN post USING (k)) WHERE <up> OR <down>), "
    r"y AS (SELECT k, post, CAST(unnest(list_distinct(regexp_extract_all(post, '\b(1[89][0-9]{2}|20[0-9]{2})\b', 1))) AS INT) AS y FROM post), z AS (SELECT *, strpos(post, CAST(y AS VARCHAR)) AS spot FROM y WHERE y > 1998), "
    "v AS (SELECT k, 'future:' || y AS x FROM z UNION ALL SELECT k, 'unlabelled:' || y FROM z WHERE len(list_filter(LABELS, lambda l: contains(substr(post, greatest(spot - 70, 1), CASE WHEN spot > 70 THEN 140 ELSE 69 + spot END), l))) = 0 UNION ALL SELECT k, x FROM c) SELECT post.k, count(x) = 0 AS ok, coalesce(string_agg(x, ',' ORDER BY x), '') AS violations FROM post LEFT JOIN v ON v.k = post.k GROUP BY 1"
    .replace("FACTS", _FACTS).replace("<up>", _contradicts("increasing", G.FALLING)).replace("<down>", _contradicts("decreasing", G.RISING)).replace("LABELS", _list(G.FORECAST_LABELS)).replace("POSTS", _POSTS)
)
def post_sanity(t: Tables) -> DataFrame:
    """All that a post has against it, by its years and by the trends of all series of its dossier."""
    p, k = _posts(t), F.col("k")
    more = F.array(F.lit("0.5"), F.concat((k % 1000).cast("string"), F.lit(".5")))
    direction = F.when((k + F.col("i")) % 3 == 0, "increasing").when((k + F.col("i")) % 3 == 1, "decreasing").otherwise("mixed")
    facts = p.select("k", F.posexplode(F.array("figures", more)).alias("i", "figures")).select("k", direction.alias("direction"), "figures")
    return G.sanity(p.select("k", "post"), facts, "k", "post", 1998).select("k", "ok", F.array_join("violations", ",").alias("violations"))


_SAID = ["قیمت نان {} درصد رشد و کاهش به {} دلار داشت و مردم نگران‌اند", "بر پایه گزارش بانک نرخ به {} رسید و {} نفر بیکار شدند", "تولید سالانه {} هزار تن و صادرات {} میلیون دلار شد", "این جمله هیچ عددی ندارد و بی‌ربط است برای همه"]
_ANGLES = ["افزایش قیمت نان", "تولید سالانه کشور", ""]


def _card_posts(t: Tables) -> DataFrame:
    k, n = F.col("o_orderkey"), F.col("o_custkey").cast("string")

    def sentence(at):
        parts = F.split(F.element_at(F.array(*[F.lit(s) for s in _SAID]), (F.pmod(at, F.lit(4)) + 1).cast("int")), r"\{\}")
        return F.concat(F.get(parts, F.lit(0)), F.when(F.size(parts) > 1, F.concat(n, F.get(parts, F.lit(1)), (F.pmod(k, F.lit(97)) + 3).cast("string"), F.get(parts, F.lit(2)))).otherwise(""))

    post = F.concat_ws(". ", sentence(k), sentence(k + F.floor(k / 4)), sentence(F.floor(k / 3)))
    angle = F.element_at(F.array(*[F.lit(a) for a in _ANGLES]), (F.pmod(k, F.lit(3)) + 1).cast("int"))
    return t.raw("orders").select(k.alias("k"), post.alias("post"), angle.alias("angle"))


def _said_sql(at: str) -> str:
    return f"replace(regexp_replace({_list(_SAID)}[({at}) % 4 + 1], '\\{{\\}}', CAST(o_custkey AS VARCHAR)), '{{}}', CAST(o_orderkey % 97 + 3 AS VARCHAR))"


_UNITS = "|".join(["میلیارد", "میلیون", "هزار", "درصد", "تُن", "متر", "نفر", "دلار", "تن", "ریال", "تومان", "بشکه"])
_SHARED = "len(list_intersect(list_filter(list_distinct(regexp_extract_all({a}, '[؀-ۿ]{{3,}}')), lambda w: NOT list_contains(STOP, w)), list_filter(list_distinct(regexp_extract_all({b}, '[؀-ۿ]{{3,}}')), lambda w: NOT list_contains(STOP, w))))".replace("STOP", _list(P.STOP_WORDS))


@query(
    f"WITH p AS (SELECT o_orderkey AS k, [{_said_sql('o_orderkey')}, {_said_sql('o_orderkey + o_orderkey // 4')}, {_said_sql('o_orderkey // 3')}] AS ss, {_list(_ANGLES)}[o_orderkey % 3 + 1] AS angle FROM orders), s AS (SELECT k, angle, unnest(range(3)) AS pos, unnest(ss) AS s FROM p), "
    rf"r AS (SELECT k, angle, pos, s, unnest(regexp_extract_all(s || ' ', '([0-9]+)\s*({_UNITS})?[\s،؛.)]', 1)) AS raw, unnest(regexp_extract_all(s || ' ', '([0-9]+)\s*({_UNITS})?[\s،؛.)]', 2)) AS unit, unnest(range(len(regexp_extract_all(s || ' ', '([0-9]+)\s*({_UNITS})?[\s،؛.)]', 1)))) AS i FROM s), "
    "q AS (SELECT *, least(length(raw), 6) + CASE WHEN unit = 'درصد' THEN 4 WHEN unit IN ('میلیون', 'میلیارد', 'هزار') THEN 3 WHEN unit <> '' THEN 1 ELSE 0 END AS score FROM r WHERE CAST(raw AS BIGINT) <> 0 AND NOT (unit = '' AND length(raw) = 4 AND CAST(raw AS INT) BETWEEN 1300 AND 2100)), "
    "f AS (SELECT * FROM q QUALIFY row_number() OVER (PARTITION BY k, pos ORDER BY i) <= 3), g AS (SELECT k, pos, angle, s, sum(score) AS strength, count(DISTINCT unit) AS units FROM f GROUP BY ALL), "
    f"a AS (SELECT *, {_SHARED.format(a='s', b='angle')} + " + " + ".join(f"CASE WHEN {_in('s', w)} > 0 AND {_in('angle', w)} > 0 THEN 1 ELSE 0 END" for w in TOPIC_WORDS.values()) + " AS overlap FROM g), "
    f"b AS (SELECT *, strength + CASE WHEN {_in('s', G.REPORTED)} > 0 THEN 2 ELSE 0 END + 4 * overlap AS score FROM a QUALIFY row_number() OVER (PARTITION BY k ORDER BY strength + CASE WHEN {_in('s', G.REPORTED)} > 0 THEN 2 ELSE 0 END + 4 * overlap DESC, pos) = 1) "
    f"SELECT k, s AS sentence, CASE WHEN (angle <> '' AND overlap = 0) OR {_in('s', G.REPORTED[:2])} > 0 THEN 'no_stat' WHEN {_in('s', G.FALLS)} > 0 AND {_in('s', G.GROWS)} > 0 AND units >= 2 THEN 'contrast' ELSE 'no_stat' END AS layout FROM b"
)
def post_card_layouts(t: Tables) -> DataFrame:
    """The sentence and layout of each post's card, from the post's own figures and its angle."""
    return G.card_layouts_of(_card_posts(t), "k", "post", "angle", TOPIC_WORDS).select("k", "sentence", "layout")


_LICENCE = "(" + " OR ".join(f"(list_contains(topics, '{k}') AND {_in('lower(statement)', v)} > 0)" for k, v in _TERMS.items()) + ")"


@query("+y AS (SELECT subject, indicator, CAST(period[1:4] AS INT) * 100 + CAST(period[6:7] AS INT) AS year, sum(value) AS value FROM measurements WHERE length(period) = 7 AND status IS DISTINCT FROM 'projection' GROUP BY ALL), r AS (SELECT indicator, list_transform(string_split(topics, ','), lambda x: trim(x)) AS topics FROM registry), l AS (SELECT * FROM y QUALIFY row_number() OVER (PARTITION BY subject, indicator ORDER BY year DESC) <= 36), e AS (SELECT subject, indicator, count(*) AS n, first(value ORDER BY year) AS a, last(value ORDER BY year) AS b FROM l GROUP BY 1, 2), s AS (SELECT subject, indicator, n, round(abs(b - a) / greatest(abs(a), 1e-9), 6) AS span FROM e WHERE n >= 8 AND a <> b), p AS (SELECT DISTINCT problem_id, subject, statement FROM problems JOIN problem_subjects USING (problem_id)) SELECT problem_id, s.indicator, n, span, row_number() OVER (PARTITION BY problem_id ORDER BY span DESC, s.indicator) AS place FROM p JOIN s USING (subject) LEFT JOIN r ON r.indicator = s.indicator WHERE coalesce(" + _LICENCE + ", true) QUALIFY place <= 3", "measurements", "registry", "problems", "problem_subjects")
def licensed_card_series(t: Tables) -> DataFrame:
    """The three widest series of each problem's subject that its statement licenses: off-topic ones go before the three are picked."""
    m = t.measurements().filter("length(period) = 7 AND NOT (status <=> 'projection')")
    year = F.substring("period", 1, 4).cast("int") * 100 + F.substring("period", 6, 2).cast("int")
    points = m.groupBy("subject", "indicator", year.alias("year")).agg(F.sum("value").alias("value"))
    spans = G.series_spans(points, ["subject"])
    angles = t.problems().select("problem_id", "statement").join(t.problem_subjects(), "problem_id")
    return G.licensed_series(spans, angles, t.registry(), "subject", "problem_id", "statement", _TERMS)


# posts and their panel ------------------------------------------------------------------------------------------------------

_GRAMS = "list_distinct(list_transform(range(greatest(len(w) - 2, 0)), lambda i: array_to_string(w[i + 1:i + 3], ' ')))"
_POST_FA = "p AS (SELECT question_id, problem_id, question_id AS spot, question_fa || ' ' || FARSI[question_id // 7 % 7 + 1] || ' ' || FARSI[question_id // 49 % 7 + 1] AS post FROM questions)"


def _farsi_posts(t: Tables) -> DataFrame:
    from gleaner.plans.tables import FARSI, _pick

    k = F.col("question_id")
    return t.questions().select("question_id", "problem_id", k.alias("spot"), F.concat_ws(" ", "question_fa", _pick(FARSI, F.floor(k / 7)), _pick(FARSI, F.floor(k / 49))).alias("post"))


def _farsi_sql() -> str:
    from gleaner.plans.tables import FARSI

    return _POST_FA.replace("FARSI", _list(FARSI))


@query(
    "+" + _farsi_sql() + f", g AS (SELECT question_id, problem_id, spot, {_GRAMS} AS a FROM (SELECT *, regexp_extract_all(post, '[؀-ۿ]+')[1:12] AS w FROM p)), pr AS (SELECT DISTINCT problem_id FROM g), top AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY problem_id ORDER BY spot DESC) <= 20), "
    "n AS (SELECT * FROM top ORDER BY spot DESC LIMIT 40), l AS (SELECT pr.problem_id AS owner, n.* FROM pr JOIN n ON n.problem_id <> pr.problem_id QUALIFY row_number() OVER (PARTITION BY pr.problem_id ORDER BY spot DESC) <= 20) "
    "SELECT g.question_id, round(max(CASE WHEN len(g.a) > 0 AND len(l.a) > 0 THEN len(list_intersect(g.a, l.a)) / len(list_distinct(g.a || l.a)) ELSE 0 END), 6) AS similarity FROM g JOIN l ON l.owner = g.problem_id GROUP BY 1",
    "questions",
)
def post_opening_similarity(t: Tables) -> DataFrame:
    """How much the opening of each post (Persian words) is like one of the last twenty of other problems."""
    p = _farsi_posts(t)
    return L.opening_similarity_to_others(p, p, "problem_id", "question_id", "post", "spot", r"[\u0600-\u06FF]+").withColumn("similarity", F.round("similarity", 6))


@query("SELECT o_custkey AS problem_id, count(*) AS versions, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS latest, arg_max(o_totalprice, (o_orderdate, o_orderkey)) AS score, arg_max(o_orderpriority, (o_orderdate, o_orderkey)) AS decision, bool_or(o_orderstatus = 'F') AS delivered FROM orders JOIN problems ON problem_id = o_custkey GROUP BY 1", "problems")
def panel_posts(t: Tables) -> DataFrame:
    """Each problem's posts: how many versions, the newest with its score and decision, and whether one was delivered."""
    o = t.raw("orders").select(F.col("o_custkey").alias("problem_id"), "o_orderkey", "o_totalprice", "o_orderpriority", "o_orderstatus", F.struct("o_orderdate", "o_orderkey").alias("at"))
    g = o.groupBy("problem_id").agg(F.count("*").alias("versions"), F.max_by(F.struct("o_orderkey", "o_totalprice", "o_orderpriority"), "at").alias("x"), F.bool_or(F.col("o_orderstatus") == "F").alias("delivered"))
    return g.join(t.problems().select("problem_id"), "problem_id").select("problem_id", "versions", F.col("x.o_orderkey").alias("latest"), F.col("x.o_totalprice").alias("score"), F.col("x.o_orderpriority").alias("decision"), "delivered")


@query(
    "+e AS (SELECT problem_id, question_id AS place, question || ' since ' || year(asked) AS text FROM questions JOIN (SELECT DISTINCT question_id FROM question_evidence WHERE evidence_type = 'measurement') USING (question_id)), d AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY problem_id, text[1:120] ORDER BY place) = 1), "
    "ev AS (SELECT problem_id, string_agg('- ' || text, chr(10) ORDER BY place) AS body FROM (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY problem_id ORDER BY place) <= 12) GROUP BY 1), "
    "lv AS (SELECT problem_id, coalesce(intervention, 'other ways') AS lever, bool_or(effect_size IS NOT NULL) AS verified FROM questions JOIN question_evidence USING (question_id) JOIN findings ON finding_id = evidence_id WHERE evidence_type = 'finding' GROUP BY 1, 2), "
    "ls AS (SELECT problem_id, string_agg('- ' || lever || CASE WHEN verified THEN '' ELSE ' (not verified)' END, chr(10) ORDER BY lever) AS body, count(*) FILTER (NOT verified) AS weak FROM lv GROUP BY 1), "
    "gp AS (SELECT problem_id, string_agg('- ' || question, chr(10) ORDER BY question_id) AS body, count(*) AS open FROM questions WHERE question_id NOT IN (SELECT question_id FROM question_evidence) GROUP BY 1) "
    "SELECT problem_id, '# ' || trim(statement) || chr(10) || chr(10) || '## Evidence' || chr(10) || coalesce(ev.body, 'None is linked yet.') || chr(10) || chr(10) || '## Levers' || chr(10) || coalesce(ls.body, 'None is known yet.') || chr(10) || chr(10) || '## Open questions' || chr(10) || coalesce(gp.body, 'None.') AS body, "
    "concat_ws(',', CASE WHEN ev.body IS NULL THEN 'no_evidence' END, CASE WHEN weak > 0 THEN 'unverified:' || weak END, CASE WHEN open > 0 THEN 'open:' || open END) AS flags FROM problems LEFT JOIN ev USING (problem_id) LEFT JOIN ls USING (problem_id) LEFT JOIN gp USING (problem_id)",
    "problems", "questions", "question_evidence", "findings",
)
def post_markdown(t: Tables) -> DataFrame:
    """The first draft of a problem's post: headline, evidence, levers, open questions, and what it is flagged for."""
    q, links = t.questions(), t.question_evidence()
    measured = links.filter("evidence_type = 'measurement'").select("question_id").distinct()
    evidence = q.join(measured, "question_id").select("problem_id", F.col("question_id").alias("place"), F.concat("question", F.lit(" since "), F.year("asked").cast("string")).alias("text"))
    found = q.select("problem_id", "question_id").join(links.filter("evidence_type = 'finding'"), "question_id").join(t.findings(), F.col("evidence_id") == F.col("finding_id"))
    levers = found.select("problem_id", F.coalesce("intervention", F.lit("other ways")).alias("lever"), F.col("effect_size").isNotNull().alias("verified"))
    gaps = q.join(links, "question_id", "left_anti").select("problem_id", F.col("question_id").alias("place"), "question")
    return D.post_bodies(t.problems(), evidence, levers, gaps, "problem_id")
