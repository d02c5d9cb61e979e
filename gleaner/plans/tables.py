"""The engine's logical tables over the driver's Parquet tables, as DataFrames and, for the oracle, as SQL.

Both sides follow the same written rules but share no code: names in ``SQL`` are common table expressions for DuckDB.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions import text as T

#: Stretches of which statements and questions are composed, so that the rule lexicons have something to find.
SUBJECTS = ["crude oil exports", "water drought policy", "urban housing prices", "military strike casualties", "internet shutdown data", "labour employment of women", "food crop yield", "population and marriage", "renewable energy grid", "central bank currency", "clinical research trial", "purchasing power of households"]
ANGLES = ["impact of sanctions", "status of planned negotiations", "total value in US dollars", "long-term effects", "cost of reconstruction", "the seventh committee meeting", "gdp and inflation"]
ENDINGS = ["and why do they matter?", "in recent years?", "compared with the past?", "under the new plan?", "for the central bank?"]
FARSI = ["چرا دولت یارانه را کم کرد؟", "سهم استان از بودجه نسبت به گذشته چیست؟", "کدام ادعاها درست است؟", "وضعیت بازار چگونه است؟", "بانک مرکزی از چه راهی نرخ را مهار کرد؟", "زنان روستا چه می‌خواهند؟", "قیمت نان چقدر است؟"]
#: Registry rows: indicator, label, kind, unit, topics, polarity. One indicator of the data is left out on purpose.
REGISTRY = [
    ("AF", "Exports of goods (monthly)", "level", "current US$", "trade,energy", "good"),
    ("NF", "Price index", "index", "points", "inflation", "bad"),
    ("NO", "Unemployment rate", "rate", "%", "labour,employment", "bad"),
    ("RF", "Water withdrawal", "level", "km3", "water", None),
]


def _list(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def _pick(values: list[str], at) -> F.Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.pmod(at, F.lit(len(values))) + 1).cast("int"))


class Tables:
    """Logical tables for one directory of Parquet tables; each is planned when asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.dir = spark, sf_dir

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def artifacts(self) -> DataFrame:
        status = F.when(F.length("text") >= 200, "extracted").otherwise("pending")
        return self.raw("documents").select(F.col("doc_id").alias("artifact_id"), "source", F.col("text").alias("content"), "lang", T.content_hash(F.col("text")).alias("content_hash"), status.alias("status"))

    def sources(self) -> DataFrame:
        tier = F.pmod(F.regexp_extract("source", "([0-9]+)", 1).try_cast("int"), F.lit(5)) + 1
        return self.raw("documents").select("source").distinct().select("source", tier.alias("tier"))

    def claims(self) -> DataFrame:
        split = F.posexplode(F.transform(F.split("text", r"[.\n]+"), lambda x: F.trim(x))).alias("pos", "proposition")
        return self.raw("documents").select(F.col("doc_id").alias("artifact_id"), "source", split).filter(F.length("proposition") >= 25)

    def artifact_entities(self) -> DataFrame:
        return self.raw("documents").select(F.col("doc_id").alias("artifact_id"), F.explode(T.tokens(F.col("text"), "[a-z]{10,}")).alias("entity"))

    def measurements(self) -> DataFrame:
        """Annual and monthly revenue per indicator, nation and source; the natural key is the id."""
        sold = self.raw("lineitem").join(self.raw("supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey")).join(F.broadcast(self.raw("nation")), F.col("s_nationkey") == F.col("n_nationkey"))
        value = (F.col("l_extendedprice") * (1 - F.col("l_discount"))).cast("decimal(18,4)")
        month = F.date_format("l_shipdate", "yyyy-MM")
        keys = ["indicator", "subject", "source"]
        one = sold.select(F.concat("l_returnflag", "l_linestatus").alias("indicator"), F.col("n_name").alias("subject"), F.concat(F.lit("src"), F.pmod("s_suppkey", F.lit(3)).cast("string")).alias("source"), month.alias("month"), value.alias("v"))
        # months add up to years: one pass over the line items, one shuffle by series
        monthly = one.groupBy(*keys, "month").agg(F.sum("v").alias("v"))
        both = monthly.select(*keys, F.explode(F.array(F.substring("month", 1, 4), F.col("month"))).alias("period"), "v").groupBy(*keys, "period").agg(F.round(F.sum("v"), 2).cast("double").alias("value"))
        year = F.substring("period", 1, 4)
        status = F.when((year >= "2001") & (F.col("source") == "src2"), "projection").when(year == "2000", "estimate").otherwise("raw")
        return both.select(F.concat_ws("|", *keys, "period").alias("measurement_id"), *keys, "period", "value", status.alias("status"), (year == "2000").alias("provisional"))

    def registry(self) -> DataFrame:
        return self.spark.createDataFrame(REGISTRY, "indicator string, label string, metric_kind string, unit string, topics string, polarity string")

    def problems(self) -> DataFrame:
        nation = F.broadcast(self.raw("nation"))
        key = F.col("c_custkey")
        statement = F.concat_ws(" ", _pick(SUBJECTS, key), F.lit("in"), F.initcap(F.lower("n_name")), _pick(ANGLES, key))
        status = F.when(key % 3 == 0, "published").when(key % 3 == 1, "ready").otherwise("candidate")
        return self.raw("customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(key.alias("problem_id"), statement.alias("statement"), F.when(key % 4 == 0, F.lit(None)).otherwise(F.lower("c_mktsegment")).alias("topic"), status.alias("status"))

    def problem_subjects(self) -> DataFrame:
        nation = F.broadcast(self.raw("nation"))
        return self.raw("customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("problem_id"), F.col("n_name").alias("subject"))

    def questions(self) -> DataFrame:
        key = F.col("o_orderkey")
        question = F.concat_ws(" ", F.lit("What is the"), _pick(ANGLES, key), F.lit("on"), _pick(SUBJECTS, key + F.floor(key / 7)), _pick(ENDINGS, key))
        return self.raw("orders").select(key.alias("question_id"), F.col("o_custkey").alias("problem_id"), question.alias("question"), _pick(FARSI, key).alias("question_fa"), F.to_date("o_orderdate").alias("asked"))

    def question_evidence(self) -> DataFrame:
        """Each line item links its order's question to its part, as a finding, or (returned ones) as a measurement."""
        kind = F.when(F.col("l_returnflag") == "R", "measurement").otherwise("finding")
        return self.raw("lineitem").select(F.col("l_orderkey").alias("question_id"), kind.alias("evidence_type"), F.col("l_partkey").alias("evidence_id"), F.col("l_linenumber").alias("line"))

    def findings(self) -> DataFrame:
        study = F.when(F.col("p_size") % 10 == 0, F.lit(None)).otherwise(F.pmod("p_partkey", F.lit(60)) + 1)
        return self.raw("part").select(F.col("p_partkey").alias("finding_id"), study.cast("long").alias("study_id"), F.col("p_name").alias("statement"), F.when(F.col("p_size") % 3 == 0, F.lit(None)).otherwise(F.col("p_brand")).alias("intervention"), F.col("p_type").alias("outcome"), F.when(F.col("p_size") % 4 == 0, F.lit(None)).otherwise(F.col("p_retailprice")).alias("effect_size"))

    def studies(self) -> DataFrame:
        return self.raw("supplier").select(F.col("s_suppkey").alias("study_id"), F.col("s_name").alias("title"), (1990 + F.pmod("s_suppkey", F.lit(35))).cast("int").alias("year"), F.when(F.col("s_acctbal") < 0, "rejected").alias("quality"))

    def snapshots(self) -> DataFrame:
        """Daily readings: problem = user, indicator = event type, value = the day's sum."""
        day = F.to_date("ts")
        return self.raw("events").groupBy(F.col("user_id").alias("problem_id"), F.col("event_type").alias("indicator"), day.alias("taken_at")).agg(F.round(F.sum(F.col("value").cast("decimal(18,6)")), 4).cast("double").alias("value"))


SQL = {
    "artifacts": r"SELECT doc_id AS artifact_id, source, text AS content, lang, sha256(lower(trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')))) AS content_hash, CASE WHEN length(text) >= 200 THEN 'extracted' ELSE 'pending' END AS status FROM documents",
    "sources": "SELECT DISTINCT source, TRY_CAST(regexp_extract(source, '([0-9]+)', 1) AS INT) % 5 + 1 AS tier FROM documents",
    "claims": r"SELECT * FROM (SELECT doc_id AS artifact_id, source, unnest(range(len(parts))) AS pos, trim(unnest(parts), ' ') AS proposition FROM (SELECT doc_id, source, string_split_regex(text, '[.\n]+') AS parts FROM documents)) WHERE length(proposition) >= 25",
    "artifact_entities": "SELECT DISTINCT doc_id AS artifact_id, unnest(regexp_extract_all(lower(text), '[a-z]{10,}')) AS entity FROM documents",
    "measurements": """SELECT indicator || '|' || subject || '|' || source || '|' || period AS measurement_id, indicator, subject, source, period, CAST(round(sum(v), 2) AS DOUBLE) AS value,
        CASE WHEN period[1:4] >= '2001' AND source = 'src2' THEN 'projection' WHEN period[1:4] = '2000' THEN 'estimate' ELSE 'raw' END AS status, period[1:4] = '2000' AS provisional
        FROM (SELECT l_returnflag || l_linestatus AS indicator, n_name AS subject, 'src' || (s_suppkey % 3) AS source, unnest([strftime(l_shipdate, '%Y'), strftime(l_shipdate, '%Y-%m')]) AS period,
        CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18,4)) AS v FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey) GROUP BY indicator, subject, source, period""",
    "registry": "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join("NULL" if v is None else f"'{v}'" for v in r) + ")" for r in REGISTRY) + ") AS r(indicator, label, metric_kind, unit, topics, polarity)",
    "problems": f"""SELECT c_custkey AS problem_id, {_list(SUBJECTS)}[c_custkey % 12 + 1] || ' in ' || array_to_string(list_transform(string_split(lower(n_name), ' '), lambda x: upper(x[1]) || x[2:]), ' ') || ' ' || {_list(ANGLES)}[c_custkey % 7 + 1] AS statement,
        CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE lower(c_mktsegment) END AS topic, CASE c_custkey % 3 WHEN 0 THEN 'published' WHEN 1 THEN 'ready' ELSE 'candidate' END AS status FROM customer JOIN nation ON c_nationkey = n_nationkey""",
    "problem_subjects": "SELECT c_custkey AS problem_id, n_name AS subject FROM customer JOIN nation ON c_nationkey = n_nationkey",
    "questions": f"""SELECT o_orderkey AS question_id, o_custkey AS problem_id, 'What is the ' || {_list(ANGLES)}[o_orderkey % 7 + 1] || ' on ' || {_list(SUBJECTS)}[(o_orderkey + o_orderkey // 7) % 12 + 1] || ' ' || {_list(ENDINGS)}[o_orderkey % 5 + 1] AS question,
        {_list(FARSI)}[o_orderkey % 7 + 1] AS question_fa, CAST(o_orderdate AS DATE) AS asked FROM orders""",
    "question_evidence": "SELECT l_orderkey AS question_id, CASE WHEN l_returnflag = 'R' THEN 'measurement' ELSE 'finding' END AS evidence_type, l_partkey AS evidence_id, l_linenumber AS line FROM lineitem",
    "findings": "SELECT p_partkey AS finding_id, CASE WHEN p_size % 10 = 0 THEN NULL ELSE p_partkey % 60 + 1 END AS study_id, p_name AS statement, CASE WHEN p_size % 3 = 0 THEN NULL ELSE p_brand END AS intervention, p_type AS outcome, CASE WHEN p_size % 4 = 0 THEN NULL ELSE p_retailprice END AS effect_size FROM part",
    "studies": "SELECT s_suppkey AS study_id, s_name AS title, CAST(1990 + s_suppkey % 35 AS INT) AS year, CASE WHEN s_acctbal < 0 THEN 'rejected' END AS quality FROM supplier",
    "snapshots": "SELECT user_id AS problem_id, event_type AS indicator, CAST(ts AS DATE) AS taken_at, CAST(round(sum(CAST(value AS DECIMAL(18,6))), 4) AS DOUBLE) AS value FROM events GROUP BY user_id, event_type, CAST(ts AS DATE)",
}


def with_tables(body: str, *names: str) -> str:
    """body with the named logical tables in front of it."""
    return "WITH " + ", ".join(f"{n} AS ({SQL[n]})" for n in names) + ("" if not names else ("," if body.startswith("+") else "")) + " " + body.removeprefix("+")
