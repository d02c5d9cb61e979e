"""Rule tables and functions on literal rows."""

import datetime

import pytest
from pyspark.sql import functions as F

from gleaner.functions import numeric as N
from gleaner.functions import persian as P
from gleaner.functions import rules as R
from gleaner.functions import text as T
from gleaner.operators import priority
from gleaner.operators import posts as G


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column.alias("y")).first()["y"]


X = F.col("x")


@pytest.mark.parametrize(
    "text,want",
    [
        ("US missile strikes kill civilians in Sirik", "conflict"), ("Iran crude oil exports barrels per day sanctions", "economy"), ("Iranian rial hits record low against dollar", "economy"),
        ("internet shutdown filtering in Tehran mobile networks", "tech"), ("AI startup scene in Tehran", "tech"), ("clinical trial results Tehran scientists genome study", "science"),
        ("Lake Urmia water levels drought wetland dust", "environment"), ("parliament debates new hijab fines schedule", "society"), ("new software", "conflict"), (None, "society"),
    ],
)
def test_domain(spark, text, want):
    assert one(spark, R.domain(X), text) == want


@pytest.mark.parametrize(
    "text,want",
    [
        ("Does the phase of the moon affect Iran wheat yield?", "scholarly_study"), ("How do military bases affect missile vulnerability?", "scholarly_study"),
        ("What are Iran exports in US dollars AND how do bases affect missile vulnerability?", "mixed"), ("What current plan affects Iran export vulnerability?", "mixed"),
        ("What is the total value of Iran merchandise exports in US dollars?", "quantitative_official"),
    ],
)
def test_strategy(spark, text, want):
    assert one(spark, R.evidence_strategy(X), text) == want


@pytest.mark.parametrize("text,want", [("What is the scale of bilateral trade?", "NE.EXP.GNFS.CD"), ("GDP growth matters", "NY.GDP.MKTP.CD"), ("long-term security impacts", None)])
def test_indicator(spark, text, want):
    assert one(spark, R.indicator_code(X), text) == want


@pytest.mark.parametrize("names,want", [(["Iran", "Afghanistan"], "IR"), (["Pakistan"], "PK"), (["United Nations"], None), (["Republic of Armenia"], "AM"), ([], None)])
def test_country(spark, names, want):
    assert one(spark, R.country_code(X), names, "array<string>") == want


def test_normalisation_and_hash(spark):
    assert one(spark, F.lower(T.collapsed(X)), "  Hello   World  ") == "hello world"
    assert one(spark, F.lower(T.collapsed(X)), "MULTI\nLINE\tTEXT") == "multi line text"
    h = [one(spark, T.content_hash(X), t) for t in ("Hello world", "Hello World", "Different", None, "")]
    assert h[0] == h[1] != h[2] and h[3] == h[4]
    assert one(spark, T.clean_aliases(X), [" a ", "a", "", None, "b  c"], "array<string>") == ["a", "b c"]


def test_numbers(spark):
    assert one(spark, T.numbers_in(X), "۵۶٫۴ and 1,200 then +3.5% and -2 and 3.5%") == sorted({"56", "4", "1200", "+3.5%", "-2", "3.5%"})
    assert one(spark, N.magnitude(X.cast("double")), "1234567.0") == "1.2M"
    assert one(spark, N.percent_change(F.lit(-50.0), F.lit(-25.0)), "") == 50.0
    assert one(spark, N.period_year(X), "2025-06") == 2025 and one(spark, N.period_year(X), "n/a") is None


@pytest.mark.parametrize("day,want", [("2024-03-20", "1403/01/01"), ("2025-03-20", "1403/12/30"), ("2025-03-21", "1404/01/01"), ("1979-02-11", "1357/11/22"), ("2026-11-26", "1405/09/05")])
def test_jalali(spark, day, want):
    assert one(spark, N.jalali(X), datetime.date.fromisoformat(day), "date") == want


def test_changes(spark):
    rows = [("rate", 10.0, 10.49), ("rate", 10.0, 10.5), ("level", 100.0, 101.0), ("level", 100.0, 101.1), (None, 100.0, 100.5), ("other", 1.0, 1.0), ("index", 1.0, 2.0)]
    df = spark.createDataFrame(rows, "k string, a double, b double").select(R.change_kind(F.col("k"), F.col("a"), F.col("b")).alias("c"))
    assert [r.c for r in df.collect()] == ["noise", "changed", "noise", "changed", "noise", "changed", "changed"]
    v = spark.createDataFrame([("up", "good"), ("down", "good"), ("down", "bad"), ("up", None), ("unchanged", "good")], "d string, p string").select(R.verdict(F.col("d"), F.col("p")).alias("v"))
    assert [r.v for r in v.collect()] == ["improved", "worsened", "improved", "neutral", "neutral"]


def test_priority_bounds(spark):
    tiers = spark.createDataFrame([(1,), (3,), (5,), (9,), (0,), (None,)], "t int").select(priority.reliability(F.col("t")).alias("r"))
    assert [r.r for r in tiers.collect()] == [1.0, 0.5, 0.0, 0.0, 1.0, 0.5]
    d = spark.createDataFrame([(10, 3, 10), (0, 0, 0), (5, 0, 20)], "c int, m int, e int").select(priority.density(*map(F.col, "cme")).alias("d"))
    assert [round(r.d, 6) for r in d.collect()] == [1.0, 0.0, 0.35]


def test_claim_and_entity_types(spark):
    assert [one(spark, R.claim_type(X), v) for v in (" Measurement ", "FACT", "rumour", None)] == ["observation", "fact", "statement", "statement"]
    assert [one(spark, R.entity_type(X), v) for v in ("NGO", "law", "city", None, "Company")] == ["organization", "policy", "organization", "organization", "company"]
    assert [one(spark, R.temporal_scope(X), v) for v in ("Past", "soon", None)] == ["past", None, None]


def test_link_domains_guard(spark):
    assert one(spark, R.link_domains(X), "purchasing power of households") == []
    assert one(spark, R.link_domains(X), "manpower and willpower") == []
    assert one(spark, R.link_domains(X), "power grid and housing") == ["energy", "housing"]
    assert one(spark, R.primary_domain(X), "The Groundwater-Energy-Food balance of water") == "water"
    assert one(spark, R.primary_domain(X), "nothing") is None


def test_question_status(spark):
    rows = [(True, True, True), (False, True, True), (False, False, True), (False, False, False)]
    df = spark.createDataFrame(rows, "o boolean, e boolean, u boolean").select(R.question_status(*map(F.col, "oeu")).alias("s"))
    assert [r.s for r in df.collect()] == ["deferred", "answered", "unmappable", "no_evidence"]
    o = spark.createDataFrame([(True, 0, 3), (False, 1, 0), (False, 1, 2), (False, 0, 0)], "f boolean, d int, n int").select(R.scholarly_outcome(*map(F.col, "fdn")).alias("s"))
    assert [r.s for r in o.collect()] == ["operational", "operational", "evidence", "empty"]


def test_post_gate(spark):
    good = "Iran " + "word " * 50 + "[finding:1] " * 5 + "```flowchart``` What the evidence says How it could be addressed ## 🔍 What we don't yet know"
    assert one(spark, G.gate(X, F.lit("grounded")), good).asDict() == {"decision": "PASS", "accuracy_ok": True, "engagement": 1.0}
    assert one(spark, G.gate(X, F.lit("indicative")), good + " it is solved")["decision"] == "HOLD"
    assert one(spark, G.gate(X, F.lit("indicative")), good.replace("[finding:1] ", "") + "Evidence pending")["decision"] == "REVISE"
    assert one(spark, G.gate(X, F.lit("grounded")), "")["decision"] == "HOLD"


def test_routes(spark):
    t = lambda m: datetime.datetime(2024, 1, 1, 0, m)
    rows = [("a", t(0), False), ("a", t(1), False), ("b", t(0), False), ("b", t(1), False), ("b", t(2), True), ("c", t(0), True), ("c", t(1), False), ("d", t(0), False), ("d", t(1), False), ("d", t(2), False)]
    got = {r.r: (r.fails, r.disabled_until) for r in G.route_state(spark.createDataFrame(rows, "r string, at timestamp_ntz, ok boolean"), "r", "at", "ok").collect()}
    assert got == {"a": (2, t(31)), "b": (0, None), "c": (1, None), "d": (3, datetime.datetime(2024, 1, 1, 1, 2))}


def test_persian(spark):
    assert one(spark, P.normalised(X), "او می رود ، كتاب ها 12.5") == f"او می{P.ZWNJ}رود، کتاب{P.ZWNJ}ها ۱۲٫۵"
    assert one(spark, P.join_detached_yeh(X), "خانه ی بزرگ") == f"خانه{P.ZWNJ}ی بزرگ"
    assert one(spark, P.round_big_numbers(X), "مبلغ ۲,۵۰۰,۰۰۰ ریال و ۱۲۳۴") == "مبلغ ۲٫۵ میلیون ریال و ۱۲۳۴"
    assert one(spark, P.dedupe_provider_parens(X), "یک (منبع: بانک) دو (منبع: بانک) سه (فائو)") == "یک (منبع: بانک) دو سه (فائو)"
    long = " ".join(["کلمه"] * 20 + ["و"] + ["حرف"] * 20) + "."
    assert one(spark, P.split_runons(X), long).count(".") == 2
    assert P.number("۲٬۰۰۰٫۵") == 2000.5 and P.number("x") is None
    assert one(spark, P.round_big_numbers(X), None) is None


@pytest.mark.parametrize(
    "source,want",
    [
        ("World Bank WDI", "بانک جهانی"), (" WDI ", "بانک جهانی"), ("WDI 2024", "WDI 2024"), ("Yahoo Finance", "یاهو فایننس"), ("IMF DataMapper", "صندوق بین‌المللی پول"), ("OWID:co2", "پایگاه Our World in Data"),
        ("about OWID:", "about OWID:"), ("SCI census", "مرکز آمار ایران"), ("CBI", "بانک مرکزی ایران"), ("someone", "someone"), (None, ""),
    ],
)
def test_provider_names(spark, source, want):
    assert one(spark, P.provider_name(X), source) == want


@pytest.mark.parametrize("unit,want", [("%", "٪"), ("Percent", "٪"), ("million tonnes", "میلیون تن"), ("tonnes per year", "تن"), ("t", "تن"), ("kWh per person", "کیلووات‌ساعت"), ("kilowatt", "کیلووات‌ساعت"), ("1000 persons", "نفر"), ("Yield (t/ha)", "yield (t/ha)"), (" current US$ ", "current US$"), ("", ""), (None, "")])
def test_unit_names(spark, unit, want):
    assert one(spark, P.unit_name(X), unit) == want


def test_providers_by_heads(spark):
    registry = spark.createDataFrame([("نام: قیمت نفت برنت دلار هر بشکه", "Yahoo Finance"), ("دلار", "CBI"), ("قیمت نفت برنت سبک", "IMF"), ("نرخ تورم سالانه", "CBI"), (None, "CBI")], "label string, source string")
    assert P.providers_of(registry, "label", "source") == {"قیمت نفت برنت": "صندوق بین‌المللی پول", "نرخ تورم سالانه": "بانک مرکزی ایران"}
    with pytest.raises(ValueError, match="over 1"):
        P.providers_of(registry, "label", "source", most=1)
    text = "قیمت نفت برنت به ۹۵ دلار رسید. نرخ تورم سالانه در ۲۰۲۲ برابر ۴۰ درصد بود"
    want = "قیمت نفت برنت به ۹۵ دلار (صندوق بین‌المللی پول) رسید. نرخ تورم سالانه در ۲۰۲۲ برابر ۴۰ درصد (بانک مرکزی ایران) بود"
    assert one(spark, P.inserted_sources(X, P.providers_of(registry, "label", "source")), text) == want


@pytest.mark.parametrize(
    "text,want",
    [
        ("water withdrawal and drought", ["water"]), ("women at the grid", ["energy", "labour"]), ("nothing of the kind", []), ("purchasing power of households", []),
    ],
)
def test_link_domains_on_literal_texts(spark, text, want):
    got = one(spark, R.link_domains(X), text)
    assert set(want) <= set(got) and (want or not got)


def test_card_from_the_posts_own_figures(spark):
    topics = {"price": ["قیمت", "نان"]}
    posts = [(1, "قیمت نان 40 درصد رشد و کاهش به 7 دلار داشت. تولید سالانه 123456 میلیون تن برای همه کشور بود", "افزایش قیمت نان"), (2, "هیچ عددی در این جمله بلند نیست که نیست", "x"), (3, "تولید سالانه 12 هزار تن برای همه کشور شد", "قیمت نان"), (4, "بر پایه گزارش بانک نرخ به 14 درصد در این ماه رسید", None)]
    got = {r.k: (r.pos, r.layout) for r in G.card_layouts_of(spark.createDataFrame(posts, "k int, post string, angle string"), "k", "post", "angle", topics).collect()}
    assert got == {1: (0, "contrast"), 3: (0, "no_stat"), 4: (0, "no_stat")}


def test_insights_and_sanity(spark):
    claims = spark.createDataFrame([(1, "rose to 111.9"), (2, "rose to 77"), (3, "no figure"), (4, "x" * 321), (5, "rose to 5")], "k int, c string")
    dossiers = spark.createDataFrame([(1, "111,928,863,188"), (2, "12"), (3, ""), (4, "")], "k int, d string")
    assert {tuple(r) for r in G.valid_insights(claims, dossiers, "k", "c", "d").collect()} == {(1, True), (2, False), (3, True), (4, False), (5, False)}
    posts = spark.createDataFrame([(1, "کاهش 12.5 در 2030"), (2, "پیش‌بینی 2031"), (3, "کاهش 12.5"), (4, None)], "k int, p string")
    facts = spark.createDataFrame([(1, "mixed", ["12.5"]), (1, "increasing", ["0.1", "12.5"]), (3, "decreasing", ["12.5"]), (3, "increasing", ["9.9"])], "k int, direction string, figures array<string>")
    got = {r.k: (r.ok, r.violations) for r in G.sanity(posts, facts, "k", "p", 2026).collect()}
    assert got[1] == (False, ["future:2030", "trend:increasing", "unlabelled:2030"]) and got[2] == (False, ["future:2031"]) and got[3] == (True, [])
