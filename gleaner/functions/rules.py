"""Rule-based classification: lexicons as data, columns that apply them.

The lexicons below are fixed values: results depend on them word for word.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleaner.functions.text import bound, clean_string, containing

# Fixed values -----------------------------------------------------------------------------------------------------
#: Ordered patterns over lower-case text; the first that matches gives the domain.
DOMAIN_PATTERNS = [
    ("conflict", r"strike|missile|casualt|killed|killing|war|military|retaliat|escalat|attack|troops|weapon|army|naval|drone"),
    ("economy", r"\boil\b|exports?|budget|\brial\b|currency|inflation|sanction|trade|tariff|subsid|bank|gdp|revenue"),
    ("tech", r"internet|cyber|\bai\b|software|satellite|telecom|mobile|startup|\bapp\b|hack|malware|shutdown|filtering|censor|satellite"),
    ("science", r"stud(y|ies)|research|vaccine|trial|discovery|scientists?| arxiv|genome|clinical|space|astronom"),
    ("environment", r"water|drought|\blake\b|pollution|\bair\b|sandstorm|earthquake|wildlife|forest|climate| urmia|dust|wetland"),
]
DEFAULT_DOMAIN = "society"
#: Terms of the link domains; terms under six letters count as whole words only.
LINK_DOMAINS = {
    "energy": ["energy", "renewable", "electricity", "grid", "power", "fuel"],
    "water": ["water", "groundwater", "hydro", "irrigation", "drought"],
    "agri": ["agricultur", "crop", "farm", "food", "soil", "land"],
    "climate": ["climate", "weather", "dust", "emission"],
    "economy": ["economy", "economic", "trade", "tariff", "sanction", "growth", "gdp", "investment", "credit", "macro", "inflat", "price", "prices", "cpi", "purchasing", "basket", "household", "market", "markets", "oil", "gold", "brent", "stock", "stocks", "share", "shares", "crude"],
    "housing": ["housing", "house", "mortgage", "urban", "city", "cities", "vacancy", "settlement"],
    "labour": ["labor", "labour", "employment", "unemployment", "women", "work"],
    "population": ["population", "fertility", "marriage", "family", "ageing", "demograph"],
    "military": ["military", "militari", "defense", "defence", "army", "weapon", "armed", "troop", "nato"],
    "conflict": ["conflict", "war", "battle", "casualt", "killed", "attack", "strike", "violence"],
    "governance": ["govern", "policy", "policie", "institution", "regulat", "subsid", "corrupt", "transparen", "democra"],
    "technology": ["technolog", "digital", "internet", "mobile", "broadband", "telecom", "connectiv", "startup", "platform", "ai", "cyber", "data", "software"],
}
FALSE_FRIENDS = ["purchasing power", "households", "household"]
NEWS_DOMAINS = {
    "housing": ["housing", "home", "vacanc", "mehr", "residential"],
    "construction": ["construct", "build"],
    "energy": ["energy", "electric", "gas", "power grid"],
    "water": ["water", "drought", "scarcity"],
    "export": ["export"],
    "agriculture": ["agricultur", "pistachio", "farm", "crop"],
    "women": ["women", "gender", "female"],
    "labor": ["labor", "employment", "unemploy", "job", "participation"],
    "cooperatives": ["cooperative"],
    "conflict": ["conflict", "war", "military", "security", "nato"],
    "sanctions": ["sanction"],
    "family": ["marriage", "family formation", "household formation", "divorce"],
    "migration": ["migration", "brain drain", "emigrat"],
}
QUANT_STRONG = ["trade", "export", "exports", "import", "imports", "bilateral", "transit", "pipeline", "tariff", "tariffs", "customs", "gdp", "world bank", "central bank", "comtrade", "balance of payments", "merchandise", "tonnage", "volumes", "volume", "us$", "dollar", "dollars"]
QUANT_WEAK = ["cost", "costs", "financial cost", "rebuild", "reconstruction", "data", "figures", "indicator", "output", "production"]
CURRENT = ["status", "planned", "plan", "meeting", "committee", "recent", "ongoing", "now", "latest", "underway", "schedule", "scheduled", "joint", "seventh", "negotiation", "negotiations", "implementation", "implement", "implemented", "enforce", "enforced", "develop", "developing", "launch", "launched", "measure", "measures"]
SCHOLARLY = ["impact", "impacts", "effect", "effects", "long-term", "evidence", "study", "studies", "literature", "mechanism", "mechanisms", "why", "causal", "evaluate", "evaluation", "assess", "assessment", "extent", "correlat", "trend", "trends", "implication", "implications", "affect", "affects", "vulnerab", "determine", "drive", "drives", "factors", "relationship", "relation"]
INDICATOR_KEYWORDS = [
    ("trade", "NE.EXP.GNFS.CD"), ("export", "NE.EXP.GNFS.CD"), ("import", "NE.IMP.GNFS.CD"), ("gdp", "NY.GDP.MKTP.CD"), ("inflation", "FP.CPI.TOTL.ZG"), ("population", "SP.POP.TOTL"),
    ("life expectancy", "SP.DYN.LE00.IN"), ("co2", "EN.ATM.CO2E.KT"), ("foreign direct investment", "BX.KLT.DINV.CD.WD"), ("remittance", "BX.TRF.PWKR.CD.DT"), ("oil", "TX.VAL.MRCH.CD.WT"),
]
COUNTRY_CODES = {
    "iran": "IR", "afghanistan": "AF", "pakistan": "PK", "turkey": "TR", "india": "IN", "china": "CN", "russia": "RU", "united states": "US", "israel": "IL", "iraq": "IQ", "saudi arabia": "SA",
    "united arab emirates": "AE", "qatar": "QA", "kuwait": "KW", "kazakhstan": "KZ", "turkmenistan": "TM", "azerbaijan": "AZ", "armenia": "AM", "georgia": "GE", "oman": "OM",
}
TOPIC_EVIDENCE = {
    "agriculture": ["agricultur", "farm", "crop", "greenhouse", "wheat", "cereal"],
    "food": ["food", "essential goods", "nutrition"],
    "water": ["water", "drought", "irrigat"],
    "energy": ["energy", "fuel", "gas", "power"],
    "electricity": ["electric", "power", "grid", "blackout"],
    "climate": ["climate", "emission", "carbon", "warming"],
    "environment": ["environment", "pollut", "emission"],
    "labour": ["labor", "labour", "employ", "work", "job"],
    "employment": ["employ", "job", "unemploy", "work"],
    "youth": ["youth", "young"],
    "gender": ["women", "gender", "female"],
    "wages": ["wage", "salary", "income"],
    "housing": ["housing", "house", "rent", "dwelling", "town"],
    "urbanization": ["urban", "city", "town"],
    "population": ["population", "demograph", "childbearing", "birth"],
    "trade": ["export", "import", "trade", "sanction", "tariff"],
    "inflation": ["inflation", "price"],
}
CLAIM_TYPES = ["fact", "statement", "prediction", "observation", "causal", "relationship"]
SCOPES = ["past", "present", "future"]
ENTITY_TYPES = ["person", "organization", "company", "country", "institution", "facility", "policy"]
ENTITY_ALIASES = {
    "org": "organization", "ngo": "organization", "government": "institution", "government body": "institution", "agency": "institution", "personnel": "person", "corporation": "company",
    "firm": "company", "state": "country", "nation": "country", "building": "facility", "infrastructure": "facility", "law": "policy", "legislation": "policy",
}
BANNED_QUESTIONS = [r"داده‌های کلان.*دیده می‌شود", r"کدام ادعاها", r"چگونه دیده می‌شود", r"چه تأثیری دارد\??$", r"وضعیت.*چگونه است\??$"]
SPECIFIC_MARKERS = ["دولت", "مجلس", "بانک مرکزی", "وزارت", "سپاه", "شهرداری", "صندوق", "اوپک", "آژانس", "شرکت", "بازار آزاد", "بخش خصوصی", "سازوکار", "از چه راهی", "چرا", "مکانیسم", "زنجیره", "نسبت به", "در مقایسه", "گذشته", "دهه", "فقیر", "غنی", "روستا", "استان", "زنان", "جوانان", "نسل"]
NONMACRO_MARKERS = ["دولت", "مجلس", "بانک مرکزی", "وزارت", "شهرداری", "قانون", "یارانه", "گذشته", "دهه", "تاریخ", "فقیر", "غنی", "روستا", "استان", "زنان", "توزیع", "سهم", "نابرابری", "فساد", "رانت"]
FAMILIES = [
    ["export", "crude", "oil", "fuel", "petroleum", "gas", "trade"],
    ["reserve", "exchange", "rial", "dollar", "currency", "import"],
    ["price", "inflation", "cpi", "consumer"],
    ["water", "groundwater", "irrigation", "drought", "withdrawal"],
    ["energy", "electricity", "power", "grid", "renewable"],
    ["crop", "cereal", "wheat", "yield", "agriculture", "farm", "food", "land", "soil", "degradation", "dust", "desertification"],
    ["labor", "labour", "employment", "unemployment", "job", "women"],
    ["housing", "urban", "city", "cities", "vacancy", "mortgage"],
    ["population", "fertility", "birth", "marriage", "childbearing"],
    ["military", "militari", "defense", "defence", "army", "weapon", "expenditure"],
    ["conflict", "war", "battle", "death", "killed", "attack", "strike"],
    ["govern", "policy", "institution", "regulat", "subsid", "corrupt"],
]
NOISE_FLOOR = {"rate": 0.5, "share": 0.5, "index": 1.0, "level": 0.0, "count": 0.0}
KEYWORD_STOP = ["what", "which", "with", "from", "that", "this", "these", "those", "have", "there", "their", "about", "among", "after", "before", "percentage", "percent", "rate", "total", "monthly", "standard", "following", "iran", "iranian", "people", "person", "persons", "household", "households", "change", "changed", "changes", "cost", "costs", "group", "groups", "impact", "effects", "power", "small", "large", "country"]
# ------------------------------------------------------------------------------------------------------------------


def _low(text: Column) -> Column:
    return F.lower(F.coalesce(text, F.lit("")))


def _certain(alternative: str) -> str:
    """The longest stretch of plain letters that each match of the alternative holds."""
    return max(re.findall("[a-z ]+", re.sub(r"\\b|\([^()]*\)[?*]?|.[?*]", "|", alternative)), key=len, default="")


def found(low: Column, pattern: str) -> Column:
    """Whether a pattern of alternatives is found: plain ones by a search for the term, others only where their certain letters are.

    Bounds of a word are looked at behind its letters, not at each place of the text.
    """
    one = []
    for alternative in dict.fromkeys(re.findall(r"(?:[^|()]|\([^()]*\))+", pattern)):
        certain = _certain(alternative)
        looked = rf"{certain}(?<=\b{certain})\b" if alternative == rf"\b{certain}\b" else alternative
        one.append(low.contains(certain) if certain == alternative else low.contains(certain) & low.rlike(looked))
    return reduce(lambda a, b: a | b, one)


def domain(text: Column) -> Column:
    """The first domain whose pattern is found in the text."""
    return bound(_low(text), lambda low: F.coalesce(*[F.when(found(low, pattern), F.lit(name)) for name, pattern in DOMAIN_PATTERNS], F.lit(DEFAULT_DOMAIN)))


def _named(found: list[tuple[str, Column]]) -> Column:
    return F.array_compact(F.array(*[F.when(hit, F.lit(name)) for name, hit in found]))


def link_domains(text: Column) -> Column:
    """All link domains of a text, false friends taken out first."""
    clean = reduce(lambda t, phrase: F.replace(t, F.lit(phrase), F.lit(" ")), FALSE_FRIENDS, _low(text))

    def hit(low: Column, terms: list[str]) -> Column:
        short, long = [t for t in terms if len(t) < 6], [t for t in terms if len(t) >= 6]
        parts = ([low.rlike(r"\b(" + "|".join(short) + r")\b")] if short else []) + [low.contains(t) for t in long]
        return reduce(lambda a, b: a | b, parts)

    return bound(clean, lambda low: _named([(name, hit(low, terms)) for name, terms in LINK_DOMAINS.items()]))


def primary_domain(text: Column) -> Column:
    """The link domain whose terms occur most often; the first of equals, null if none does."""

    def best(low: Column) -> Column:
        times = lambda t: F.when(low.contains(t), F.regexp_count(low, F.lit(t))).otherwise(0)
        scored = [F.struct(sum((times(t) for t in terms), F.lit(0)).alias("n"), F.lit(-k).alias("k"), F.lit(name).alias("name")) for k, (name, terms) in enumerate(LINK_DOMAINS.items())]
        return F.array_max(F.array(*scored))

    return bound(bound(_low(text), best), lambda x: F.when(x["n"] > 0, x["name"]))


def news_domains(text: Column) -> Column:
    low = _low(text)
    found = _named([(name, reduce(lambda a, b: a | b, [low.contains(t) for t in terms])) for name, terms in NEWS_DOMAINS.items()])
    return F.when(F.size(found) == 0, F.array(F.lit("conflict"))).otherwise(found)


def evidence_strategy(question: Column) -> Column:
    """Which substrate answers a question: quantitative_official, scholarly_study, current_event or mixed."""
    strong, weak, current, scholarly = (containing(question, x) for x in (QUANT_STRONG, QUANT_WEAK, CURRENT, SCHOLARLY))
    return (
        F.when((strong >= 1) & ((current >= 1) | (scholarly >= 1)), "mixed")
        .when(strong >= 1, "quantitative_official")
        .when(weak >= 1, "mixed")
        .when((current >= 1) & (scholarly <= current + 1), "current_event")
        .otherwise("scholarly_study")
    )


def substrates(strategy: Column) -> Column:
    return (
        F.when(strategy == "mixed", F.array(F.lit("scholarly"), F.lit("quantitative")))
        .when(strategy == "quantitative_official", F.array(F.lit("quantitative")))
        .when(strategy == "current_event", F.array(F.lit("current")))
        .otherwise(F.array(F.lit("scholarly")))
    )


def indicator_code(question: Column) -> Column:
    """The code of the first keyword, in fixed order, that the question holds; null if none."""
    return F.coalesce(*[F.when(_low(question).contains(key), F.lit(code)) for key, code in INDICATOR_KEYWORDS])


def country_code(names: Column) -> Column:
    """The code of the first name that is, or else that holds, a known country."""
    codes = F.create_map(*[F.lit(x) for pair in COUNTRY_CODES.items() for x in pair])
    exact = F.transform(names, lambda n: F.try_element_at(codes, F.lower(F.trim(n))))
    part = F.transform(names, lambda n: F.coalesce(*[F.when(F.lower(n).contains(k), F.lit(v)) for k, v in COUNTRY_CODES.items()]))
    each = F.zip_with(exact, part, lambda a, b: F.coalesce(a, b))
    return F.try_element_at(F.array_compact(each), F.lit(1))


def topic_supported(topic: Column, statement: Column) -> Column:
    """Whether the statement holds a term of the topic; unknown topics pass."""
    low = _low(statement)
    known = [F.when(topic == t, reduce(lambda a, b: a | b, [low.contains(x) for x in terms])) for t, terms in TOPIC_EVIDENCE.items()]
    return F.coalesce(*known, F.lit(True))


def claim_type(value: Column) -> Column:
    v = F.lower(clean_string(value))
    return F.when(v == "measurement", "observation").when(v.isin(CLAIM_TYPES), v).otherwise("statement")


def temporal_scope(value: Column) -> Column:
    v = F.lower(clean_string(value))
    return F.when(v.isin(SCOPES), v)


def entity_type(value: Column) -> Column:
    v = F.lower(clean_string(value))
    aliases = F.create_map(*[F.lit(x) for pair in ENTITY_ALIASES.items() for x in pair])
    v = F.coalesce(F.try_element_at(aliases, v), v)
    return F.when(v.isin(ENTITY_TYPES), v).otherwise("organization")


def question_status(operational: Column, evidence: Column, unmappable: Column) -> Column:
    """Terminal status from what a question's legs met: failures first, then evidence."""
    return F.when(operational, "deferred").when(evidence, "answered").when(unmappable, "unmappable").otherwise("no_evidence")


def scholarly_outcome(fetch_failed: Column, deferred: Column, findings: Column) -> Column:
    return F.when(fetch_failed | ((deferred > 0) & (findings == 0)), "operational").when(findings > 0, "evidence").otherwise("empty")


def post_format(measurements: Column, findings: Column, comparator_only: Column) -> Column:
    return F.when(measurements >= 2, "data_spotlight").when(findings >= 3, "listicle").when(comparator_only, "myth_fact").when(findings == 1, "qa").otherwise("narrative")


def vintage(period: Column, this_year: int) -> Column:
    year = F.substring(period, 1, 4).try_cast("int")
    return F.when(year.isNull(), "unknown").when(year >= this_year, "projection").when(year == this_year - 1, "recent").otherwise("historical")


def change_kind(kind: Column, previous: Column, value: Column) -> Column:
    """changed or noise: levels and counts must move by over one percent, others by their floor."""
    delta = F.abs(value - previous)
    kind = F.coalesce(kind, F.lit("level"))
    floor = F.coalesce(*[F.when(kind == k, F.lit(v)) for k, v in NOISE_FLOOR.items()], F.lit(0.0))
    meaningful = F.when(kind.isin("level", "count"), delta > F.abs(previous) * 0.01).otherwise(delta >= floor)
    return F.when(meaningful, "changed").otherwise("noise")


def direction(previous: Column, value: Column) -> Column:
    return F.when(value == previous, "unchanged").when(value > previous, "up").otherwise("down")


def verdict(direction_: Column, polarity: Column) -> Column:
    polarity = F.coalesce(polarity, F.lit("neutral"))
    good = ((direction_ == "up") & (polarity == "good")) | ((direction_ == "down") & (polarity == "bad"))
    return F.when((direction_ == "unchanged") | (polarity == "neutral"), "neutral").when(good, "improved").otherwise("worsened")


def families(words: Column) -> Column:
    """Indexes of the synonym families that any of the words is in."""
    return _named_index([F.arrays_overlap(words, F.array(*[F.lit(w) for w in f])) for f in FAMILIES])


def _named_index(hits: list[Column]) -> Column:
    return F.array_compact(F.array(*[F.when(h, F.lit(k)) for k, h in enumerate(hits)]))


def not_projection(status: Column) -> Column:
    return status.isNull() | (status != "projection")


def not_rejected(quality: Column) -> Column:
    return ~quality.eqNullSafe(F.lit("rejected"))


def forecast_score(outcome: Column) -> Column:
    """A hit counts one, a partial one a half, anything else nothing; null while unresolved."""
    return F.when(outcome == "hit", 1.0).when(outcome == "partial", 0.5).when(outcome.isNotNull(), 0.0)
