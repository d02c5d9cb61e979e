"""Gates over drafted posts and the choices around them. Lists are fixed values."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions import persian
from gleaner.functions.text import ascii_digits, bound
from gleaner.operators.common import top_k
from gleaner.operators.intake import stats
from gleaner.operators.verify import verified

# Fixed values -----------------------------------------------------------------------------------------------------
REQUIRED_SECTIONS = ["What the evidence says", "How it could be addressed", "What we don't yet know"]
MIN_WORDS, MAX_WORDS = 40, 600
CITATION_CLIFF = 150_000
STUDY_TERMS = [
    "hous", "urban", "vacan", "city", "cities", "rent", "resident", "real estate", "property", "mortgage", "construction", "dwelling", "land", "water", "drought", "irrigat", "groundwater", "aquifer", "soil",
    "energy", "electric", "power", "fuel", "gas", "renewab", "greenhouse", "cultivat", "photosynth", "yield", "harvest", "employ", "unemploy", "labor", "labour", "job", "wage", "workforce", "women", "gender", "female", "fertil", "marriage", "family",
    "population", "demograph", "migrat", "youth", "refugee", "agricultur", "farm", "crop", "wheat", "pistachio", "food", "export", "import", "trade", "tariff", "sanction", "inflation", "price", "market",
    "cooperativ", "welfare", "poverty", "inequality", "credit", "econom", "security", "conflict", "military", "nato", "defence", "defense", "iran", "middle east", "developing", "emerging", "china", "settlement", "infrastructur", "spatial", "planning", "climate",
]
FORECAST_LABELS = ["پیش‌بینی", "پیش بینی", "برآورد", "پروژکشن", "forecast", "projection"]
RISING = ["افزایش", "رو به رشد", "جهش", "بالاتر رفت"]
FALLING = ["کاهش", "نزولی", "سقوط", "پایین آمد"]
REPORTED = ["بر پایه گزارش", "بر اساس گزارش", "بر اساس همین گزارش"]
FALLS = ["افت", "کاهش", "سقوط"]
GROWS = ["رشد", "افزایش", "جهش"]
HOOKS = ["مقایسه", "صحنه", "عدد غافلگیرکننده", "پرسش ساده", "تاریخ", "تضاد ساختاری"]
HOOK_MARKS = {"پرسش ساده": ["چرا", "؟"], "تاریخ": ["دهه", "سال ۱"], "عدد غافلگیرکننده": ["درصد"]}
FRAMING_TELLS = ["روزهایی که", "این روزها", "تیتر یک", "رسانه‌ها", "خبرها", "اخبار", "در شرایطی که", "چرا با وجود"]
CAUSAL_STEPS = ["منجر به", "به دلیل", "در نتیجه", "زنجیره", "اثر گذاشته", "فشار می‌آورد", "می‌انجامد", "به بحران"]
PRESCRIPTIONS = ["باید", "لازم است", "ضروری است", "پیشنهاد می‌شود", "توصیه می‌شود", "می‌بایست"]
CAUSAL_VERBS = ["اثر می‌گذارد", "تأثیر می‌گذارد", "تاثیر می‌گذارد", "منجر می‌شود", "منجر به", "باعث", "موجب", "محدود می‌کند", "کاهش می‌دهد", "افزایش می‌دهد", "مانع", "سد راه", "گره خورده", "دامن می‌زند"]
EXPLANATIONS = ["چون", "زیرا", "به این دلیل", "از این راه", "یعنی", "چرا که", "به دلیل", "در نتیجه", "بنابراین", "از آنجا که", "سازوکار", "به عبارت دیگر", "که این", "وقتی", "هنگامی"]
# ------------------------------------------------------------------------------------------------------------------


def occurring(text: Column, terms: list[str]) -> Column:
    return sum((text.contains(t).cast("int") for t in terms), F.lit(0))


def occurrences(text: Column, terms: list[str]) -> Column:
    return sum(((F.length(text) - F.length(F.replace(text, F.lit(t), F.lit("")))) / len(t) for t in terms), F.lit(0.0)).cast("int")


def gate(markdown: Column, confidence: Column) -> Column:
    """struct(decision, accuracy_ok, engagement): HOLD without evidence, with overclaims or without gaps; else PASS from 0.7."""
    cited = F.regexp_count(markdown, F.lit(r"\[(measurement|finding):[0-9]+\]"))
    bare = (cited == 0) & ~markdown.contains("Evidence pending")
    overclaims = (confidence == "indicative") & markdown.rlike(r"(?i)\b(solved|resolved|will fix|guaranteed)\b")
    accurate = ~bare & ~overclaims & markdown.contains("## 🔍 What we don't yet know")
    n = F.size(F.filter(F.split(markdown, r"\s+"), lambda w: w != ""))
    tenth = lambda c: F.when(c, 0.1).otherwise(0.0)
    diagram = markdown.contains("```") & (markdown.contains("PROBLEM:") | markdown.contains("flowchart"))
    sections = reduce(lambda a, b: a & b, [markdown.contains(s) for s in REQUIRED_SECTIONS])
    score = F.least(F.lit(0.4), 0.08 * cited) + F.when(confidence == "grounded", 0.2).otherwise(0.0) + tenth(n.between(MIN_WORDS, MAX_WORDS)) + tenth(F.substring(markdown, 1, 200).contains("Iran")) + tenth(diagram) + tenth(sections)
    engagement = F.round(score, 2)
    return F.struct(F.when(~accurate, "HOLD").when(engagement >= 0.7, "PASS").otherwise("REVISE").alias("decision"), accurate.alias("accuracy_ok"), engagement.alias("engagement"))


def case(analyses: Column, has_news: Column, has_data: Column) -> Column:
    """News alone makes no case: without an analysis it takes data, whether there is news or not."""
    return F.when(analyses > 0, "analysis").when(has_data, "own_forecast").otherwise("discard")


def study_audit(title: Column, cited_by: Column, abstract: Column | None = None, concepts: Column | None = None) -> Column:
    """Over-cited, or off the domain's terms in title, abstract and concepts (an array) together, or ok."""
    more = [abstract] if abstract is not None else []
    more += [F.array_join(concepts, " ")] if concepts is not None else []
    named = bound(F.lower(F.concat_ws(" ", title, *more)), lambda low: reduce(lambda a, b: a | b, [low.contains(t) for t in STUDY_TERMS]))
    return F.when(F.coalesce(cited_by, F.lit(0)) > CITATION_CLIFF, "over_cited").when(~named, "off_domain").otherwise("ok")


def hook(problem_id: Column, recent_openings: Column) -> Column:
    """The first strategy from the problem's own place on whose marks the recent openings don't hold three times; its own if all are."""
    free = F.array(*[occurrences(recent_openings, HOOK_MARKS[h]) < 3 if h in HOOK_MARKS else F.lit(True) for h in HOOKS])
    at = lambda i: F.pmod(problem_id + i, F.lit(len(HOOKS))).cast("int")
    order = F.filter(F.transform(F.sequence(F.lit(0), F.lit(len(HOOKS) - 1)), lambda i: at(i)), lambda k: F.get(free, k))
    return F.get(F.array(*[F.lit(h) for h in HOOKS]), F.coalesce(F.get(order, F.lit(0)), at(F.lit(0))))


def framing(text: Column) -> Column:
    return occurring(F.substring(F.coalesce(text, F.lit("")), 1, 260), FRAMING_TELLS)


def future_years(text: Column, this_year: int) -> Column:
    """Years after this one that a text names, each once, sorted."""
    years = F.transform(F.regexp_extract_all(text, F.lit(r"\b(1[89][0-9]{2}|20[0-9]{2})\b"), F.lit(1)), lambda y: y.cast("int"))
    return F.array_sort(F.array_distinct(F.filter(years, lambda y: y > this_year)))


def bounded_ledger(entries: DataFrame, keys: list[str], order: list[str], keep: int = 12) -> DataFrame:
    """The newest entries of each key."""
    w = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    return entries.withColumn("__n", F.row_number().over(w)).filter(F.col("__n") <= keep).drop("__n")


def best_attempts(attempts: DataFrame, key: str, attempt: str) -> DataFrame:
    """Of each key's attempts that passed the gates, the one with the fewest fabrications, then language errors, then the first."""
    rest = [c for c in attempts.columns if c not in (key, "passed")]
    best = attempts.filter("passed").groupBy(key).agg(F.min_by(F.struct(*rest), F.struct("fabrications", "errors", attempt)).alias("b"))
    return best.select(key, "b.*")


def route_state(calls: DataFrame, route: str, at: str, ok: str, base: int = 1800, most: int = 43200) -> DataFrame:
    """Per route: failures since its last success, and until when it is quarantined (from the second failure on, doubling)."""
    last_ok = calls.filter(F.col(ok)).groupBy(route).agg(F.max(at).alias("last_ok"))
    joined = calls.join(last_ok, route, "left")
    fails = joined.filter(~F.col(ok) & (F.col("last_ok").isNull() | (F.col(at) > F.col("last_ok")))).groupBy(route).agg(F.count("*").alias("fails"), F.max(at).alias("last_fail"))
    out = calls.select(route).distinct().join(fails, route, "left").withColumn("fails", F.coalesce("fails", F.lit(0)))
    wait = F.least(F.lit(base) * F.pow(F.lit(2.0), F.least(F.col("fails") - 2, F.lit(20))), F.lit(most)).cast("int")
    return out.select(route, "fails", F.when(F.col("fails") >= 2, F.col("last_fail") + F.make_dt_interval(secs=wait)).alias("disabled_until"))


def unlabelled_years(text: Column, this_year: int, around: int = 70) -> Column:
    """Future years at whose first mention no word for a forecast stands within so many characters."""
    plain = ascii_digits(text)

    def window(y: Column) -> Column:
        at = F.instr(plain, y.cast("string"))
        return F.substring(plain, F.greatest(at - around, F.lit(1)), F.least(F.lit(2 * around), F.lit(around) + at - 1))

    return F.filter(future_years(plain, this_year), lambda y: occurring(window(y), FORECAST_LABELS) == 0)


def trend_contradiction(text: Column, direction: Column, figures: Column, around: int = 200) -> Column:
    """Whether a text that names one of a series' decimals speaks of the opposite direction near it: at the first mention of an opposite word."""
    shared = F.filter(figures, lambda n: text.contains(n))

    def near(word: str) -> Column:
        at = F.instr(text, word)
        window = F.substring(text, F.greatest(at - around, F.lit(1)), F.least(F.lit(2 * around), F.lit(around) + at - 1))
        return (at > 0) & F.exists(shared, lambda n: window.contains(n))

    def some(words: list[str]) -> Column:
        return reduce(lambda a, b: a | b, [near(w) for w in words])

    return F.coalesce(F.when(direction == "increasing", some(FALLING)).when(direction == "decreasing", some(RISING)), F.lit(False))


def valid_insight(claim: Column, numbers_ok: Column, most: int = 320) -> Column:
    return (F.length(claim) <= most) & numbers_ok


def valid_insights(insights: DataFrame, dossiers: DataFrame, key: str, claim: str, dossier: str, most: int = 320) -> DataFrame:
    """(key, valid): short enough, and every figure of the claim is in the dossier's text or matches one there. Without a dossier no figure is backed."""
    given = insights.select(key).distinct().join(dossiers.select(key, dossier), key, "left").select(key, F.coalesce(dossier, F.lit("")).alias(dossier))
    checked = verified(insights.select(key, claim), given, key, claim, dossier).select(key, "ok")
    return insights.select(key, claim).join(checked, key).select(key, valid_insight(F.col(claim), F.col("ok"), most).alias("valid"))


def sanity(posts: DataFrame, facts: DataFrame, key: str, post: str, this_year: int) -> DataFrame:
    """(key, ok, violations): years still to come (future:y), those of them without a word for a forecast near (unlabelled:y), and contradicted trends (trend:direction), sorted.

    facts: key, direction, figures, one row for each series of the post's dossier; all of them are held against the post.
    """
    text = F.col(post)
    tell = lambda what, years: F.transform(years, lambda y: F.concat(F.lit(f"{what}:"), y.cast("string")))
    dated = posts.select(key, F.concat(tell("future", future_years(ascii_digits(text), this_year)), tell("unlabelled", unlabelled_years(text, this_year))).alias("__years"))
    against = facts.filter(F.col("direction").isin("increasing", "decreasing")).join(posts.select(key, post), key)
    trends = against.filter(trend_contradiction(text, F.col("direction"), F.col("figures"))).groupBy(key).agg(F.collect_set(F.concat(F.lit("trend:"), "direction")).alias("__trends"))
    found = dated.join(trends, key, "left").withColumn("violations", F.array_sort(F.concat("__years", F.coalesce("__trends", F.array().cast("array<string>")))))
    return found.select(key, (F.size("violations") == 0).alias("ok"), "violations")


def licensed(topics: Column, terms: dict[str, list[str]], angle: Column) -> Column:
    """Whether a series may be charted: one of its topics has a term in the angle; an unregistered series (null topics) may."""
    low = F.lower(F.coalesce(angle, F.lit("")))
    own = F.transform(F.split(topics, ","), lambda t: F.trim(t))
    hit = reduce(lambda a, b: a | b, [F.array_contains(own, t) & (occurring(low, words) > 0) for t, words in terms.items()])
    return F.coalesce(hit, F.lit(True))


def series_spans(points: DataFrame, keys: list[str], tail: int = 36, least: int = 8) -> DataFrame:
    """(keys, indicator, n, span) of each group's series of (indicator, year, value), cut to their last points: the relative span from first to last."""
    last = points.withColumn("__n", F.row_number().over(Window.partitionBy(*keys, "indicator").orderBy(F.desc("year")))).filter(F.col("__n") <= tail)
    ends = last.groupBy(*keys, "indicator").agg(F.count("*").alias("n"), F.min_by("value", "year").alias("a"), F.max_by("value", "year").alias("b"))
    wide = ends.filter((F.col("n") >= least) & (F.col("a") != F.col("b")))
    return wide.select(*keys, "indicator", "n", F.round(F.abs(F.col("b") - F.col("a")) / F.greatest(F.abs("a"), F.lit(1e-9)), 6).alias("span"))


def chart_series(points: DataFrame, keys: list[str], tail: int = 36, least: int = 8, most: int = 3) -> DataFrame:
    """(keys, indicator, n, span, place): the widest series of each group by relative span."""
    ends = series_spans(points, keys, tail, least)
    return top_k(ends, keys, [F.desc("span"), F.asc("indicator")], most, "place").select(*keys, "indicator", "n", "span", "place")


def licensed_series(spans: DataFrame, angles: DataFrame, registry: DataFrame, group: str, key: str, angle: str, terms: dict[str, list[str]], most: int = 3) -> DataFrame:
    """(key, indicator, n, span, place): the widest series of the key's group that its angle licenses; series off the subject go first, then the widest are picked.

    Angles repeat, so each distinct one is held against each indicator of its group once.
    """
    series = spans.join(registry.select("indicator", "topics"), "indicator", "left")
    asked = angles.select(group, angle).distinct().join(series, group).filter(licensed(F.col("topics"), terms, F.col(angle)))
    best = top_k(asked, [group, angle], [F.desc("span"), F.asc("indicator")], most, "place")
    return angles.select(key, group, angle).distinct().join(best, [group, angle]).select(key, "indicator", "n", "span", "place")


def card_layout(sentences: DataFrame, key: str) -> DataFrame:
    """(key, pos, layout): the sentence a card is built from, and how.

    sentences: key, pos, sentence, strength (sum of its three best figures' scores), units (of these), overlap (words and topics shared with the
    angle), has_angle. Reported ones get two more, each shared word four. Misaligned, reported and all other ones give no_stat, a contrast takes two units and
    words of both directions.
    """
    text = F.col("sentence")
    score = F.col("strength") + F.when(occurring(text, REPORTED) > 0, 2).otherwise(0) + 4 * F.col("overlap")
    misaligned = F.col("has_angle") & (F.col("overlap") == 0)
    both = (occurring(text, FALLS) > 0) & (occurring(text, GROWS) > 0)
    layout = F.when(misaligned | (occurring(text, REPORTED[:2]) > 0), "no_stat").when(both & (F.size(F.array_distinct("units")) >= 2), "contrast").otherwise("no_stat")
    # the layout travels instead of the sentence, and one row of a key at a time is kept
    told = sentences.select(key, F.struct(score.isNull().alias("none"), (-score).alias("score"), "pos", layout.alias("layout")).alias("__x"))
    return told.groupBy(key).agg(F.min("__x").alias("__x")).select(key, "__x.pos", "__x.layout")


def card_layouts_of(posts: DataFrame, key: str, post: str, angle: str, topics: dict[str, list[str]]) -> DataFrame:
    """(key, pos, sentence, layout) for each post with a sentence that has figures, all from the post and its angle.

    A sentence's strength is the sum of its first three figures' scores, units are theirs; it overlaps with the angle in content words and in topics.
    """
    marks = r"(?:(?<![0-9۰-۹])\.|\.(?![0-9۰-۹])|[\n؟!])\s+"
    long = F.filter(F.transform(F.split(F.coalesce(post, F.lit("")), marks), lambda x: F.trim(x)), lambda x: F.length(x) > 25)
    s = posts.select(key, F.coalesce(angle, F.lit("")).alias("__angle"), F.posexplode(long).alias("pos", "sentence")).withColumn("__stats", stats(F.col("sentence"))).filter(F.size("__stats") > 0)
    first = F.slice("__stats", 1, 3)
    shared = lambda f: F.size(F.array_intersect(f(F.col("sentence")), f(F.col("__angle"))))
    about = lambda c: persian.topic_keys(c, topics)
    scored = s.select(
        key, "pos", "sentence", F.aggregate(first, F.lit(0), lambda a, x: a + x["score"]).alias("strength"), F.transform(first, lambda x: x["unit"]).alias("units"),
        (shared(persian.content_words) + shared(about)).alias("overlap"), (F.size(F.concat(persian.content_words(F.col("__angle")), about(F.col("__angle")))) > 0).alias("has_angle"),
    )
    return card_layout(scored, key).join(scored.select(key, "pos", "sentence"), [key, "pos"])


def mechanism_steps(text: Column) -> Column:
    """How many causal connectives a post names; two or more make a mechanism."""
    return occurring(text, CAUSAL_STEPS)


def without_lever(sentences: DataFrame, key: str, sentence: str, levers: DataFrame) -> DataFrame:
    """(key, pos): prescriptive sentences that name none of the key's levers."""
    own = levers.groupBy(key).agg(F.collect_set(F.lower("lever")).alias("__levers"))
    low = F.lower(F.col(sentence))
    named = F.coalesce(F.exists("__levers", lambda x: low.contains(x)), F.lit(False))
    return sentences.filter(occurrences(F.col(sentence), PRESCRIPTIONS) > 0).join(own, key, "left").filter(~named).select(key, "pos")


def solution_analysis(findings: DataFrame, key: str) -> DataFrame:
    """(key, findings, grounded, levers, confidence): distinct interventions in order; grounded if half of the findings have an effect, indicative if none has."""
    levers = F.array_join(F.array_sort(F.collect_set("intervention")), ", ")
    g = findings.groupBy(key).agg(F.count("*").alias("findings"), F.count("effect_size").alias("grounded"), levers.alias("levers"))
    return g.withColumn("confidence", F.when(F.col("grounded") == 0, "indicative").when(F.col("grounded") * 2 >= F.col("findings"), "grounded").otherwise("mixed"))
