"""Intake and retrieval rules: query phrases, story hunts, promotion, eligible events, label mentions, stats and forecasts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions.text import ASCII_DIGITS, PERSIAN_DIGITS
from gleaner.operators import automaton
from gleaner.operators.common import top_k

# Fixed values -----------------------------------------------------------------------------------------------------
QUERY_STOP = "the a an and or of in on to for with is are was were be by at as that this from into what which how who their its our specific total precise ongoing systematic between affect affects effect effects".split()
LEADS = ["what specific ", "what ", "how ", "which ", "who ", "why ", "when ", "where ", "does ", "do ", "did ", "is ", "are ", "can ", "could ", "would ", "will "]
STAT_UNITS = ["میلیارد", "میلیون", "هزار", "درصد", "تُن", "متر", "نفر", "دلار", "تن", "ریال", "تومان", "بشکه"]
NUMBER_WORDS = {
    "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9", "ten": "10", "eleven": "11", "twelve": "12", "dozen": "12",
    "twenty": "20", "thirty": "30", "forty": "40", "fifty": "50", "sixty": "60", "seventy": "70", "eighty": "80", "ninety": "90", "hundred": "100",
}
MAGNITUDES = {"thousand": 10**3, "million": 10**6, "billion": 10**9, "trillion": 10**12}
# ------------------------------------------------------------------------------------------------------------------


def query_words(question: Column) -> Column:
    """A question's topic words: leading interrogatives off, words of over three letters that aren't stop words, each once."""
    low = F.regexp_replace(F.lower(F.coalesce(question, F.lit(""))), r"\?", " ")
    plain = F.regexp_replace(low, "^(?:" + "|".join(LEADS) + ")+", "")
    words = F.transform(F.split(F.regexp_replace(plain, ",", " "), r"\s+"), lambda w: F.regexp_replace(w, r"^[^\w]+|[^\w]+$", ""))
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) > 3) & ~w.isin(QUERY_STOP)))


def query_phrases(questions: DataFrame, problems: DataFrame, most: int = 140) -> DataFrame:
    """(problem_id, query): words of the questions in order until six are found, else those of the statement; questions with under four Latin letters don't count."""
    usable = questions.filter(F.length(F.regexp_replace("question", "[^a-zA-Z]", "")) >= 4)
    one = usable.select("problem_id", F.struct("asked", "question_id", query_words(F.col("question")).alias("w")).alias("q"))
    listed = one.groupBy("problem_id").agg(F.array_sort(F.collect_list("q")).alias("qs"))
    grown = F.aggregate("qs", F.array().cast("array<string>"), lambda a, q: F.when(F.size(a) >= 6, a).otherwise(F.array_union(a, q["w"])))
    joined = problems.select("problem_id", "statement").join(listed.select("problem_id", grown.alias("w")), "problem_id", "left")
    words = F.when(F.size(F.coalesce("w", F.array().cast("array<string>"))) > 0, F.col("w")).otherwise(query_words(F.col("statement")))
    return joined.select("problem_id", F.substring(F.array_join(words, " "), 1, most).alias("query"))


def story_hunt(articles: DataFrame, group: str, title: str, preferred: str, at: str, k: int = 5) -> DataFrame:
    """The k best stories of each group: one per first eight words of the title, preferred outlets first, then the newest, undated last."""
    stem = F.array_join(F.slice(F.filter(F.split(F.lower(title), r"\s+"), lambda w: w != ""), 1, 8), " ")
    once = top_k(articles.withColumn("__stem", stem), [group, "__stem"], [F.asc("id")], 1).drop("__stem")
    return top_k(once, [group], [F.desc(preferred), F.desc_nulls_last(at), F.asc("id")], k, "place")


def promotable(problems: DataFrame, counts: DataFrame, relevant: str) -> DataFrame:
    """Candidates that are relevant and have questions or evidence: ready if any evidence is linked."""
    p = problems.filter((F.col("status") == "candidate") & (F.col(relevant) == "yes")).join(counts, "problem_id", "left").na.fill(0, ["questions", "evidence"])
    return p.filter("questions > 0 OR evidence > 0").select("problem_id", F.when(F.col("evidence") > 0, "ready").otherwise("candidate").alias("status"))


def eligible_events(artifacts: DataFrame, linked: DataFrame, verdicts: DataFrame | None = None) -> DataFrame:
    """Extracted artifacts that no event refers to; a missing verdict counts as eligible. The event's summary is the text's head."""
    free = artifacts.filter("status = 'extracted'").join(linked.select("artifact_id"), "artifact_id", "left_anti")
    if verdicts is not None:
        free = free.join(verdicts, "artifact_id", "left").filter(F.coalesce("eligible", F.lit(True)))
    head = F.when(F.length("content") > 300, F.concat(F.substring("content", 1, 300), F.lit("..."))).otherwise(F.col("content"))
    return free.select("artifact_id", head.alias("summary"), F.lit(0.8).alias("confidence"))


def mentions(posts: DataFrame, labels: DataFrame, key: str, text: str, label: str, near: int = 40) -> DataFrame:
    """(key, label, figured): labels of four characters or more found in a text, whole or else without their bracket; figured if a digit stands near."""
    whole = F.trim(label)
    base = F.trim(F.regexp_replace(label, r"\s*\([^)]*\)\s*", ""))
    ways = F.array(F.struct(whole.alias("pattern"), F.lit(0).alias("rank")), F.struct(base.alias("pattern"), F.lit(1).alias("rank")))
    patterns = labels.select(whole.alias("name"), F.explode(ways).alias("w")).select("w.pattern", "name", "w.rank").filter(F.length("pattern") >= 4)
    return automaton.found(posts, patterns, key, text, near).select(key, F.col("name").alias("label"), F.col("near").rlike("[0-9۰-۹]").alias("figured"))


def stats(sentence: Column) -> Column:
    """Measurable quantities of a sentence as structs (raw, unit, value, score): bare years and zeros aren't stats."""
    pattern = r"([0-9۰-۹]+(?:[,٬_][0-9۰-۹]{3})*(?:[٫.][0-9۰-۹]+)?)\s*(" + "|".join(STAT_UNITS) + r")?(?=[\s،؛.)]|$)"
    raws, units = (F.regexp_extract_all(sentence, F.lit(pattern), F.lit(n)) for n in (1, 2))

    def one(raw: Column, unit: Column) -> Column:
        value = F.regexp_replace(F.replace(F.translate(raw, PERSIAN_DIGITS, ASCII_DIGITS), F.lit("٫"), F.lit(".")), "[,٬_]", "").try_cast("double")
        bonus = F.when(unit == "درصد", 4).when(unit.isin("میلیون", "میلیارد", "هزار"), 3).when(unit != "", 1).otherwise(0)
        return F.struct(raw.alias("raw"), unit.alias("unit"), value.alias("value"), (F.least(F.length(raw), F.lit(6)) + bonus).alias("score"))

    def kept(s: Column) -> Column:
        year = (s["unit"] == "") & (F.length(s["raw"]) == 4) & s["value"].between(1300, 2100)
        return s["value"].isNotNull() & (s["value"] != 0) & ~year

    return F.filter(F.zip_with(raws, units, one), kept)


def spelled_numbers(text: Column) -> Column:
    """Number words as digits, and a number before a magnitude word as their product."""
    out = reduce(lambda t, w: F.regexp_replace(t, rf"(?i)(?<![A-Za-z]){w[0]}(?![A-Za-z])", w[1]), NUMBER_WORDS.items(), text)
    pieces = F.split(F.regexp_replace(out, r"(?i)([0-9]+(?:\.[0-9]+)?)\s+(thousand|million|billion|trillion)\b", "\u0001$1\u0002$2\u0001"), "\u0001")

    def product(piece: Column) -> Column:
        number = F.substring_index(piece, "\u0002", 1).try_cast("decimal(20,6)")
        word = F.lower(F.substring_index(piece, "\u0002", -1))
        size = reduce(lambda c, m: F.when(word == m[0], F.lit(m[1])).otherwise(c), MAGNITUDES.items(), F.lit(None).cast("long"))
        shown = F.regexp_replace(F.regexp_replace((number * size.cast("decimal(14,0)")).cast("string"), r"0+$", ""), r"\.$", "")
        return F.when(piece.contains("\u0002"), shown).otherwise(piece)

    return F.array_join(F.transform(pieces, product), "")


def forecast_series(measurements: DataFrame, keys: list[str], least: int = 4, last: int = 6) -> DataFrame:
    """Per first key: the longest series with enough points among its last ones, as a forecast's base."""
    recent = top_k(measurements, keys, [F.desc("period")], last)
    sizes = recent.groupBy(*keys).agg(F.count("*").alias("points"), F.max_by("value", "period").alias("last_value")).filter(F.col("points") >= least)
    whole = measurements.groupBy(*keys).agg(F.count("*").alias("length"))
    return top_k(sizes.join(whole, keys), [keys[0]], [F.desc("length"), *[F.asc(k) for k in keys[1:]]], 1)


def clamped_probability(p: Column) -> Column:
    return F.least(F.greatest(F.coalesce(p, F.lit(0.5)), F.lit(0.5)), F.lit(0.95))


def merge_entities(existing: DataFrame, new: DataFrame) -> DataFrame:
    """existing(entity_id, entity_name, aliases) with new(name, aliases): a name that equals a name or alias adds its aliases there, others become entities without an id."""
    from gleaner.operators.evidence import resolve_aliases

    found = new.join(resolve_aliases(new, existing), "name")
    more = found.filter("entity_id IS NOT NULL").groupBy("entity_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.array_append(F.coalesce("aliases", F.array().cast("array<string>")), F.col("name")))))).alias("more"))
    own = F.coalesce("aliases", F.array().cast("array<string>"))
    merged = existing.join(more, "entity_id", "left").select("entity_id", "entity_name", F.filter(F.array_union(own, F.coalesce("more", F.array().cast("array<string>"))), lambda a: a != F.col("entity_name")).alias("aliases"))
    fresh = found.filter("entity_id IS NULL").groupBy(F.trim("name").alias("entity_name")).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce("aliases", F.array().cast("array<string>")))))).alias("aliases"))
    return merged.unionByName(fresh.select(F.lit(None).cast("long").alias("entity_id"), "entity_name", "aliases"))
