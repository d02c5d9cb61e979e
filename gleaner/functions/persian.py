"""Persian orthography and text repairs.

Plain replacements are columns. Repairs whose rule looks at a match, or at what came before it in the text, are pandas functions.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from gleaner.functions.text import ASCII_DIGITS

# Fixed values -------------------------------------------------------------------------------------------------------
ZWNJ = "‌"
DIGITS = "۰۱۲۳۴۵۶۷۸۹"
PUNCTUATION = "،؛.!؟:"
MAGNITUDES = [(1e9, "میلیارد"), (1e6, "میلیون")]
CONJUNCTIONS = ["و", "اما", "ولی", "که", "زیرا", "چون"]
STOP_WORDS = ["این", "است", "برای", "که", "های", "شده", "خود", "آن", "بود", "یک", "شود", "کرد", "بین"]
# --------------------------------------------------------------------------------------------------------------------


def persian_digits(text: Column) -> Column:
    """ASCII digits as Persian ones."""
    return F.translate(text, "0123456789", DIGITS)


def normalised(text: Column) -> Column:
    """Arabic letters unified, prefixes and suffixes joined by ZWNJ, digits Persian, punctuation and blanks tidied."""
    out = F.translate(text, "يك", "یک")
    out = F.regexp_replace(out, r"(^|[\s(«])(ن?می) +(?=[؀-ۿ])", "$1$2" + ZWNJ)
    out = F.regexp_replace(out, r"(?<=[؀-ۿ]) +(ها|های|هایی|تر|ترین)(?=[\s،؛.!؟:)]|$)", ZWNJ + "$1")
    out = F.regexp_replace(out, r"(?<=[0-9۰-۹])\.(?=[0-9۰-۹])", "٫")
    out = persian_digits(out)
    out = F.regexp_replace(out, r" +([،؛.!؟:])", "$1")
    out = F.regexp_replace(out, r"([،؛!؟])\1+", "$1")
    return F.trim(F.regexp_replace(out, r"[ \t]{2,}", " "))


def join_detached_yeh(text: Column) -> Column:
    """A separated ye after a silent he joins its word."""
    return F.regexp_replace(text, r"(?<=ه)\s+ی(?=[\s،؛.!؟]|$)", ZWNJ + "ی")


def issues(text: Column) -> Column:
    """How many spots the normalisation would mend: detached prefixes, blanks before punctuation, doubled signs, ASCII digits."""
    patterns = [r"(?:^|\s)ن?می [؀-ۿ]", r" [،؛.!؟:]", r"([،؛!؟])\1", r"[0-9]"]
    return sum((F.regexp_count(text, F.lit(p)) for p in patterns), F.lit(0))


def strip_scaffold(text: Column) -> Column:
    """Leading labels such as a heading mark or 'text:' taken off."""
    return F.regexp_replace(text, r"^\s*(?:#+\s*|\*+\s*|(?:متن|پیش‌نویس|خروجی|draft|post)\s*[:：]\s*)+", "")


def number(text: str) -> float | None:
    """The value of a Persian or ASCII numeral with either script's separators; None if it isn't one."""
    plain = text.translate(str.maketrans("۰۱۲۳۴۵۶۷۸۹٠١٢٣٤٥٦٧٨٩٫", ASCII_DIGITS + "."))
    plain = re.sub("[,٬_]", "", plain)
    try:
        return float(plain)
    except ValueError:
        return None


def _shown(value: float) -> str:
    text = f"{value:.1f}".rstrip("0").rstrip(".")
    return text.translate(str.maketrans("0123456789.", DIGITS + "٫"))


@F.pandas_udf(StringType())
def round_big_numbers(texts: pd.Series) -> pd.Series:
    """Numerals of a million up, in full, as a rounded number and its magnitude."""

    def shorter(m: re.Match) -> str:
        value = number(m[0])
        for size, name in MAGNITUDES:
            if value is not None and value >= size:
                return f"{_shown(value / size)} {name}"
        return m[0]

    pattern = re.compile(r"[0-9۰-۹]{1,3}(?:[,٬][0-9۰-۹]{3}){2,}|[0-9۰-۹]{7,}")
    return texts.map(lambda t: None if t is None else pattern.sub(shorter, t))


@F.pandas_udf(StringType())
def dedupe_provider_parens(texts: pd.Series) -> pd.Series:
    """A source named in brackets is kept where it comes first and dropped where a sentence repeats the one before it."""
    pattern = re.compile(r"\s*\((?:منبع:?\s*)?([^()]{2,40})\)")

    def once(text: str | None) -> str | None:
        if text is None:
            return None
        last: list[str] = []

        def keep(m: re.Match) -> str:
            name = " ".join(m[1].split())
            if last and last[0] == name:
                return ""
            last[:] = [name]
            return m[0]

        return pattern.sub(keep, text)

    return texts.map(once)


def _split_long(sentence: str, limit: int, least: int) -> list[str]:
    words = sentence.split()
    if len(words) <= limit:
        return [sentence]
    middle = len(words) / 2
    joints = [i for i, w in enumerate(words) if least <= i <= len(words) - least and (w in CONJUNCTIONS or words[i - 1].endswith(("،", "؛")))]
    if not joints:
        return [sentence]
    at = min(joints, key=lambda i: abs(i - middle))
    head, rest = words[:at], words[at + (words[at] in ("و",)) :]
    return [*_split_long(" ".join(head).rstrip("،؛") + ".", limit, least), *_split_long(" ".join(rest), limit, least)]


@F.pandas_udf(StringType())
def split_runons(texts: pd.Series) -> pd.Series:
    """Sentences of over 35 words are cut at the joint nearest their middle that leaves eight words on either side."""

    def mended(text: str | None) -> str | None:
        if text is None:
            return None
        parts = re.split(r"(?<=[.!؟])\s+", text)
        return " ".join(piece for p in parts for piece in _split_long(p, 35, 8))

    return texts.map(mended)


def content_words(text: Column) -> Column:
    """Distinct Persian words of three letters or more, without the commonest function words."""
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(r"[؀-ۿ]{3,}"), F.lit(0)))
    return F.array_except(found, F.array(*[F.lit(w) for w in STOP_WORDS]))


# Attribution and definitions ------------------------------------------------------------------------------------------

# Provider phrases in the order in which they are looked for, placeholder brackets, and unit words.
PROVIDER_PHRASES = [
    "بانک جهانی", "یاهو فایننس", "Yahoo", "صندوق بین‌المللی پول", "مرکز آمار", "بانک مرکزی", "EIA", "داده‌های بازار جهانی", "آمارهای رسمی", "بازار جهانی",
    "نهادهای معتبر بین‌المللی", "نهادهای بین‌المللی", "منابع معتبر", "منابع رسمی", "ارائه‌دهنده", "ارائه دهنده", "ارائهدهنده",
]
PLACEHOLDER = r"\[\s*(?:بنا بر\s+)?منبع\s*[:.٫]?\s*[A-Za-zXY۰-۹]?\s*\]|\[\.\.\.\]|…{2,}"
UNIT_WORDS = "میلیارد|میلیون|هزار|دلار|درصد|بشکه|تومان|ریال|یورو|سنت"
DIGIT = "[۰-۹0-9]"
NAME_LABELS = ["نام", "فارسی", "انگلیسی"]
# How a source (as it stands) and a unit (in lower case) are told and what they are called: contains, starts with or is, in the order in which they are tried.
PROVIDER_NAMES = [
    ("contains", "World Bank", "بانک جهانی"), ("is", "WDI", "بانک جهانی"), ("contains", "Yahoo", "یاهو فایننس"), ("contains", "IMF", "صندوق بین‌المللی پول"),
    ("starts", "OWID:", "پایگاه Our World in Data"), ("contains", "SCI", "مرکز آمار ایران"), ("contains", "CBI", "بانک مرکزی ایران"),
]
UNIT_NAMES = [
    ("is", "", ""), ("contains", "%", "٪"), ("is", "percent", "٪"), ("contains", "million tonnes", "میلیون تن"), ("contains", "tonnes", "تن"), ("is", "t", "تن"),
    ("contains", "kwh", "کیلووات‌ساعت"), ("contains", "kilowatt", "کیلووات‌ساعت"), ("contains", "person", "نفر"), ("contains", "yield", None),
]
# ------------------------------------------------------------------------------------------------------------------


def _named_by(table: list[tuple[str, str, str | None]], value: Column, otherwise: Column) -> Column:
    """The name of the first row of the table that fits; a row without a name leaves the value as it is."""
    out = otherwise
    for how, mark, name in reversed(table):
        fits = {"contains": value.contains(mark), "starts": value.startswith(mark), "is": F.trim(value) == mark}[how]
        out = F.when(fits, value if name is None else F.lit(name)).otherwise(out)
    return out


def provider_name(source: Column) -> Column:
    """The Persian name of a data provider; others stay as they are."""
    s = F.coalesce(source, F.lit(""))
    return _named_by(PROVIDER_NAMES, s, s)


def head_key(name: Column) -> Column:
    """The first three words of a name of four or more (else all), without leading labels; empty if shorter than six characters."""
    words = F.filter(F.split(F.coalesce(name, F.lit("")), r"\s+"), lambda w: w != "")
    label = F.transform(words, lambda w: F.regexp_replace(w, ":+$", "").isin(NAME_LABELS))
    first = F.coalesce(F.nullif(F.array_position(label, F.lit(False)), F.lit(0)), F.size(words) + 1).cast("int")
    rest = F.slice(words, first, F.greatest(F.size(words) - first + 1, F.lit(0)))
    head = F.array_join(F.when(F.size(rest) >= 4, F.slice(rest, 1, 3)).otherwise(rest), " ")
    return F.when(F.length(head) >= 6, head).otherwise("")


def unit_name(unit: Column) -> Column:
    """The Persian name of a unit; unknown ones as they are."""
    return _named_by(UNIT_NAMES, F.lower(F.trim(F.coalesce(unit, F.lit("")))), F.trim(unit))


def providers_of(registry: DataFrame, name: str, source: str, most: int = 10_000) -> dict[str, str]:
    """Heads of metric names with their providers' Persian names, for the repairs below: full names don't stand in prose as they are in the registry.

    Of metrics with one head the first by name counts. A registry is a small dimension; one of more than ``most`` rows is an error.
    """
    heads = registry.select(F.col(name).alias("n"), head_key(F.col(name)).alias("h"), provider_name(F.col(source)).alias("p")).filter("h <> '' AND p <> ''")
    rows = heads.groupBy("h").agg(F.min_by("p", "n").alias("p")).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"the registry has over {most} metrics")
    return {r.h: r.p for r in rows}


def without_glossary(text: Column) -> Column:
    """What precedes an appended glossary."""
    return F.regexp_replace(text, r"(?s)\n+\s*📚.*$", "")


def clamped(text: Column, most: int = 170) -> Column:
    """Text cut at the last clause mark before the limit, if that leaves over 40 characters, else at a word's end, with an ellipsis."""
    plain = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    cut = F.substring(plain, 1, most)
    clause = F.regexp_extract(cut, "(?s)^(.*)[،؛]", 1)
    word = F.regexp_extract(cut, "(?s)^(.*) ", 1)
    tidy = F.regexp_replace(clause, "[ ،؛]+$", "")
    return F.when(F.length(plain) <= most, plain).when(F.length(clause) > 40, F.concat(tidy, F.lit("…"))).otherwise(F.concat(F.rtrim(word), F.lit("…")))


def _wordy(inner: Column, least: int) -> Column:
    """A phrase of enough words that holds neither a figure nor a provider."""
    words = F.size(F.filter(F.split(inner, r"\s+"), lambda w: w != ""))
    named = F.lit(False)
    for p in PROVIDER_PHRASES:
        named = named | inner.contains(p)
    return (words >= least) & ~inner.rlike(DIGIT) & ~named


def without_definitions(text: Column) -> Column:
    """Definitions in brackets (five words or more) and between a dash and a year (four or more) taken out; sources, units and short glosses stay."""
    inside = F.filter(F.regexp_extract_all(text, F.lit(r"\(([^()]{15,})\)"), F.lit(1)), lambda x: _wordy(x, 5))
    out = F.aggregate(inside, text, lambda t, x: F.replace(t, F.concat(F.lit("("), x, F.lit(")")), F.lit("")))
    apart = F.filter(F.regexp_extract_all(text, F.lit(rf" — ([^—.؟!\n()]{{10,}}?) در سال {DIGIT}"), F.lit(1)), lambda x: _wordy(x, 4))
    out = F.aggregate(apart, out, lambda t, x: F.replace(t, F.concat(F.lit(" — "), x, F.lit(" در سال ")), F.lit(" در سال ")))
    return F.regexp_replace(out, " {2,}", " ")


def _by_sentence(text: Column, mend) -> Column:
    return F.array_join(F.transform(F.regexp_extract_all(text, F.lit(r"[^.؟!\n]*[.؟!\n]*"), F.lit(0)), mend), "")


def _first_named(text: Column, providers: dict[str, str]) -> Column:
    """The provider of the longest metric name that the text holds; null if none."""
    out = F.lit(None).cast("string")
    for name in sorted(providers, key=len):
        out = F.when(text.contains(name), providers[name]).otherwise(out)
    return out


def filled_placeholders(text: Column, providers: dict[str, str]) -> Column:
    """Placeholder brackets replaced by the provider of a metric named before them in their sentence, or dropped."""

    def mend(sentence: Column) -> Column:
        parts = F.split(sentence, PLACEHOLDER)

        def join(done: Column, part: Column) -> Column:
            named = _first_named(done, providers)
            return F.concat(done, F.coalesce(F.concat(F.lit("("), named, F.lit(")")), F.lit("")), part)

        return F.aggregate(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), F.element_at(parts, 1), join)

    return _by_sentence(text, mend)


def corrected_sources(text: Column, providers: dict[str, str]) -> Column:
    """In a sentence that names a metric, other providers' phrases become the metric's own."""

    def mend(sentence: Column) -> Column:
        want = _first_named(sentence, providers)
        out = sentence
        for phrase in PROVIDER_PHRASES:
            out = F.replace(out, F.lit(phrase), want)  # its own phrase becomes itself
        return F.when(want.isNull(), sentence).otherwise(out)

    return _by_sentence(text, mend)


def inserted_sources(text: Column, providers: dict[str, str]) -> Column:
    """The provider in brackets behind the first figure (with its unit words) that is no year, in sentences that name a metric's head and figures but no provider."""
    with_unit = rf"{DIGIT}[۰-۹0-9٬٫.,]*(?:\s*(?:{UNIT_WORDS}))+"
    bare = rf"{DIGIT}(?:[۰-۹0-9٬٫.,]*{DIGIT})?"

    def mend(sentence: Column) -> Column:
        want = _first_named(sentence, providers)
        named = F.lit(False)
        for p in PROVIDER_PHRASES:
            named = named | sentence.contains(p)
        units = F.regexp_extract_all(sentence, F.lit(with_unit), F.lit(0))
        figures = F.when(F.size(units) > 0, units).otherwise(F.regexp_extract_all(sentence, F.lit(bare), F.lit(0)))
        plain = lambda x: F.translate(F.regexp_replace(x, rf"(?:\s*(?:{UNIT_WORDS}))+$", ""), "۰۱۲۳۴۵۶۷۸۹", "0123456789")
        other = F.filter(figures, lambda x: ~plain(x).rlike("^(19[0-9]{2}|20[0-9]{2}|2100)$"))
        figure = F.coalesce(F.get(other, F.lit(0)), F.get(figures, F.size(figures) - 1))
        end = F.instr(sentence, figure) + F.length(figure) - 1
        added = F.concat(F.substring(sentence, F.lit(1), end), F.lit(" ("), want, F.lit(")"), F.substring(sentence, end + 1, F.length(sentence)))
        return F.when(want.isNull() | named | figure.isNull(), sentence).otherwise(added)

    return _by_sentence(text, mend)


def topic_keys(text: Column, topics: dict[str, list[str]]) -> Column:
    """The topics of which the text holds a word, sorted."""
    hits = [F.when(F.array_contains(F.array(*[text.contains(w) for w in words]), True), F.lit(name)) for name, words in sorted(topics.items())]
    return F.array_compact(F.array(*hits))
