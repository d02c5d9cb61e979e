"""Text functions over columns; all stay in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Persian and Arabic-Indic digits with their ASCII counterparts.
PERSIAN_DIGITS = "۰۱۲۳۴۵۶۷۸۹٠١٢٣٤٥٦٧٨٩"
ASCII_DIGITS = "01234567890123456789"


def bound(value: Column, build: Callable[[Column], Column]) -> Column:
    """build of a value that is worked out once a row, however often build names it; a plain column is worked out anew in each branch."""
    return F.get(F.transform(F.array(value), build), F.lit(0))


def collapsed(text: Column) -> Column:
    """White space runs as one space, ends trimmed."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def clean_string(text: Column) -> Column:
    """Collapsed text, null if nothing is left."""
    return F.nullif(collapsed(text), F.lit(""))


def content_hash(text: Column) -> Column:
    """SHA-256 of collapsed lower-case text: equal for texts that differ in case and white space only."""
    return F.sha2(F.lower(collapsed(F.coalesce(text, F.lit("")))).cast("binary"), 256)


def clean_aliases(aliases: Column) -> Column:
    """Collapsed, non-blank, each once, in first order."""
    return F.array_distinct(F.filter(F.transform(aliases, clean_string), lambda x: x.isNotNull()))


def tokens(text: Column, pattern: str) -> Column:
    """Distinct matches of pattern in lower-case text, in order of first occurrence."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(pattern), F.lit(0)))


def sentences(text: Column, least: int = 0) -> Column:
    """Trimmed stretches between full stops and line ends, of at least that many characters."""
    parts = F.transform(F.split(F.coalesce(text, F.lit("")), r"[.\n]+"), lambda x: F.trim(x))
    return F.filter(parts, lambda x: F.length(x) >= max(least, 1))


def ascii_digits(text: Column) -> Column:
    return F.translate(text, PERSIAN_DIGITS, ASCII_DIGITS)


def plain_numbers(text: Column) -> Column:
    """ASCII digits, thousands separators dropped."""
    return F.regexp_replace(ascii_digits(F.coalesce(text, F.lit(""))), "[,،]", "")


def numbers_in(text: Column) -> Column:
    """Distinct numbers (signs, decimals and percent signs kept) as sorted strings."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(plain_numbers(text), F.lit(r"[+-]?[0-9]+(?:\.[0-9]+)?%?"), F.lit(0))))


def host(url: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(F.lower(url), r"^[a-z]+://([^/:?#]+)", 1), r"^www\.", "")


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def shortened(text: Column, length: int, mark: str = "...") -> Column:
    return F.when(F.length(text) > length, F.concat(F.substring(text, 1, length), F.lit(mark))).otherwise(text)


def containing(text: Column, lexicon: list[str]) -> Column:
    """How many of the lexicon's terms occur in lower-case text, as substrings."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return sum((low.contains(term).cast("int") for term in lexicon), F.lit(0))


def quantity_score(text: Column) -> Column:
    """Digits, and twice the words of magnitude and share."""
    return F.regexp_count(text, F.lit("[0-9۰-۹]")) + 2 * F.regexp_count(F.lower(text), F.lit("%|percent|میلیون|هزار|billion|million|thousand"))


def ngrams(words: Column, n: int) -> Column:
    """Space-joined runs of n words. The words are bound once, or each run would cut the text again."""

    def runs(w: Column) -> Column:
        last = F.size(w) - n
        return F.when(last < 0, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.array_join(F.slice(w, i + 1, n), " ")))

    return bound(words, runs)


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all distinct elements; 0 for two empty sets."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def containment(a: Column, b: Column) -> Column:
    """The share of a's distinct elements that b has."""
    own = F.size(F.array_distinct(a))
    return F.when(own == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / own)


def stem(word: Column) -> Column:
    """Lower case, one trailing s off words of over four letters."""
    low = F.lower(word)
    return F.when((F.length(low) > 4) & low.endswith("s"), F.substring(low, F.lit(1), F.length(low) - 1)).otherwise(low)


def sentences_after_marks(text: Column) -> Column:
    """Split behind a full stop, question or exclamation mark with white space after it, and at line ends."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"(?<=[.!?])\s+|\n+"), lambda x: x != "")


def long_sentences(text: Column, least: int = 25) -> Column:
    """Sentences of at least so many characters; a point between digits ends none."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"(?:(?<![0-9])\.|\.(?![0-9])|[!?\n])+"), lambda x: F.trim(x)), lambda x: F.length(x) >= least)


def sentence_spans(text: Column) -> Column:
    """Sentences with the marks that end them, so that joined they are the text again."""
    return F.filter(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[^.!?\n]*[.!?\n]*"), F.lit(0)), lambda x: x != "")


def by_marks(text: Column) -> Column:
    """Stretches between any marks that end or part sentences."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "[.!?;:]+"), lambda x: F.trim(x) != "")
