"""Sources: feeds, series, works and posts, from landed files to tables. Fetching is outside the engine; each reader takes a path.

Filters that a remote service should have applied are applied again after the scan.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleaner.functions.rules import vintage
from gleaner.functions.text import collapsed, content_hash
from gleaner.operators.common import top_k

SERIES = "indicator string, subject string, period string, value double, source string, vintage string"


def sources_config(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """Configured sources as (name, url, tier, ...): an int tier as it is, a profile's tier taken out, else 3; one row per name, the first."""
    seen: dict[str, tuple] = {}
    for r in rows:
        profile = r.get("reliability_profile", r.get("reliability_tier"))
        tier = profile.get("tier", 3) if isinstance(profile, dict) else profile if isinstance(profile, int) and not isinstance(profile, bool) else 3
        seen.setdefault(r["name"], (r["name"], r.get("url"), tier, r.get("language"), r.get("type")))
    return spark.createDataFrame(list(seen.values()), "name string, url string, tier int, language string, type string")


def feed_entries(spark: SparkSession, path: str, per_source: int = 10) -> DataFrame:
    """Landed RSS or Atom files (one XML file per feed) as entries with a link, the first of each file.

    The XML reader splits files by item, or by entry, so a file of any size is scanned in parallel.
    """
    rss = "title string, link string, pubDate string, description string"
    atom = "title string, link array<struct<_href: string, _rel: string>>, published string, updated string, summary string, content string"
    one = spark.read.option("rowTag", "item").schema(rss).xml(path).withColumn("__file", F.input_file_name()).withColumn("__pos", F.monotonically_increasing_id())
    entry = spark.read.option("rowTag", "entry").schema(atom).xml(path).withColumn("__file", F.input_file_name()).withColumn("__pos", F.monotonically_increasing_id())
    # of an entry's links the one that isn't to something else
    links = F.filter("link", lambda x: F.coalesce(x["_rel"], F.lit("alternate")) == "alternate")
    entry = entry.select("title", F.get(F.transform(links, lambda x: x["_href"]), F.lit(0)).alias("link"), F.coalesce("published", "updated").alias("pubDate"), F.coalesce("summary", "content").alias("description"), "__file", "__pos")
    df = one.unionByName(entry).filter(F.length(F.trim("link")) > 0)
    df = top_k(df, ["__file"], [F.asc("__pos")], per_source, "rank")
    return df.select(F.col("__file").alias("feed"), "rank", collapsed(F.col("title")).alias("title"), F.trim("link").alias("url"), feed_time(F.col("pubDate")).alias("published"), "description")


def feed_time(text: Column) -> Column:
    """RFC 822 dates, with a zone's offset or name, or ISO ones; null for others."""
    plain = F.regexp_replace(F.trim(text), r"\s*(GMT|UTC|Z)$", " +0000")
    plain = F.regexp_replace(plain, r"^[A-Za-z]{3},\s*", "")
    return F.coalesce(F.try_to_timestamp(plain, F.lit("d MMM yyyy HH:mm:ss Z")), F.try_to_timestamp(F.trim(text)))


def recent(entries: DataFrame, now: str, days: int = 21) -> DataFrame:
    """Entries of the last days; undated ones stay."""
    return entries.filter(F.col("published").isNull() | (F.col("published") >= F.expr(f"TIMESTAMP '{now}' - INTERVAL {days} DAYS")))


def articles(pages: DataFrame, text: str, url: str, least: int = 200, key: str | None = None) -> DataFrame:
    """Extracted articles of enough text, one per content: that of the smallest url, of equal ones of the smallest key."""
    kept = pages.filter(F.length(F.trim(text)) >= least).withColumn("content_hash", content_hash(F.col(text)))
    return top_k(kept, ["content_hash"], [F.asc(url), *([F.asc(key)] if key else [])], 1)


def answer_rows(spark: SparkSession, path: str, first: str, row: str, whole: Callable[[Column], Column], stream: bool = False) -> DataFrame:
    """(file, r): the rows of landed JSON answers; one large answer is read by many tasks.

    ``first`` is the field that each row of the answer starts with. Answers as services send them have no white space before it, so a file is cut, by Spark's own splits,
    wherever a row starts: within JSON strings quotes are escaped, so the mark can't stand inside one. What stands before the first mark is the answer's
    head. An answer that is laid out otherwise has no mark and is one piece, which ``whole`` turns into an array of rows. Pieces that aren't JSON give no rows.
    """
    mark = '{"' + first + '"'
    reader = spark.readStream if stream else spark.read
    raw = reader.option("lineSep", mark).text(path).select(F.col("_metadata.file_path").alias("file"), "value")
    own = F.from_json(F.concat(F.lit(mark), F.regexp_replace("value", r"[\s,]+$", "")), row)
    rows = F.when(F.col("value").rlike(r"^\s*:"), F.array(own)).otherwise(whole(F.col("value")))
    return raw.select("file", F.explode(rows).alias("r")).filter("r IS NOT NULL")


_WORLD_BANK_ROW = "struct<indicator: struct<id: string, value: string>, country: struct<id: string, value: string>, date: string, value: double>"


def _after_head(value: Column) -> Column:
    """The rows of a whole answer that is an array of a head and an array of rows."""
    return F.from_json(F.regexp_extract(value, r"(?s)^\s*\[\s*\{.*?\}\s*,\s*(\[.*\])\s*\]\s*$", 1), f"array<{_WORLD_BANK_ROW}>")


def world_bank(spark: SparkSession, path: str, this_year: int, stream: bool = False) -> DataFrame:
    """Landed API answers: a JSON array of a header and rows; null values are skipped. With stream, of a folder into which answers keep landing."""
    one = answer_rows(spark, path, "indicator", _WORLD_BANK_ROW, _after_head, stream).filter("r.value IS NOT NULL")
    return _series(one, F.col("r.indicator.value"), F.col("r.country.value"), F.col("r.date"), F.col("r.value"), "World Bank WDI", this_year)


def world_bank_status(spark: SparkSession, path: str) -> DataFrame:
    """(file, status, observations) of landed answers, three ways apart: ok, no_observation (the source answered, without a value), source_unavailable (no answer that can be read)."""
    row = "struct<date: string, value: double>"
    raw = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")
    whole = F.regexp_extract("value", r"(?s)^\s*\[(.*)\]\s*$", 0)
    body = F.from_json(F.regexp_extract("value", r"(?s)^\s*\[\s*\{.*?\}\s*,\s*(\[.*\])\s*\]\s*$", 1), f"array<{row}>")
    n = F.size(F.filter(F.coalesce(body, F.array().cast(f"array<{row}>")), lambda x: x["value"].isNotNull()))
    return raw.select("file", F.when(n > 0, "ok").when(whole != "", "no_observation").otherwise("source_unavailable").alias("status"), n.alias("observations"))


def unsd(spark: SparkSession, path: str, indicator: str, area: str = "364", this_year: int = 2026) -> DataFrame:
    """Landed answers of {"data": [{geoAreaCode, value, timePeriod, year}]}: the area's rows with a value; none where the answer has another shape."""
    row = "struct<geoAreaCode: string, value: string, timePeriod: string, year: string>"
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", f"data array<{row}>").alias("j"))
    one = raw.select(F.explode("j.data").alias("r")).filter(F.col("r.geoAreaCode") == area).withColumn("v", F.col("r.value").try_cast("double")).filter("v IS NOT NULL")
    period = F.coalesce(F.nullif("r.timePeriod", F.lit("")), "r.year", F.lit(""))
    return _series(one, F.lit(f"SDG {indicator}"), F.lit(area), period, F.col("v"), "UNSD SDG", this_year)


def oecd(spark: SparkSession) -> DataFrame:
    """No rows: what that source answers isn't guessed at."""
    return spark.createDataFrame([], SERIES)


def read_source(spark: SparkSession, name: str, **how) -> DataFrame:
    """Series of the named source from its landed answers. Raises for a name without a reader."""
    readers = {"worldbank": world_bank, "imf": imf, "owid": owid, "unsd": unsd, "oecd": oecd}
    if name not in readers:
        raise ValueError(f"no reader for {name!r}; known: {', '.join(sorted(readers))}")
    return readers[name](spark, **how)


def bulk(spark: SparkSession, wanted: list[dict]) -> tuple[DataFrame, list[tuple[str, str]]]:
    """All curated indicators, each under its label, and what failed (source, error): a source that fails leaves the others alone.

    wanted: dicts of source, label, and the reader's own arguments.
    """
    parts, failed = [oecd(spark)], []
    for one in wanted:
        how = {k: v for k, v in one.items() if k not in ("source", "label")}
        try:
            parts.append(read_source(spark, one["source"], **how).withColumn("indicator", F.lit(one["label"])))
        except Exception as error:  # noqa: BLE001  a source that can't be read is reported, not guessed
            failed.append((one["source"], str(error).splitlines()[0]))
    return combined(parts), failed


# Words of a statement, and the domains of series they call for.
DOMAIN_SERIES = {
    "economic": ["labor", "labor_gender"], "cooperativ": ["labor"], "energy": ["energy", "environment"], "water": ["energy", "agriculture", "environment"], "agriculture": ["agriculture", "environment"], "export": ["agriculture", "environment"],
    "women": ["labor_gender", "labor"], "gender": ["labor_gender", "labor"], "labor": ["labor", "labor_gender"], "unemploy": ["labor", "labor_gender"], "family": ["labor_gender"], "housing": ["labor"], "conflict": ["energy", "environment"],
}


def series_domains(statement: Column) -> Column:
    """The domains of series that a statement's words call for, each once, sorted."""
    low = F.lower(F.coalesce(statement, F.lit("")))
    found = F.flatten(F.array(*[F.when(low.contains(w), F.array(*[F.lit(d) for d in domains])).otherwise(F.array().cast("array<string>")) for w, domains in DOMAIN_SERIES.items()]))
    return F.array_sort(F.array_distinct(found))


def series_by_domain(statements: DataFrame, series: DataFrame) -> DataFrame:
    """(statement, series' columns): rows of series(domain, ...) of each statement's domains. Distinct statements meet series by domain."""
    own = statements.select("statement").distinct().select("statement", F.explode(series_domains(F.col("statement"))).alias("domain"))
    return own.join(series, "domain")


def imf(spark: SparkSession, path: str, indicator: str, subject: str, this_year: int) -> DataFrame:
    """Landed answers of {"values": {indicator: {subject: {year: value}}}}."""
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", "values map<string, map<string, map<string, double>>>").alias("j"))
    years = raw.select(F.explode(F.try_element_at(F.try_element_at("j.values", F.lit(indicator)), F.lit(subject))).alias("year", "v")).filter("v IS NOT NULL")
    return _series(years, F.lit(indicator), F.lit(subject), F.col("year"), F.col("v"), "IMF", this_year)


def _series(df: DataFrame, indicator: Column, subject: Column, period: Column, value: Column, source: str, this_year: int) -> DataFrame:
    return df.select(indicator.alias("indicator"), subject.alias("subject"), period.alias("period"), value.alias("value"), F.lit(source).alias("source"), vintage(period, this_year).alias("vintage"))


def owid(spark: SparkSession, path: str, code: str = "IRN", entity: str = "Iran", this_year: int = 2026) -> DataFrame:
    """A landed grapher CSV, filtered again to the entity; the first numeric column that isn't an identity is the value, an original-year column overrides the year.

    Raises if no row is left: an empty series must not pass for data.
    """
    df = spark.read.csv(path, header=True)
    identity = {"entity", "code", "year", "day"}
    values = [c for c in df.columns if c.lower() not in identity and not c.lower().endswith("__original_year")]
    original = [c for c in df.columns if c.lower().endswith("__original_year")]
    own = df.filter((F.col("Code") == code) | (F.col("Entity") == entity))
    value = F.coalesce(*[F.col(f"`{c}`").try_cast("double") for c in values])
    year = F.coalesce(*[F.col(f"`{c}`").try_cast("int") for c in original], F.col("Year").try_cast("int")).cast("string")
    out = _series(own.withColumns({"__v": value, "__y": year}).filter("__v IS NOT NULL"), F.lit(values[0] if values else None), F.lit(entity), F.col("__y"), F.col("__v"), "OWID", this_year)
    if out.isEmpty():
        raise ValueError(f"no rows for {entity}")
    return out


def combined(parts: list[DataFrame]) -> DataFrame:
    """The union of series; a source without an adapter contributes an empty list."""
    return reduce(lambda a, b: a.unionByName(b), parts)


WORK = (
    "id string, title string, doi string, publication_year int, type string, cited_by_count int, abstract_inverted_index map<string, array<int>>, "
    "authorships array<struct<raw_author_name: string, institutions: array<struct<display_name: string>>, countries: array<string>>>, concepts array<struct<display_name: string>>"
)


def abstract(index: Column) -> Column:
    """An abstract from its inverted index: words by position; of two words at one position the one later in the alphabet's map order counts."""
    pairs = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    return F.array_join(F.transform(F.array_sort(pairs), lambda x: x["w"]), " ")


def works(spark: SparkSession, path: str, query_ix: int = 0, source_ix: int = 0) -> DataFrame:
    """Landed works (JSON lines) as flat studies; institutions and countries each once, in first order."""
    df = spark.read.schema(WORK).json(path)
    institutions = F.array_distinct(F.flatten(F.transform("authorships", lambda a: F.transform(a["institutions"], lambda i: i["display_name"]))))
    return df.select(
        "id", "title", F.lower("doi").alias("doi"), F.col("publication_year").alias("year"), F.col("type").alias("study_type"), "cited_by_count", abstract(F.col("abstract_inverted_index")).alias("abstract"),
        F.transform("authorships", lambda a: a["raw_author_name"]).alias("authors"), institutions.alias("institutions"),
        F.array_distinct(F.flatten(F.transform("authorships", lambda a: a["countries"]))).alias("countries"), F.transform("concepts", lambda c: c["display_name"]).alias("concepts"),
        F.lit(query_ix).alias("query_ix"), F.lit(source_ix).alias("source_ix"),
    )


def semantic_works(spark: SparkSession, path: str, query_ix: int = 0, source_ix: int = 1) -> DataFrame:
    """Landed answers of {"data": [...]} as flat studies; those without a title or an abstract are dropped."""
    paper = "struct<paperId: string, title: string, abstract: string, year: int, citationCount: int, externalIds: struct<DOI: string>, authors: array<struct<name: string>>>"
    raw = answer_rows(spark, path, "paperId", paper, lambda v: F.from_json(v, f"data array<{paper}>")["data"]).select(F.col("r").alias("p"))
    kept = raw.filter((F.trim(F.coalesce("p.title", F.lit(""))) != "") & (F.trim(F.coalesce("p.abstract", F.lit(""))) != ""))
    none = F.array().cast("array<string>")
    return kept.select(
        F.col("p.paperId").alias("id"), F.col("p.title").alias("title"), F.lower("p.externalIds.DOI").alias("doi"), F.col("p.year").alias("year"), F.lit(None).cast("string").alias("study_type"), F.col("p.citationCount").alias("cited_by_count"), F.col("p.abstract").alias("abstract"),
        F.transform("p.authors", lambda a: a["name"]).alias("authors"), none.alias("institutions"), none.alias("countries"), none.alias("concepts"), F.lit(query_ix).alias("query_ix"), F.lit(source_ix).alias("source_ix"),
    )


def news_search(spark: SparkSession, path: str, preferred: list[str]) -> DataFrame:
    """Landed answers of {"articles": [...]}: titled ones, with the time seen and whether the outlet is preferred, and their place: preferred, English, newest first."""
    article = "struct<title: string, url: string, domain: string, seendate: string, language: string>"
    raw = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.from_json("value", f"articles array<{article}>").alias("j")).select("file", F.posexplode("j.articles").alias("pos", "a"))
    domain = F.lower(F.coalesce("a.domain", F.lit("")))
    liked = reduce(lambda x, y: x | y, [domain.contains(p) for p in preferred], F.lit(False))
    kept = raw.filter(F.coalesce("a.title", F.lit("")) != "").select("file", "pos", F.trim("a.title").alias("title"), F.col("a.url").alias("url"), domain.alias("domain"), F.try_to_timestamp("a.seendate", F.lit("yyyyMMdd'T'HHmmss'Z'")).alias("seen"), F.col("a.language").alias("language"), liked.alias("preferred"))
    english = F.coalesce(F.col("language").isin("English", "eng"), F.lit(False))
    order = Window.partitionBy("file").orderBy(F.desc("preferred"), F.desc(english), F.desc_nulls_last("seen"), F.asc("pos"))
    return kept.withColumn("place", F.row_number().over(order))


def frozen(studies: DataFrame, fetched: DataFrame | None = None) -> DataFrame:
    """Studies frozen beforehand stand in for retrieval wherever there are any; else what was fetched."""
    if fetched is None:
        return studies
    return studies.unionByName(fetched.join(studies.limit(1).select(F.lit(1).alias("__any")), F.lit(True), "left_anti"), allowMissingColumns=True)


def merged_works(parts: list[DataFrame]) -> DataFrame:
    """The union of works, one per DOI (or per start of the title), the first by query and source; works with neither are dropped."""
    df = combined(parts).withColumn("__key", F.coalesce("doi", F.substring(F.lower("title"), 1, 80))).filter("__key IS NOT NULL")
    return top_k(df, ["__key"], [F.asc("query_ix"), F.asc("source_ix"), F.asc("id")], 1).drop("__key")


def posts(spark: SparkSession, path: str) -> DataFrame:
    """Post files: named head sections, the body, and the GATES, QC and NOTE sections behind; the whole text where there are no marks."""
    raw = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.col("value").alias("raw"))

    def stripped(c: Column) -> Column:
        return F.regexp_replace(c, r"^\s+|\s+$", "")

    def section(name: str) -> Column:
        return F.nullif(stripped(F.regexp_extract("raw", rf"(?s)===\s*{name}\s*===\s*\n(.*?)(?=\n===\s*[A-Z]+\s*===|\z)", 1)), F.lit(""))

    head = {n: F.nullif(stripped(F.regexp_extract("raw", rf"(?m)^{n}:\s*(.*)$", 1)), F.lit("")).alias(n.lower()) for n in ("ANGLE", "TLDR", "GLOSSARY", "OUTLINE")}
    body = stripped(F.regexp_replace(F.regexp_replace("raw", r"(?s)\n?===\s*(?:GATES|QC|NOTE)\s*===.*\z", ""), r"(?m)^(?:ANGLE|TLDR|GLOSSARY|OUTLINE):.*$\n?", ""))
    return raw.select("file", *head.values(), body.alias("body"), section("GATES").alias("gates"), section("QC").alias("qc"), section("NOTE").alias("note"))


def model_json(text: Column, schema: str) -> Column:
    """A model's answer as a struct: code fences stripped, else the outermost braces; null if neither parses."""
    plain = F.trim(F.regexp_replace(text, r"(?s)^\s*```(?:json)?\s*|\s*```\s*$", ""))
    # a parser that keeps going gives a row of nulls for other text, so what is no object isn't tried as one
    return F.from_json(F.when(plain.rlike(r"(?s)^\{.*\}$"), plain).otherwise(F.regexp_extract(text, r"(?s)\{.*\}", 0)), schema)
