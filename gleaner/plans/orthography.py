"""Queries: Persian names, attribution and definitions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.functions import persian as P
from gleaner.plans.registry import query
from gleaner.plans.tables import Tables, _list, _pick

_SOURCES = ["World Bank WDI", "WDI ", "Yahoo Finance", "IMF DataMapper", "OWID:co2", "SCI census", "CBI", "other"]
_UNITS = ["%", "Percent", "million tonnes", "t", "kWh per person", "1000 persons", "Yield (t/ha)", " current US$ ", ""]
_NAMES = ["نام: قیمت نفت برنت دلار", "ارزش دلاری صادرات کالا", "نرخ تورم", "فارسی سهم صادرات", "دلار", "", "نام فارسی: سهم سوخت از صادرات کشور"]
#: Metrics and their providers, as a post's registry names them.
PROVIDERS = {"نفت برنت": "یاهو فایننس", "صادرات کالا": "بانک جهانی", "نرخ تورم": "بانک مرکزی"}
_BITS = ["قیمت نفت برنت ۹۵٫۶۳ دلار شد در ۲۰۲۲", "ارزش صادرات کالا در 2021 به 111 میلیارد دلار رسید", "نرخ تورم ۴۰ درصد است [منبع: X]", "به گفته EIA نفت برنت گران شد [...]", "هیچ عددی نیست", "قیمت نفت برنت (مجموع درآمد صادراتی به دلار جاری کشور) بالا رفت", "سهم سوخت — چند درصد صادرات کالایی کشور نفت است در سال ۲۰۲۲ بود (بانک جهانی)", "صادرات کالا … …… رشد کرد"]


def _posts(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    text = F.concat(_pick(_BITS, k), F.lit(". "), _pick(_BITS, F.floor(k / 8)), F.when(k % 3 == 0, "\n").otherwise("؟"), _pick(_BITS, F.floor(k / 64) + k), F.when(k % 5 == 0, "\n\n📚 واژه‌نامه\nx").otherwise(""))
    return t.raw("orders").select(k.alias("k"), text.alias("text"))


_POSTS = f"p AS (SELECT o_orderkey AS k, {_list(_BITS)}[o_orderkey % 8 + 1] || '. ' || {_list(_BITS)}[(o_orderkey // 8) % 8 + 1] || CASE WHEN o_orderkey % 3 = 0 THEN chr(10) ELSE '؟' END || {_list(_BITS)}[((o_orderkey // 64) + o_orderkey) % 8 + 1] || CASE WHEN o_orderkey % 5 = 0 THEN chr(10) || chr(10) || '📚 واژه‌نامه' || chr(10) || 'x' ELSE '' END AS text FROM orders)"
_SENTENCES = "s AS (SELECT k, unnest(regexp_extract_all(text, '[^.؟!\\n]*[.؟!\\n]*')) AS x, unnest(range(len(regexp_extract_all(text, '[^.؟!\\n]*[.؟!\\n]*')))) AS i FROM p)"


def _named(column: str) -> str:
    return "CASE " + " ".join(f"WHEN contains({column}, '{n}') THEN '{PROVIDERS[n]}'" for n in sorted(PROVIDERS, key=len, reverse=True)) + " END"


_ANY = "(" + " OR ".join(f"contains(x, '{p}')" for p in P.PROVIDER_PHRASES) + ")"


@query(f"SELECT p_partkey, CASE WHEN contains(s, 'World Bank') OR trim(s) = 'WDI' THEN 'بانک جهانی' WHEN contains(s, 'Yahoo') THEN 'یاهو فایننس' WHEN contains(s, 'IMF') THEN 'صندوق بین‌المللی پول' WHEN starts_with(s, 'OWID:') THEN 'پایگاه Our World in Data' WHEN contains(s, 'SCI') THEN 'مرکز آمار ایران' WHEN contains(s, 'CBI') THEN 'بانک مرکزی ایران' ELSE s END AS provider FROM (SELECT p_partkey, {_list(_SOURCES)}[p_partkey % 8 + 1] AS s FROM part)")
def provider_names(t: Tables) -> DataFrame:
    return t.raw("part").select("p_partkey", P.provider_name(_pick(_SOURCES, F.col("p_partkey"))).alias("provider"))


@query(f"SELECT p_partkey, CASE WHEN u = '' THEN '' WHEN contains(u, '%') OR u = 'percent' THEN '٪' WHEN contains(u, 'million tonnes') THEN 'میلیون تن' WHEN contains(u, 'tonnes') OR u = 't' THEN 'تن' WHEN contains(u, 'kwh') OR contains(u, 'kilowatt') THEN 'کیلووات‌ساعت' WHEN contains(u, 'person') THEN 'نفر' WHEN contains(u, 'yield') THEN u ELSE trim(raw) END AS unit FROM (SELECT p_partkey, raw, lower(trim(raw)) AS u FROM (SELECT p_partkey, {_list(_UNITS)}[p_partkey % 9 + 1] AS raw FROM part))")
def unit_names(t: Tables) -> DataFrame:
    return t.raw("part").select("p_partkey", P.unit_name(_pick(_UNITS, F.col("p_partkey"))).alias("unit"))


@query(f"WITH n AS (SELECT p_partkey, list_filter(string_split({_list(_NAMES)}[p_partkey % 7 + 1], ' '), lambda w: w <> '') AS w FROM part), r AS (SELECT p_partkey, CASE WHEN len(w) >= 2 AND rtrim(w[1], ':') IN ('نام', 'فارسی', 'انگلیسی') AND rtrim(w[2], ':') IN ('نام', 'فارسی', 'انگلیسی') THEN w[3:] WHEN len(w) >= 1 AND rtrim(w[1], ':') IN ('نام', 'فارسی', 'انگلیسی') THEN w[2:] ELSE w END AS w FROM n), h AS (SELECT p_partkey, array_to_string(CASE WHEN len(w) >= 4 THEN w[1:3] ELSE w END, ' ') AS h FROM r) SELECT p_partkey, CASE WHEN length(h) >= 6 THEN h ELSE '' END AS head FROM h")
def head_keys(t: Tables) -> DataFrame:
    return t.raw("part").select("p_partkey", P.head_key(_pick(_NAMES, F.col("p_partkey"))).alias("head"))


@query("WITH " + _POSTS + r" SELECT k, regexp_replace(text, '(?s)\n+\s*📚.*$', '') AS body FROM p")
def glossary_stripped(t: Tables) -> DataFrame:
    return _posts(t).select("k", P.without_glossary(F.col("text")).alias("body"))


@query("WITH " + _POSTS + r", c AS (SELECT k, trim(regexp_replace(text, '\s+', ' ', 'g'), ' ') AS t FROM p), d AS (SELECT *, regexp_extract(t[1:90], '(?s)^(.*)[،؛]', 1) AS clause, regexp_extract(t[1:90], '(?s)^(.*) ', 1) AS word FROM c) SELECT k, CASE WHEN length(t) <= 90 THEN t WHEN length(clause) > 40 THEN regexp_replace(clause, '[ ،؛]+$', '') || '…' ELSE rtrim(word, ' ') || '…' END AS short FROM d")
def clause_clamp(t: Tables) -> DataFrame:
    return _posts(t).select("k", P.clamped(F.col("text"), 90).alias("short"))


_WORDY = "len(list_filter(string_split_regex(m, '\\s+'), lambda w: w <> '')) >= {n} AND NOT regexp_matches(m, '[۰-۹0-9]') AND NOT (" + " OR ".join(f"contains(m, '{p}')" for p in P.PROVIDER_PHRASES) + ")"


@query(
    "WITH " + _POSTS + r", i AS (SELECT k, text, list_filter(regexp_extract_all(text, '\(([^()]{15,})\)', 1), lambda m: " + _WORDY.format(n=5) + r") AS a, list_filter(regexp_extract_all(text, ' — ([^—.؟!\n()]{10,}?) در سال [۰-۹0-9]', 1), lambda m: " + _WORDY.format(n=4) + r") AS b FROM p),"
    " f AS (SELECT k, list_reduce(list_prepend(text, a), lambda t, m: replace(t, '(' || m || ')', '')) AS t, b FROM i) SELECT k, regexp_replace(list_reduce(list_prepend(t, b), lambda t, m: replace(t, ' — ' || m || ' در سال ', ' در سال ')), ' {2,}', ' ', 'g') AS mended FROM f"
)
def definitions_stripped(t: Tables) -> DataFrame:
    return _posts(t).select("k", P.without_definitions(F.col("text")).alias("mended"))


_SPLIT = P.PLACEHOLDER.replace("'", "''")


@query(
    "WITH " + _POSTS + ", " + _SENTENCES + f", f AS (SELECT k, i, list_reduce(string_split_regex(x, '{_SPLIT}'), lambda a, b: a || coalesce('(' || {_named('a')} || ')', '') || b) AS y FROM s) SELECT p.k, coalesce(string_agg(y, '' ORDER BY i), '') AS mended FROM p LEFT JOIN f USING (k) GROUP BY 1"
)
def placeholders_filled(t: Tables) -> DataFrame:
    return _posts(t).select("k", P.filled_placeholders(F.col("text"), PROVIDERS).alias("mended"))


# each phrase in turn, on what the ones before it left
_STEPS, _last = [], "w0"
for _n, _p in enumerate(P.PROVIDER_PHRASES):
    _STEPS.append(f"c{_n} AS (SELECT k, i, w, CASE WHEN w = '{_p}' THEN x ELSE replace(x, '{_p}', w) END AS x FROM {_last})")
    _last = f"c{_n}"


@query("WITH " + _POSTS + ", " + _SENTENCES + f", w0 AS (SELECT k, i, x, {_named('x')} AS w FROM s), " + ", ".join(_STEPS) + f", f AS (SELECT w0.k, w0.i, CASE WHEN w0.w IS NULL THEN w0.x ELSE c.x END AS y FROM w0 JOIN {_last} c ON c.k = w0.k AND c.i = w0.i) SELECT k, string_agg(y, '' ORDER BY i) AS mended FROM f GROUP BY 1")
def sources_corrected(t: Tables) -> DataFrame:
    return _posts(t).select("k", P.corrected_sources(F.col("text"), PROVIDERS).alias("mended"))


_FIGURES = f"CASE WHEN len(regexp_extract_all(x, '[۰-۹0-9][۰-۹0-9٬٫.,]*(?:\\s*(?:{P.UNIT_WORDS}))+')) > 0 THEN regexp_extract_all(x, '[۰-۹0-9][۰-۹0-9٬٫.,]*(?:\\s*(?:{P.UNIT_WORDS}))+') ELSE regexp_extract_all(x, '[۰-۹0-9](?:[۰-۹0-9٬٫.,]*[۰-۹0-9])?') END"
_BARE = f"translate(regexp_replace(m, '(?:\\s*(?:{P.UNIT_WORDS}))+$', ''), '۰۱۲۳۴۵۶۷۸۹', '0123456789')"


@query(
    "WITH " + _POSTS + ", " + _SENTENCES + f", g AS (SELECT k, i, x, {_named('x')} AS w, {_ANY} AS named, {_FIGURES} AS figures FROM s), h AS (SELECT *, coalesce(list_filter(figures, lambda m: NOT regexp_matches({_BARE}, '^(19[0-9]{{2}}|20[0-9]{{2}}|2100)$'))[1], figures[len(figures)]) AS figure FROM g),"
    " e AS (SELECT *, strpos(x, figure) + length(figure) - 1 AS at_end FROM h) SELECT k, string_agg(CASE WHEN w IS NULL OR named OR figure IS NULL THEN x ELSE substr(x, 1, at_end) || ' (' || w || ')' || substr(x, at_end + 1) END, '' ORDER BY i) AS mended FROM e GROUP BY 1"
)
def sources_inserted(t: Tables) -> DataFrame:
    return _posts(t).select("k", P.inserted_sources(F.col("text"), PROVIDERS).alias("mended"))


#: Metrics as a registry names them in full, with their sources; prose has the heads only.
_METRICS = [("نام: قیمت نفت برنت دلار هر بشکه", "Yahoo Finance"), ("ارزش صادرات کالا به دلار جاری", "World Bank WDI"), ("نرخ تورم سالانه مصرف کننده", "CBI"), ("دلار", "other")]
_HEADS = {"قیمت نفت برنت": "یاهو فایننس", "ارزش صادرات کالا": "بانک جهانی", "نرخ تورم سالانه": "بانک مرکزی ایران"}


def _by_head(column: str) -> str:
    return "CASE " + " ".join(f"WHEN contains({column}, '{h}') THEN '{_HEADS[h]}'" for h in sorted(_HEADS, key=len, reverse=True)) + " END"


@query(
    "WITH " + _POSTS + ", " + _SENTENCES + f", g AS (SELECT k, i, x, {_by_head('x')} AS w, {_ANY} AS named, {_FIGURES} AS figures FROM s), h AS (SELECT *, coalesce(list_filter(figures, lambda m: NOT regexp_matches({_BARE}, '^(19[0-9]{{2}}|20[0-9]{{2}}|2100)$'))[1], figures[len(figures)]) AS figure FROM g),"
    " e AS (SELECT *, strpos(x, figure) + length(figure) - 1 AS at_end FROM h) SELECT k, string_agg(CASE WHEN w IS NULL OR named OR figure IS NULL THEN x ELSE substr(x, 1, at_end) || ' (' || w || ')' || substr(x, at_end + 1) END, '' ORDER BY i) AS mended FROM e GROUP BY 1"
)
def sources_inserted_by_heads(t: Tables) -> DataFrame:
    """Providers inserted where a sentence names the head of a registered metric; heads and names come from the registry's own rows."""
    providers = P.providers_of(t.spark.createDataFrame(_METRICS, "label string, source string"), "label", "source")
    return _posts(t).select("k", P.inserted_sources(F.col("text"), providers).alias("mended"))
