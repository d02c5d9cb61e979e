"""Queries over landed pages: main texts and the articles they give."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.plans.registry import query
from gleaner.plans.tables import Tables
from gleaner.sources import pages as P
from gleaner.sources.readers import articles


def _without(html: str, opens: str, closes: str) -> str:
    return f"array_to_string(list_transform(string_split_regex({html}, '{opens}'), lambda x, i: CASE WHEN i = 1 THEN x WHEN regexp_matches(x, '{closes}') THEN regexp_replace(x, '(?s)^.*?{closes}', '') ELSE '' END), ' ')"


def _plain(block: str) -> str:
    return rf"trim(regexp_replace(regexp_replace({block}, '<[^<>]*>', '', 'g'), '[ \t\n\r\f]+', ' ', 'g'), ' ')"


def _words(text: str) -> str:
    return f"CASE WHEN {text} = '' THEN 0 ELSE length({text}) - length(replace({text}, ' ', '')) + 1 END"


def _main_text_sql() -> str:
    """The main text of each page as m(page_id, url, text): blocks as rows, the best run by window sums."""
    steps = [("h0", _without("coalesce(html, '')", "<!--", "-->"))]
    for tag in P.DROPPED:
        steps.append((f"h{len(steps)}", _without(steps[-1][0], rf"(?i)<{tag}[ \t\n\r\f/>]", f"(?i)</{tag}[^<>]*>")))
    h, before = [], "pages"
    for i, (name, body) in enumerate(steps):
        h.append(f"s{i} AS MATERIALIZED (SELECT page_id, url, {body} AS {name} FROM {before})")
        before = f"s{i}"
    blocks = rf"(?i)(</?(?:{'|'.join(P.BLOCKS)})(?:[ \t\n\r\f/][^<>]*)?>)"
    named = r"""(?i)^<[a-z0-9]+ [^<>]*(?:class|id|role)=(?:"[^"<>]*|''[^''<>]*|[^ <>"'']*)(?:\b|_)(?:%s)(?:\b|_)""" % "|".join(P.PARTS)
    decoded = "t"
    for name, sign in P.NAMED.items():
        decoded = f"replace({decoded}, '&{name};', '{sign.replace(chr(39), chr(39) * 2)}')"
    links = _without("b", r"(?i)<a[ \t\n\r\f>]", "(?i)</a[^<>]*>")
    return (
        "WITH " + ",\n".join(h) + rf""",
b AS (SELECT page_id, unnest(parts) AS b, unnest(range(len(parts))) AS pos FROM (SELECT page_id, string_split(regexp_replace({steps[-1][0]}, '{blocks}', chr(1) || '\1', 'g'), chr(1)) AS parts FROM {before})),
t AS (SELECT page_id, pos, {_plain("b")} AS t, {_plain(links)} AS free, regexp_matches(b, '{named}') AS odd FROM b),
s AS (SELECT *, CASE WHEN odd THEN -greatest({P.PART_COST}, {_words("t")}) ELSE 2 * {_words("free")} - {_words("t")} - CASE WHEN t = '' THEN 0 ELSE {P.BLOCK_COST} END END AS score FROM t),
c AS (SELECT *, sum(score) OVER (PARTITION BY page_id ORDER BY pos) AS upto FROM s),
g AS (SELECT *, least(0, coalesce(min(upto) OVER (PARTITION BY page_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS low FROM c),
e AS (SELECT page_id, pos AS last, low FROM g WHERE upto > low QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY upto - low DESC, pos DESC) = 1),
r AS (SELECT e.page_id, last, CASE WHEN e.low = 0 THEN 0 ELSE min(c.pos) + 1 END AS first FROM e LEFT JOIN c ON c.page_id = e.page_id AND c.pos < e.last AND c.upto = e.low GROUP BY e.page_id, last, e.low),
k AS (SELECT page_id, string_agg(d, chr(10) ORDER BY pos) AS text FROM (SELECT page_id, pos, trim(regexp_replace({decoded}, '[ \t\n\r\f]+', ' ', 'g'), ' ') AS d FROM t JOIN r USING (page_id) WHERE pos BETWEEN first AND last AND NOT odd) WHERE d <> '' GROUP BY 1),
m AS (SELECT page_id, url, coalesce(text, '') AS text FROM pages LEFT JOIN k USING (page_id))"""
    )


@query(_main_text_sql() + " SELECT page_id, text, length(text) AS n_chars FROM m")
def page_texts(t: Tables) -> DataFrame:
    """Main text of every page."""
    return P.main_texts(t.raw("pages"), "html").select("page_id", "text", F.length("text").cast("long").alias("n_chars"))


@query(_main_text_sql() + r", a AS (SELECT *, sha256(lower(trim(regexp_replace(text, '\s+', ' ', 'g'), ' '))) AS content_hash FROM m WHERE length(trim(text, ' ')) >= 200) SELECT page_id, url, content_hash, length(text) AS n_chars FROM a QUALIFY row_number() OVER (PARTITION BY content_hash ORDER BY url, page_id) = 1")
def page_articles(t: Tables) -> DataFrame:
    """Articles of the pages: main texts of 200 characters at least, each content once."""
    found = articles(P.main_texts(t.raw("pages"), "html"), "text", "url", key="page_id")
    return found.select("page_id", "url", "content_hash", F.length("text").cast("long").alias("n_chars"))
