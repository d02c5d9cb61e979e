"""Main text of landed pages, with column expressions only: blocks of markup, and the best run of them.

1. What never shows or frames a page goes with its content: comments, scripts, styles, head, menus, footers and so on. An element reaches from its start
   tag to the next end tag of its name; nothing is searched twice, so work is in proportion to the page.
2. The rest is cut into blocks where block elements start or end. A block's words count for it outside links and against it within links; each
   block with text costs a word, and one whose own start tag names a part that isn't article text (an advert, a share bar) counts against the run and has no text.
3. The main text is the run of blocks, one after another, with the greatest sum (a maximum of differences of prefix sums, in one fold over the page's array); of
   equal runs the one that ends last, of those the longest. Its blocks are decoded, joined by line ends, and form the article.

Attributes are taken to hold no angle brackets. Tables aren't article text. A null page has an empty text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Elements that go with all they hold; elements that start or end a block; words of class, id or role that mark a block as no article text.
DROPPED = ["head", "script", "style", "noscript", "template", "svg", "textarea", "select", "button", "iframe", "nav", "header", "footer", "aside", "form", "table"]
BLOCKS = ["address", "article", "blockquote", "body", "br", "dd", "div", "dl", "dt", "figcaption", "figure", "h1", "h2", "h3", "h4", "h5", "h6", "hr", "html", "li", "main", "ol", "p", "pre", "section", "ul"]
PARTS = ["ad", "ads", "advert", "advertisement", "sponsored", "promo", "banner", "cookie", "cookies", "consent", "newsletter", "subscribe", "share", "social", "related", "comment", "comments", "reply", "menu", "breadcrumb", "breadcrumbs", "pagination", "byline", "tags"]
#: Words that a block with text costs; words that a block of no article text costs at least.
BLOCK_COST, PART_COST = 1, 10
#: Fixed values of HTML: named references, each with its character; the ampersand's comes last.
NAMED = {"nbsp": " ", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "copy": "©", "reg": "®", "middot": "·", "mdash": "—", "ndash": "–", "hellip": "…", "laquo": "«", "raquo": "»", "lsquo": "‘", "rsquo": "’", "ldquo": "“", "rdquo": "”", "bull": "•", "amp": "&"}

_SPACE = r"[ \t\n\r\f]+"
_CUT = "\x01"


def without(html: Column, opens: str, closes: str) -> Column:
    """html less all from each match of opens to the next match of closes, or to the end."""
    kept = lambda x, i: F.when(i == 0, x).otherwise(F.coalesce(F.get(F.split(x, closes, 2), F.lit(1)), F.lit("")))
    return F.array_join(F.transform(F.split(html, opens), kept), " ")


def without_element(html: Column, tag: str) -> Column:
    return without(html, rf"(?i)<{tag}[ \t\n\r\f/>]", rf"(?i)</{tag}[^<>]*>")


def decoded(text: Column) -> Column:
    """Character references as characters, numeric ones included; unknown ones stay. Each once: &amp;lt; is &lt;."""
    def one(x: Column, i: Column) -> Column:
        code = F.regexp_extract(x, r"^(x[0-9a-fA-F]{1,6}|[0-9]{1,7});", 1)
        value = F.when(code.startswith("x"), F.conv(F.substring(code, 2, 6), 16, 10)).otherwise(code).try_cast("int")
        known = (code != "") & value.between(1, 0x10FFFF) & ~value.between(0xD800, 0xDFFF)
        sign = F.decode(F.unhex(F.lpad(F.hex(value), 8, "0")), "UTF-32")
        # of what follows only the ampersand's reference could be read again
        return F.when(i == 0, x).when(known, F.concat(F.when(value == 38, F.lit("&amp;")).otherwise(sign), F.substring(x, F.length(code) + 2, F.length(x)))).otherwise(F.concat(F.lit("&#"), x))

    out = F.array_join(F.transform(F.split(text, "&#(?=x?[0-9a-fA-F])"), one), "")
    for name, sign in NAMED.items():
        out = F.replace(out, F.lit(f"&{name};"), F.lit(sign))
    return out


def _plain(block: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(block, "<[^<>]*>", ""), _SPACE, " "))


def _words(text: Column) -> Column:
    return F.when(text == "", 0).otherwise(F.length(text) - F.length(F.replace(text, F.lit(" "))) + 1)


def best_run(scores: Column) -> Column:
    """(sum, first, last) of the run of array elements with the greatest sum above 0; of equals the one that ends last, of those the longest. Places count from 0; first is -1 for none."""
    start = F.struct(F.lit(0).alias("sum"), F.lit(-1).alias("first"), F.lit(-1).alias("last"), F.lit(0).alias("now"), F.lit(0).alias("since"), F.lit(0).alias("at"))

    def step(a: Column, x: Column) -> Column:
        fresh = a["now"] < 0
        now, since = F.when(fresh, x).otherwise(a["now"] + x), F.when(fresh, a["at"]).otherwise(a["since"])
        better = (now >= a["sum"]) & (now > 0)
        pick = lambda new, old: F.when(better, new).otherwise(a[old])
        return F.struct(pick(now, "sum").alias("sum"), pick(since, "first").alias("first"), pick(a["at"], "last").alias("last"), now.alias("now"), since.alias("since"), (a["at"] + 1).alias("at"))

    return F.aggregate(scores, start, step, lambda a: F.struct(a["sum"], a["first"], a["last"]))


def main_texts(pages: DataFrame, html: str, out: str = "text") -> DataFrame:
    """pages with out, the main text of each page; empty if none."""
    clean = without(F.coalesce(F.col(html), F.lit("")), "<!--", "-->")
    for tag in DROPPED:
        clean = without_element(clean, tag)
    parted = F.split(F.regexp_replace(clean, rf"(?i)(</?(?:{'|'.join(BLOCKS)})(?:[ \t\n\r\f/][^<>]*)?>)", _CUT + "$1"), _CUT)
    # each step a column of its own, or Spark would write it out again wherever it is used
    df = pages.withColumn("__parts", parted)
    named = r"""(?i)^<[a-z0-9]+ [^<>]*(?:class|id|role)=(?:"[^"<>]*|'[^'<>]*|[^ <>"']*)(?:\b|_)(?:%s)(?:\b|_)""" % "|".join(PARTS)
    df = df.withColumn("__blocks", F.transform("__parts", lambda x: F.struct(_plain(x).alias("t"), _plain(without(x, r"(?i)<a[ \t\n\r\f>]", "(?i)</a[^<>]*>")).alias("free"), x.rlike(named).alias("odd"))))
    score = F.transform("__blocks", lambda b: F.when(b["odd"], -F.greatest(F.lit(PART_COST), _words(b["t"]))).otherwise(2 * _words(b["free"]) - _words(b["t"]) - F.when(b["t"] == "", 0).otherwise(BLOCK_COST)))
    df = df.withColumn("__run", best_run(score))
    run = F.when(F.col("__run.first") >= 0, F.slice("__blocks", F.col("__run.first") + 1, F.col("__run.last") - F.col("__run.first") + 1)).otherwise(F.slice("__blocks", 1, 0))
    text = F.array_join(F.filter(F.transform(run, lambda b: F.when(b["odd"], "").otherwise(F.trim(F.regexp_replace(decoded(b["t"]), _SPACE, " ")))), lambda t: t != ""), "\n")
    return df.withColumn(out, text).drop("__parts", "__blocks", "__run")
