"""Quality rules over lines (native): cross-document line frequency within a host, and base text statistics.

Only DataFrame and SQL functions run here. A line is normalised (lower case, white space collapsed), hashed and counted
over the distinct documents of its host; lines above the limit are boilerplate and are removed; a document which
keeps too little of its words is depleted and rejected.

What counts as a distinct document: documents of a host whose normalised lines are all the same, in the same order, count
once, for a line as for the host's share. A group of copies of a good text therefore isn't taken for boilerplate; texts
that differ in any word count each, and removing near copies is the task of deduplication.

Defined cases: a null or empty text has no words and fails the base rule (fewer than 50 words); a null host is a
host of its own; repeated rows are judged alike and all returned; extra columns, whatever their names, are ignored by ``judge``
and kept by ``keep``; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import broadcast_if_small, check_columns, numbered, staged

_WHITE = " \t\n\x0b\x0c\r"
_SYMBOLS = "#*$%&|<>"
#: Up to so many flagged lines are broadcast (16 bytes each), more are joined by a shuffle.
BROADCAST_LINES = 100_000

_KEY = ("__id", "__sha")


def _deleted(text: Column, chars: str) -> Column:
    return F.translate(text, chars, "")


def base_columns(df: DataFrame, text: Column) -> DataFrame:
    """Add __n_words, __word_chars, __n_symbols, __n_dup_lines, __n_repeat_words (all long)."""
    trimmed = F.btrim("__text", F.lit(_WHITE))
    df = df.withColumn("__text", F.coalesce(text, F.lit("")))
    df = df.withColumn("__w", F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, "[\\x20\\x09-\\x0D]+")))
    df = df.withColumn("__lines", F.filter(F.split("__text", "\n"), lambda x: _deleted(x, _WHITE) != ""))
    df = df.withColumn(
        "__h",
        F.expr("CASE WHEN size(__w) < 3 THEN CAST(array() AS array<bigint>) ELSE transform(sequence(0, size(__w) - 3), i -> xxhash64(__w[i], __w[i + 1], __w[i + 2])) END"),
    )
    # 40 bits of the window's hash and 24 of its place sort together as one long
    df = df.withColumn("__p", F.expr("sort_array(transform(__h, (x, i) -> (x & -16777216L) | i))"))
    df = df.withColumn(
        "__d",
        F.expr("filter(__p, (x, i) -> (i > 0 AND ((x ^ __p[greatest(i - 1, 0)]) & -16777216L) = 0) OR (i < size(__p) - 1 AND ((x ^ __p[least(i + 1, size(__p) - 1)]) & -16777216L) = 0))"),
    )
    # where two windows share 40 bits but not 64, or places need more bits, the places come from sorted structs
    odd = "size(__h) > 16777215 OR exists(sequence(1, greatest(size(__d) - 1, 1)), i -> i < size(__d) AND ((__d[least(i, size(__d) - 1)] ^ __d[i - 1]) & -16777216L) = 0 AND __h[CAST(__d[least(i, size(__d) - 1)] & 16777215L AS INT)] != __h[CAST(__d[i - 1] & 16777215L AS INT)])"
    df = df.withColumn("__s", F.expr(f"CASE WHEN {odd} THEN array_sort(transform(__h, (x, i) -> struct(x AS h, CAST(i AS BIGINT) AS i))) ELSE CAST(array() AS array<struct<h: bigint, i: bigint>>) END"))
    exact = "transform(filter(__s, (x, i) -> (i > 0 AND x.h = __s[greatest(i - 1, 0)].h) OR (i < size(__s) - 1 AND x.h = __s[least(i + 1, size(__s) - 1)].h)), x -> x.i)"
    df = df.withColumn("__q", F.expr(f"sort_array(CASE WHEN size(__s) > 0 THEN {exact} ELSE transform(__d, x -> x & 16777215L) END)"))
    return df.withColumns(
        {
            "__n_words": F.size("__w").cast("long"),
            "__word_chars": F.length(_deleted(F.col("__text"), _WHITE)).cast("long"),
            "__n_symbols": (F.length("__text") - F.length(_deleted(F.col("__text"), _SYMBOLS))).cast("long"),
            "__n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
            "__n_repeat_words": F.expr("aggregate(transform(__q, (x, i) -> CASE WHEN i = 0 THEN 3L ELSE least(3L, x - __q[greatest(i - 1, 0)]) END), 0L, (a, x) -> a + x)"),
        }
    ).drop("__text", "__w", "__lines", "__h", "__p", "__d", "__s", "__q")


def _hashed(line: Column) -> Column:
    """60 bits of a line's MD5 digest, as any SQL engine can compute them."""
    return F.conv(F.substring(F.md5(line.cast("binary")), 1, 15), 16, 10).cast("long")


def lines_of(docs: DataFrame, text: str, host: str, doc_id: str) -> DataFrame:
    """(__id, __sha, __host, __at, __line, __words, __text): each normalised line of each document with its words and the hash of the whole normalised text.

    A document without lines has one row, with a null line, so that it counts for its host.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    df = docs.select(F.col(doc_id).alias("__id"), F.xxhash64(body).alias("__sha"), F.col(host).cast("string").alias("__host"), F.split(F.lower(body), "\n").alias("__raw"))
    clean = F.transform("__raw", lambda x: F.trim(F.regexp_replace(x, "[\\x20\\x09-\\x0D]+", " ")))
    kept = F.filter(clean, lambda x: x != "")
    df = df.withColumn("__ls", F.transform(kept, lambda x: F.struct(_hashed(x).alias("h"), (F.length(x) - F.length(_deleted(x, " ")) + 1).alias("n"))))
    df = df.withColumn("__whole", F.xxhash64(F.transform("__ls", lambda x: x["h"])))
    one = df.select(*_KEY, "__host", "__whole", F.posexplode_outer("__ls").alias("__at", "__l"))
    return one.select(*_KEY, "__host", "__at", F.col("__l.h").alias("__line"), F.col("__l.n").cast("long").alias("__words"), F.col("__whole").alias("__text"))


def frequent_lines(lines: DataFrame, min_docs: int, share: float) -> DataFrame:
    """(__host, __line) of lines in more than max(min_docs, share * the host's distinct documents) distinct documents."""
    docs_per_host = lines.select("__host", "__text").distinct().groupBy("__host").agg(F.count("*").alias("__docs"))
    counted = lines.filter("__line IS NOT NULL").select("__host", "__line", "__text").distinct().groupBy("__host", "__line").agg(F.count("*").alias("__n")).filter(F.col("__n") > min_docs)
    joined = counted.alias("c").join(docs_per_host.alias("d"), F.col("c.__host").eqNullSafe(F.col("d.__host")))
    return joined.filter(F.col("c.__n") > share * F.col("d.__docs")).select("c.__host", "c.__line")


def judge(
    docs: DataFrame,
    text: str = "text",
    host: str = "source",
    doc_id: str = "doc_id",
    min_docs: int = 20,
    share: float = 0.05,
    min_words: int = 50,
    max_repeat_percent: int = 50,
    min_kept_share: float = 0.2,
    min_kept_words: int = 25,
    keyed: bool = False,
) -> DataFrame:
    """Per row: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, removed_words, kept.

    ``kept`` is false where the base rule fails, or where frequent lines leave fewer than ``min_kept_words`` words and
    less than ``min_kept_share`` of all. With ``keyed`` only __id, __sha (of the text) and kept are returned.
    """
    check_columns(docs, text, host, doc_id)
    lines = staged(lines_of(docs, text, host, doc_id), "lines")
    flagged = staged(frequent_lines(lines, min_docs, share), "frequent-lines")
    some = F.broadcast(flagged) if flagged.count() <= BROADCAST_LINES else flagged
    hit = lines.alias("l").join(some.alias("f"), F.col("l.__host").eqNullSafe(F.col("f.__host")) & (F.col("l.__line") == F.col("f.__line")), "left_semi")
    removed = hit.select(*_KEY, "__at", "__words").distinct().groupBy(*_KEY).agg(F.sum("__words").alias("__sum"))
    given = docs.select(F.col(doc_id).alias("__id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("__sha"), F.col(text).alias("__body"))
    # a table: else filters on the result would be pushed into the scan with these expressions written out in full
    base = staged(base_columns(given, F.col("__body")).drop("__body"), "base")
    b, r = base.alias("b"), removed.alias("r")
    out = b.join(r, F.col("b.__id").eqNullSafe(F.col("r.__id")) & (F.col("b.__sha") == F.col("r.__sha")), "left")
    n, gone = F.col("b.__n_words"), F.least(F.coalesce(F.col("r.__sum"), F.lit(0)), F.col("b.__n_words"))
    failed = (n < min_words) | (100 * F.col("b.__n_repeat_words") > max_repeat_percent * n)
    depleted = (n - gone < min_kept_words) & (n - gone < min_kept_share * n)
    if keyed:
        return out.select("b.__id", "b.__sha", (~failed & ~depleted).alias("kept"))
    return out.select(
        F.col("b.__id").alias(doc_id),
        n.alias("n_words"),
        *[F.col(f"b.__{c}").alias(c) for c in ("word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        failed.alias("base_failed"),
        gone.alias("removed_words"),
        (~failed & ~depleted).alias("kept"),
    )


def keep(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", **how) -> DataFrame:
    """The rows of docs that the rules keep, with docs' own columns."""
    gone = staged(judge(docs, text=text, doc_id=doc_id, keyed=True, **how).filter(~F.col("kept")).select("__id", "__sha").distinct(), "rejected")
    plain, at = numbered(docs)
    same = F.col(at[doc_id]).eqNullSafe(F.col("__id")) & (F.xxhash64(F.coalesce(F.col(at[text]), F.lit(""))) == F.col("__sha"))
    return plain.join(broadcast_if_small(gone), same, "left_anti").toDF(*docs.columns)
