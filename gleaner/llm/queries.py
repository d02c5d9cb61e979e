"""The opN_<name> queries, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm import class_lm, html_main, line_quality, nbsvm, packing, positional_index, ranked_search, sharding, simhash, suffix_dedup, toxicity, vector_codes, warc
from gleaner.llm.common import table


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nbsvm.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.round_trip(spark, table(spark, sf_dir, "pages"))
    return found.select(F.col("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to", "intact", "chunks")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.fingerprint_components(table(spark, sf_dir, "documents"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeated_passages(table(spark, sf_dir, "documents"))


def op6_html_main(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_main.extract(table(spark, sf_dir, "pages"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return positional_index.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_quality.judge(table(spark, sf_dir, "documents"))


def op10_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return class_lm.train_and_score(table(spark, sf_dir, "documents"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.encode(table(spark, sf_dir, "embeddings"))


def op12_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_quality, op2_warc, op3_packing, op4_simhash, op5_suffix_dedup, op6_html_main, op7_decontaminate, op8_toxicity, op9_line_quality, op10_class_lm, op11_vector_codes, op12_sharding, op13_ranked_search]
    return {f.__name__: f for f in found}


_ASCII_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_SQL = {
    "op2_warc": r"""WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages),
b AS (SELECT *, list_transform(range(40), lambda i: strpos('0123456789abcdef', hex[i + 1]) - 1) AS nibble FROM p),
d AS (SELECT page_id, payload_bytes, array_to_string(list_transform(range(32), lambda k: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[
  CAST((((nibble[(5 * k) // 4 + 1] * 256 + coalesce(nibble[(5 * k) // 4 + 2], 0) * 16 + coalesce(nibble[(5 * k) // 4 + 3], 0)) // CAST(pow(2, 7 - (5 * k) % 4) AS BIGINT)) % 32) + 1 AS INT)]), '') AS payload_digest FROM b),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS first FROM d)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to, true AS intact,
  CASE WHEN page_id <> first THEN 1 ELSE greatest(1, (payload_bytes + 16383) // 16384) END AS chunks FROM m""",
    "op5_suffix_dedup": """WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, unnest(range(greatest(length(h) // 2 - 49, 0))) AS p, unnest(list_transform(range(greatest(length(h) // 2 - 49, 0)), lambda i: h[2 * i + 1:2 * i + 100])) AS gram FROM d),
hit AS (SELECT doc_id, p FROM (SELECT doc_id, p, min(doc_id) OVER (PARTITION BY gram) AS first FROM w) WHERE first < doc_id),
step AS (SELECT *, CASE WHEN p > lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 50 THEN 1 ELSE 0 END AS new FROM hit),
run AS (SELECT doc_id, k, min(p) AS s, max(p) + 50 AS e FROM (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY p) AS k FROM step) GROUP BY 1, 2),
cut AS (SELECT *, lag(e, 1, 0) OVER (PARTITION BY doc_id ORDER BY s) AS before FROM run),
gone AS (SELECT c.doc_id, sum(e - s) AS n, count(*) AS spans, string_agg(substr(h, 2 * before + 1, 2 * (s - before)), '' ORDER BY s) || substr(any_value(h), 2 * max(e) + 1) AS kept FROM cut c JOIN d USING (doc_id) GROUP BY 1)
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, coalesce(spans, 0) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256 FROM d LEFT JOIN gone USING (doc_id)""",
    "op7_decontaminate": r"""WITH d AS (SELECT doc_id, regexp_extract_all(LOWERED, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents), b AS (SELECT item_id, regexp_extract_all(LOWERED, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
g AS (SELECT DISTINCT item_id, least(len(w), 13) AS size, unnest(list_transform(range(greatest(len(w) - 12, 1)), lambda i: array_to_string(w[i + 1:i + 13], ' '))) AS gram FROM b WHERE len(w) > 0),
s AS (SELECT DISTINCT size FROM g),
x AS (SELECT doc_id, size, unnest(range(greatest(len(w) - size + 1, 0))) AS pos, unnest(list_transform(range(greatest(len(w) - size + 1, 0)), lambda i: array_to_string(w[i + 1:i + size], ' '))) AS gram FROM d, s),
h AS (SELECT doc_id, item_id, pos, size FROM x JOIN g USING (size, gram)),
c AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(pos, pos + size)) AS p FROM h) GROUP BY 1),
i AS (SELECT doc_id, count(*) AS n_items, string_agg(k, ',' ORDER BY k) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS k FROM h) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated FROM d LEFT JOIN c USING (doc_id) LEFT JOIN i USING (doc_id)""".replace("LOWERED", _ASCII_LOWER),
    "op9_line_quality": r"""WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents),
tri AS (SELECT doc_id, unnest(range(greatest(len(w) - 2, 0))) AS pos, unnest(list_transform(range(greatest(len(w) - 2, 0)), lambda i: w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3])) AS g FROM d),
twice AS (SELECT doc_id, pos FROM tri QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([pos, pos + 1, pos + 2]) AS p FROM twice) GROUP BY 1),
raw AS (SELECT doc_id, source, list_filter(list_transform(string_split(lower(t), chr(10)), lambda x: trim(regexp_replace(x, '[\x20\x09-\x0D]+', ' ', 'g'), ' ')), lambda x: x <> '') AS ls FROM d),
whole AS (SELECT *, array_to_string(ls, chr(10)) AS body FROM raw),
line AS (SELECT doc_id, source, body, x, length(x) - length(replace(x, ' ', '')) + 1 AS words FROM (SELECT doc_id, source, body, unnest(ls) AS x FROM whole)),
host AS (SELECT source, count(DISTINCT body) AS docs FROM whole GROUP BY 1),
freq AS (SELECT s.source, x FROM (SELECT source, x, count(DISTINCT body) AS n FROM line GROUP BY 1, 2) s JOIN host h ON s.source IS NOT DISTINCT FROM h.source WHERE n > 20 AND n > 0.05 * docs),
gone AS (SELECT doc_id, sum(words) AS n FROM line l WHERE EXISTS (FROM freq f WHERE f.x = l.x AND f.source IS NOT DISTINCT FROM l.source) GROUP BY 1),
base AS (SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars, CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
  coalesce(rep.n, 0) AS n_repeat_words, least(coalesce(gone.n, 0), len(w)) AS removed_words FROM d LEFT JOIN rep USING (doc_id) LEFT JOIN gone USING (doc_id)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM base)
SELECT *, NOT base_failed AND NOT (n_words - removed_words < 25 AND n_words - removed_words < 0.2 * n_words) AS kept FROM f""",
}




def _code_rounds(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """op11's rounds in SQL, written out one after another."""
    nearest = """a{r} AS MATERIALIZED (SELECT rid, p, any_value(v) AS v, arg_min(e, (d, e)) AS e, min(d) AS d FROM (
  SELECT rid, a.p, v, e, CAST(list_sum(list_transform(range(1, len(v) + 1), lambda i: (v[i] - c[i]) * (v[i] - c[i]))) AS BIGINT) AS d FROM part a JOIN b{r} USING (p)) GROUP BY rid, p)"""
    moved = """b{n} AS MATERIALIZED (SELECT b.p, b.e, coalesce(m.c, b.c) AS c FROM b{r} b LEFT JOIN (
  SELECT p, e, list((s - ((s % n) + n) % n) // n ORDER BY i) AS c FROM (SELECT p, e, i, CAST(sum(v[i]) AS BIGINT) AS s, count(*) AS n FROM a{r}, (SELECT unnest(range(1, (SELECT max(len(v)) FROM part) + 1)) AS i) GROUP BY p, e, i) GROUP BY p, e) m USING (p, e))"""
    steps = [(nearest + ",\n" + moved).format(r=r, n=r + 1) for r in range(rounds)] + [nearest.format(r=rounds)]
    return f"""WITH kept AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id, embedding) AS rid, vec_id, label, list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
part AS MATERIALIZED (SELECT rid, p, q[p * len(q) // {parts} + 1:(p + 1) * len(q) // {parts}] AS v FROM kept, (SELECT unnest(range({parts})) AS p)),
b0 AS MATERIALIZED (SELECT p, rid - 1 AS e, v AS c FROM part WHERE rid <= {entries}),
{",\n".join(steps)},
books AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b{rounds}),
coded AS (SELECT rid, string_agg(lpad(to_hex(e), 2, '0'), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{rounds} GROUP BY rid)
SELECT vec_id, lower(code) AS code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM coded JOIN kept USING (rid), books"""


_SQL["op11_vector_codes"] = _code_rounds()
_SQL["op13_ranked_search"] = r"""WITH d AS MATERIALIZED (SELECT row_number() OVER () AS row, doc_id, unnest(regexp_extract_all(LOWERED, 'TERM')) AS t FROM documents),
tf AS MATERIALIZED (SELECT row, t, count(*) AS tf FROM d GROUP BY 1, 2), doc AS (SELECT row, any_value(doc_id) AS doc_id, count(*) AS n FROM d GROUP BY 1),
size AS (SELECT count(*) AS N_, CAST(sum(n) AS BIGINT) AS L FROM doc), df AS (SELECT t, count(*) AS df FROM tf GROUP BY 1),
q AS (SELECT item_id, t, count(*) AS times FROM (SELECT item_id, unnest(regexp_extract_all(LOWERED, 'TERM')) AS t FROM benchmark) GROUP BY 1, 2),
w AS (SELECT item_id, t, times * CAST(floor(1000 * ln((2 * N_ + 2) / (2 * df + 1))) AS BIGINT) AS w FROM q JOIN df USING (t), size),
s AS (SELECT item_id, row, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * N_) // L)))) AS BIGINT) AS score FROM w JOIN tf USING (t) JOIN doc USING (row), size GROUP BY 1, 2)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank, doc_id, score FROM s JOIN doc USING (row) WHERE score > 0 QUALIFY rank <= 20""".replace("LOWERED", _ASCII_LOWER).replace("TERM", r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def oracle_sql() -> dict[str, str]:
    """SQL for the queries whose method SQL can express; the others are tested against brute force."""
    return dict(_SQL)
