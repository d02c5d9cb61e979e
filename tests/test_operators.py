"""Operators on literal tables: evidence pairs, writes, series, matching, number checks, readers and streams."""

import datetime
import json
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gleaner.operators import common as C
from gleaner.operators import evidence as E
from gleaner.operators import matching as M
from gleaner.operators import picking as P
from gleaner.operators import series as S
from gleaner.operators import verify as V
from gleaner.sources import readers
from gleaner.streaming import ingest


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_insert_absent_is_idempotent(spark):
    old = spark.createDataFrame([(1, "a"), (2, None)], "id int, h string")
    new = spark.createDataFrame([(3, "a"), (4, "b"), (5, "b"), (6, None)], "id int, h string")
    first = C.insert_absent(new, old, ["h"], [F.asc("id")])
    assert rows(first) == [(4, "b")]
    assert rows(C.insert_absent(new, old.unionByName(first), ["h"])) == []


def test_latest_and_upsert(spark):
    df = spark.createDataFrame([("k", 1, "a"), ("k", 2, "b"), ("m", 1, "c")], "k string, n int, v string")
    assert rows(C.latest(df, ["k"], "n")) == [("k", 2, "b"), ("m", 1, "c")]
    assert rows(C.upsert(df, spark.createDataFrame([("k", 9, "z")], df.schema), ["k"])) == [("k", 9, "z"), ("m", 1, "c")]


def test_pairs(spark):
    f = spark.createDataFrame([(4, 1, "sanctions", "trade"), (4, 2, "sanctions", "growth"), (4, 3, None, "growth"), (5, 4, "x", "y")], "question_id int, finding_id int, intervention string, outcome string")
    assert rows(E.pairs_sharing(f, ["intervention", "outcome"])) == [(4, 1, 2), (4, 2, 3)]
    m = spark.createDataFrame([("GDP", "Iran", "2022", "WDI", 408.5), ("GDP", "Iran", "2024", "WDI", 401.4), ("GDP", "Iran", "2022", "IMF", 410.0)], "indicator string, subject string, period string, source string, value double")
    assert rows(E.cross_source_pairs(m)) == [("GDP", "Iran", "2022", "IMF", 410.0, "WDI", 408.5)]
    edges = spark.createDataFrame([(1, 9, 3), (1, 3, 9), (1, 3, 3)], "q int, a int, b int")
    assert rows(C.undirected(edges, "a", "b", ["q"])) == [(1, 3, 3), (1, 3, 9)]


def test_aliases(spark):
    e = spark.createDataFrame([(1, "United States", ["US", " usa "]), (2, "us", None)], "entity_id int, entity_name string, aliases array<string>")
    n = spark.createDataFrame([(" Us ",), ("USA",), ("nobody",)], "name string")
    assert rows(E.resolve_aliases(n, e)) == [(" Us ", 1), ("USA", 1), ("nobody", None)]


def test_value_bands(spark):
    n = spark.createDataFrame([(1.0,), (-0.01,), (5.0,)], "number double")
    v = spark.createDataFrame([(1.05,), (1.052,), (0.95,), (0.04,), (7.0,)], "value double")
    assert rows(E.value_bands(n, v)) == [(-0.01, 0.04), (1.0, 0.95), (1.0, 1.05)]


def _series(spark, data):
    out = [(f"{i}|{s}|{p}", i, s, "src", p, float(v), status, prov) for i, s, p, v, status, prov in data]
    return spark.createDataFrame(out, "measurement_id string, indicator string, subject string, source string, period string, value double, status string, provisional boolean")


def test_latest_readings_lose_projected_indicators(spark):
    m = _series(spark, [("a", "x", "2024", 1, "raw", False), ("a", "x", "2025", 2, "projection", False), ("b", "x", "2025", 3, None, False), ("b", "x", "2025-06", 4, "raw", False)])
    assert [(r.indicator, r.period) for r in S.latest_readings(m).collect()] == [("b", "2025-06")]
    assert sorted((r.indicator, r.period) for r in S.latest_readings(m, strict=True).collect()) == [("a", "2024"), ("b", "2025-06")]


def test_patterns(spark):
    m = _series(spark, [("c", "x", str(2020 + k), 5, "raw", False) for k in range(3)] + [("d", "x", str(2020 + k), v, "raw", False) for k, v in enumerate((1, 3, 2))] + [("e", "x", "2020", 0, "raw", False), ("e", "x", "2021", 1, "raw", False)])
    got = {r.indicator: (r.direction, r.pct_change) for r in S.patterns(m).collect()}
    assert got == {"c": ("increasing", 0.0), "d": ("mixed", 100.0), "e": ("increasing", None)}
    assert {r.indicator: r.direction for r in S.patterns(m, monotone=False).collect()} == {"c": "flat", "d": "increasing", "e": "increasing"}


def test_supersede(spark):
    old = spark.createDataFrame([("i", "2025", 1.0, True), ("j", "2025", 2.0, True), ("k", "2024", 3.0, False)], "indicator string, period string, value double, provisional boolean")
    new = spark.createDataFrame([("i", "2025", 1.0), ("j", "2025", 5.0), ("k", "2024", 9.0)], "indicator string, period string, value double")
    table, log = S.supersede(old, new, ["indicator", "period"])
    assert rows(table.select("indicator", "value", "provisional")) == [("i", 1.0, False), ("j", 5.0, False), ("k", 3.0, False)]
    assert rows(log) == [("j", "2025", 2.0, 5.0)]


def test_snapshot_changes(spark):
    d = lambda n: datetime.date(2024, 1, n)
    s = spark.createDataFrame([(1, "a", d(1), 10.0), (1, "a", d(2), 12.0), (1, "b", d(2), 1.0), (2, "a", d(1), 1.0)], "problem_id int, indicator string, taken_at date, value double")
    kinds = spark.createDataFrame([("a", "level", "good")], "indicator string, metric_kind string, polarity string")
    got = {(r.problem_id, r.indicator): (r.status, r.direction, r.verdict) for r in S.snapshot_changes(s, kinds).collect()}
    assert got == {(1, "a"): ("changed", "up", "improved"), (1, "b"): ("new", None, None), (2, "a"): ("new", None, None)}


words = st.lists(st.sampled_from("abcdefgh"), max_size=6).map(" ".join)


@settings(max_examples=8, deadline=None)
@given(st.lists(words, min_size=1, max_size=8), st.sampled_from([0.3, 0.5, 0.72, 1.0]))
def test_jaccard_pairs_are_exact(spark, texts, threshold):
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    sets = [set(t.split()) for t in texts]
    want = [(a, b, round(len(sets[a] & sets[b]) / len(sets[a] | sets[b]), 6)) for a in range(len(texts)) for b in range(a + 1, len(texts)) if sets[a] and sets[b] and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b])]
    assert rows(M.jaccard_pairs(df, "id", "t", "[a-z]+", threshold).withColumn("jaccard", F.round("jaccard", 6))) == want


def test_greedy_order_matters(spark):
    df = spark.createDataFrame([("g", 1, "a b c d"), ("g", 2, "a b c e"), ("g", 3, "a b c e f")], "g string, n int, t string")
    assert rows(P.greedy_distinct(df, ["g"], "n", "t", "[a-z]", 0.6)) == [("g", 1, True), ("g", 2, False), ("g", 3, True)]
    clusters = P.seed_clusters(spark.createDataFrame([("g", 1, "aaaa bbbb cccc"), ("g", 2, "zzzz"), ("g", 3, "aaaa bbbb cccc dddd"), ("g", 4, "dddd aaaa bbbb")], "g string, n int, t string"), ["g"], "n", "t", "[a-z]{4,}", 3)
    assert rows(clusters) == [("g", 1, 1), ("g", 3, 1)]


@pytest.mark.parametrize("draft,given_,bad", [("value 5", "in 2015", []), ("111.9", "111,928,863,188", []), ("56.4%", "۵۶.۵", []), ("77", "12", ["77"]), ("+3.5%", "3.5", []), ("0", "10", []), ("", "1", [])])
def test_number_check(spark, draft, given_, bad):
    d = spark.createDataFrame([(1, draft)], "k int, draft string")
    e = spark.createDataFrame([(1, given_)], "k int, given string")
    assert [r.number for r in V.unmatched(d, e, "k", "draft", "given").collect()] == bad
    assert V.verified(d, e, "k", "draft", "given").first()["ok"] == (not bad)


def test_readers(spark, tmp_path):
    wb = [{"page": 1}, [{"indicator": {"id": "X", "value": "GDP"}, "country": {"id": "IR", "value": "Iran"}, "date": "2023", "value": 109444045103.672}, {"indicator": {"id": "X", "value": "GDP"}, "country": {"id": "IR", "value": "Iran"}, "date": "2024", "value": None}]]
    (tmp_path / "wb.json").write_text(json.dumps(wb))
    assert rows(readers.world_bank(spark, str(tmp_path / "wb.json"), 2025)) == [("GDP", "Iran", "2023", 109444045103.672, "World Bank WDI", "historical")]
    (tmp_path / "imf.json").write_text(json.dumps({"values": {"NGDP": {"IRN": {"2025": 1.5, "2020": 2.0}}}}))
    assert [(r.period, r.vintage) for r in readers.imf(spark, str(tmp_path / "imf.json"), "NGDP", "IRN", 2025).orderBy("period").collect()] == [("2020", "historical"), ("2025", "projection")]
    (tmp_path / "o.csv").write_text("Entity,Code,Year,Yield,Yield__original_year\nIran,IRN,2020,1.5,2019\nIraq,IRQ,2020,9,\nIran,IRN,2021,,\n")
    assert [(r.period, r.value) for r in readers.owid(spark, str(tmp_path / "o.csv")).collect()] == [("2019", 1.5)]
    with pytest.raises(ValueError):
        readers.owid(spark, str(tmp_path / "o.csv"), "XXX", "Nowhere")
    work = {"id": "W1", "title": "T", "doi": "10.1/A", "publication_year": 2020, "abstract_inverted_index": {"world": [1], "hello": [0, 2]}, "authorships": [{"raw_author_name": "A", "institutions": [{"display_name": "I"}, {"display_name": "I"}], "countries": ["IR"]}]}
    (tmp_path / "w.json").write_text(json.dumps(work) + "\n" + json.dumps(work | {"id": "W2", "doi": None, "title": None}) + "\n")
    got = readers.merged_works([readers.works(spark, str(tmp_path / "w.json")), readers.works(spark, str(tmp_path / "w.json"), 1)]).collect()
    assert [(r.id, r.abstract, r.institutions, r.query_ix) for r in got] == [("W1", "hello world hello", ["I"], 0)]
    (tmp_path / "feed.xml").write_text("<rss><channel>" + "".join(f"<item><title>t  {i}</title><link>{'http://x/%d' % i if i else ''}</link><pubDate>Mon, 06 Jan 2025 10:00:00 GMT</pubDate></item>" for i in range(14)) + "</channel></rss>")
    feed = readers.feed_entries(spark, str(tmp_path / "feed.xml"))
    assert feed.count() == 10 and feed.first()["published"] == datetime.datetime(2025, 1, 6, 10) and feed.filter("title = 't 1'").count() == 1
    assert readers.recent(feed, "2025-02-20 00:00:00").count() == 0 and readers.recent(feed, "2025-01-20 00:00:00").count() == 10
    (tmp_path / "post.txt").write_text("ANGLE: an angle\nTLDR: short\nBody one.\n\nBody two.\n=== GATES ===\nok 1\n=== NOTE ===\nsee\n")
    p = readers.posts(spark, str(tmp_path / "post.txt")).first()
    assert (p.angle, p.tldr, p.glossary, p.body, p.gates, p.qc, p.note) == ("an angle", "short", None, "Body one.\n\nBody two.", "ok 1", None, "see")
    j = spark.createDataFrame([('```json\n{"a": 1}\n```',), ('noise {"a": 2} more',), ("none",)], "t string").select(readers.model_json(F.col("t"), "a int").alias("j"))
    assert [r.j and r.j.a for r in j.collect()] == [1, 2, None]
    assert [(r.name, r.tier) for r in readers.sources_config(spark, [{"name": "a", "reliability_tier": 1}, {"name": "b"}, {"name": "a", "reliability_tier": 5}, {"name": "c", "reliability_profile": {"tier": 2}}]).orderBy("name").collect()] == [("a", 1), ("b", 3), ("c", 2)]


def test_stream_ingest_is_idempotent(spark, tmp_path):
    land, table, check = (str(tmp_path / n) for n in ("land", "table", "check"))
    now = datetime.datetime(2025, 1, 1)
    batch = lambda r: spark.createDataFrame(r, ingest.ARTIFACT).write.mode("append").parquet(land)
    batch([(1, "s", "u1", "Hello  World", now), (2, "s", "u2", "hello world", now), (3, "s", "u3", "other", now)])
    ingest.ingest(spark, land, table, check).awaitTermination()
    assert spark.read.parquet(table).count() == 2
    batch([(4, "s", "u4", "OTHER", now), (5, "s", "u5", "third", now)])
    ingest.ingest(spark, land, table, check).awaitTermination()
    assert spark.read.parquet(table).count() == 3
    assert ingest.source_activity(spark, land).isStreaming


def test_containment_is_between_distinct_statements(spark):
    new = spark.createDataFrame([(1, "water policy reform"), (2, "water policy reform"), (3, "other")], "n long, text string")
    old = spark.createDataFrame([(7, "policy for water"), (8, "policy for water"), (9, "reform")], "o long, text string")
    got = rows(M.contained_classes(new, old, "n", "o", "text", "[a-z]{4,}", 0.5, "a", "b"))
    assert got == [(1, 7, 2 / 3, 2, 2)]


def test_topic_links_over_all_parts(spark, small):
    from gleaner.plans import catalogue
    from gleaner.plans.tables import Tables

    t = Tables(spark, small)
    brand = {r.p_partkey: r.p_brand for r in t.raw("part").collect()}
    topics: dict[int, set] = {}
    for r in t.raw("lineitem").select("l_suppkey", "l_partkey").distinct().collect():
        if r.l_partkey in brand:
            topics.setdefault(r.l_suppkey, set()).add(brand[r.l_partkey])
    weight = lambda x: 0.25 if x in ("Brand#1", "Brand#2") else 1.0
    want = []
    for a in topics:
        for b in topics:
            w = [weight(x) for x in topics[a] & topics[b]]
            if a < b and sum(w) >= 1 and max(w) >= 1:
                want.append((a, b, sum(w)))
    assert rows(catalogue.queries()["problem_topic_links"](spark, small)) == sorted(want, key=repr)


def test_articles_by_own_keywords(spark):
    topics = spark.createDataFrame([(1, "water drought policy in China"), (2, "urban housing prices"), (3, "of no use")], "p long, text string")
    texts = [(i, "Drought and WATERS" + " of china" * (i == 3)) for i in range(1, 9)] + [(20, "water alone"), (21, "Urban housing"), (23, "x" * 300 + " suburban, housing")]
    got = {tuple(r) for r in M.best_by_keywords(topics, spark.createDataFrame(texts, "a long, title string"), "p", "a", "text", "title", ["policy"]).select("p", "a", "hits").collect()}
    assert got == {(1, 3, 3), *((1, i, 2) for i in (8, 7, 6, 5, 4)), (2, 21, 2), (2, 23, 2)}


# sources -----------------------------------------------------------------------------------------------------------------


def test_atom_feeds(spark, tmp_path):
    (tmp_path / "atom.xml").write_text(
        '<feed xmlns="http://www.w3.org/2005/Atom"><title>f</title><entry><title> One  two </title><link rel="self" href="http://x/self"/><link rel="alternate" href="http://x/1"/><published>2024-05-01T10:00:00Z</published><summary>s</summary></entry>'
        '<entry><title>Three</title><link href="http://x/2"/><updated>2024-05-02T10:00:00Z</updated><content>c</content></entry><entry><title>no link</title></entry></feed>'
    )
    got = sorted((r["title"], r.url, str(r.published), r.description) for r in readers.feed_entries(spark, str(tmp_path / "atom.xml")).collect())
    assert got == [("One two", "http://x/1", "2024-05-01 10:00:00", "s"), ("Three", "http://x/2", "2024-05-02 10:00:00", "c")]


def test_world_bank_states_are_told_apart(spark, tmp_path):
    given_ = {"ok": [{"page": 1}, [{"date": "2023", "value": 1.5}, {"date": "2022", "value": None}]], "empty": [{"page": 1}, [{"date": "2023", "value": None}]], "none": [{"page": 1}, None]}
    for name, body in given_.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(body))
    (tmp_path / "down.json").write_text("<html>502 Bad Gateway</html>")
    got = {r.file.rsplit("/", 1)[1].split(".")[0]: (r.status, r.observations) for r in readers.world_bank_status(spark, str(tmp_path)).collect()}
    assert got == {"ok": ("ok", 1), "empty": ("no_observation", 0), "none": ("no_observation", 0), "down": ("source_unavailable", 0)}


def test_unsd_oecd_and_dispatch(spark, tmp_path):
    data = [{"geoAreaCode": "364", "value": "7.5", "timePeriod": "2021"}, {"geoAreaCode": "364", "value": "", "timePeriod": "2022"}, {"geoAreaCode": "4", "value": "1", "timePeriod": "2021"}, {"geoAreaCode": "364", "value": "8", "year": "2020"}]
    (tmp_path / "u.json").write_text(json.dumps({"data": data}))
    out = readers.read_source(spark, "unsd", path=str(tmp_path / "u.json"), indicator="6.4.2")
    assert [r[:5] for r in rows(out)] == [("SDG 6.4.2", "364", "2020", 8.0, "UNSD SDG"), ("SDG 6.4.2", "364", "2021", 7.5, "UNSD SDG")]
    assert readers.read_source(spark, "oecd").count() == 0
    with pytest.raises(ValueError, match="no reader"):
        readers.read_source(spark, "elsewhere")
    (tmp_path / "bad.json").write_text("not json")
    assert readers.unsd(spark, str(tmp_path / "bad.json"), "1").count() == 0
    found, failed = readers.bulk(spark, [{"source": "unsd", "label": "Water stress", "path": str(tmp_path / "u.json"), "indicator": "6.4.2"}, {"source": "owid", "label": "x", "path": str(tmp_path / "missing.csv")}, {"source": "nowhere", "label": "y"}])
    assert {r.indicator for r in found.collect()} == {"Water stress"} and [f[0] for f in failed] == ["owid", "nowhere"]


def test_series_by_domain(spark):
    s = spark.createDataFrame([("Women and unemployment",), ("Water policy",), ("nothing",)], "statement string")
    series = spark.createDataFrame([("labor", "a"), ("labor_gender", "b"), ("energy", "c"), ("other", "d")], "domain string, slug string")
    assert rows(readers.series_by_domain(s, series).select("statement", "slug")) == [("Water policy", "c"), ("Women and unemployment", "a"), ("Women and unemployment", "b")]


def test_semantic_works_and_news(spark, tmp_path):
    papers = [{"paperId": "p1", "title": "T", "abstract": "A", "year": 2020, "citationCount": 3, "externalIds": {"DOI": "10.1/X"}, "authors": [{"name": "N"}]}, {"paperId": "p2", "title": "T2", "abstract": None}, {"paperId": "p3", "title": " ", "abstract": "A"}]
    (tmp_path / "s2.json").write_text(json.dumps({"data": papers}))
    works = readers.semantic_works(spark, str(tmp_path / "s2.json"))
    assert [(r.id, r.doi, r.authors) for r in works.collect()] == [("p1", "10.1/x", ["N"])]
    assert readers.merged_works([works, works]).count() == 1
    frozen = readers.frozen(works.limit(0), works)
    assert frozen.count() == 1 and readers.frozen(works, works).count() == 1 and readers.frozen(works).count() == 1
    articles = [
        {"title": "a", "url": "u1", "domain": "x.com", "seendate": "20240101T000000Z", "language": "Persian"}, {"title": " b ", "url": "u2", "domain": "news.GOOD.org", "seendate": "20230101T000000Z", "language": "English"},
        {"title": "c", "url": "u3", "domain": "y.com", "seendate": "20240201T000000Z", "language": "English"}, {"title": "", "url": "u4"}, {"title": "d", "url": "u5", "domain": "y.com", "seendate": "never", "language": "English"},
    ]
    (tmp_path / "g.json").write_text(json.dumps({"articles": articles}))
    got = sorted((r.place, r["title"], r.preferred) for r in readers.news_search(spark, str(tmp_path / "g.json"), ["good.org"]).collect())
    assert got == [(1, "b", True), (2, "c", False), (3, "d", False), (4, "a", False)]
