"""Joins that avoid listing pairs, and texts of pages, against plain loops."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from gleaner.operators import automaton, changes, evidence, intake, linking, tolerance, verify
from gleaner.sources import pages, readers

# tolerances -----------------------------------------------------------------------------------------------------------------


def near(g, v):
    return abs(g - v) <= max(0.15, abs(v) * 0.005)


@pytest.mark.parametrize("seed", range(3))
def test_tolerance_joins_equal_the_plain_test(spark, seed):
    rng = random.Random(seed)
    scale = lambda: rng.choice((0.1, 1, 30, 30.1, 1e3, 1e9)) * rng.choice((-1, 1))
    values = [(rng.randrange(3), round(rng.random() * scale(), 3)) for _ in range(400)] + [(0, 0.0), (0, None), (1, float("nan")), (1, 1e300), (2, 29.85), (2, 30.15)]
    numbers = [(k, v * rng.choice((1, 1.005, 0.995, 1.0051, 0.9949)) + rng.choice((0, 0.15, -0.15, 0.1501))) for k, v in values if v is not None and v == v] + [(0, None), (0, 0.15), (2, 30.0)]
    v, n = spark.createDataFrame(values, "k int, g double"), spark.createDataFrame(numbers, "k int, v double")
    usable = [(k, g) for k, g in values if g is not None and g == g]
    want = {(k, x, g) for k, x in numbers if x is not None for j, g in usable if j == k and near(g, x)}
    assert {tuple(r) for r in tolerance.pairs(n, v, ["k"], "v", "g").select("k", "v", "g").collect()} == want
    hits = tolerance.matches(n.withColumn("i", F.monotonically_increasing_id()), v, ["k"], "v", "g")
    assert {tuple(r) for r in hits.filter("hit").select("k", "v").collect()} == {(k, x) for k, x, _ in want}
    assert hits.select("i").distinct().count() == len(numbers) and hits.count() <= 3 * len(numbers)


def test_a_hot_key_lists_no_pairs(spark):
    values = spark.range(20_000).select(F.lit("hot").alias("k"), (F.col("id") / 1000).alias("g"))
    numbers = values.withColumnRenamed("g", "v")
    met = tolerance.number_bands(numbers, "v").join(tolerance.value_bands(values, "g").groupBy("k", "at").agg(F.min("g")), ["k", "at"])
    assert met.count() <= 3 * 20_000 and tolerance.matches(numbers, values, ["k"], "v", "g").filter("hit").select("v").distinct().count() == 20_000


def test_no_arrays_by_key_in_number_checks(spark):
    s = spark.createDataFrame([(1, 0, "up 5.1 to 7"), (1, 1, "by 9")], "k int, pos int, s string")
    e = spark.createDataFrame([(1, 5.0), (1, 7.1)], "k int, v double")
    out = verify.backed_sentences(s, e, "k", "s", "v")
    assert sorted(map(tuple, out.collect())) == [(1, 0, 2, 2, True), (1, 1, 1, 0, False)]
    plans = out._jdf.queryExecution().toString() + verify.bound(s.select("k", F.lit("5").alias("number")), e.select("k", F.col("v").cast("string").alias("number"), F.lit("id").alias("evidence_id")), "k")._jdf.queryExecution().toString()
    assert "Cartesian" not in plans and "exists(" not in plans


# best titles ----------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("seed", range(4))
def test_best_titles_equal_the_full_listing(spark, seed):
    rng = random.Random(seed)
    words = ["iran", "common", "often", "the"] + [f"word{chr(97 + i)}" for i in range(12)]
    text = lambda n: " ".join(rng.choices(words, [2, 20, 12, 5] + [2] * 12, k=n))
    statements = list({text(rng.choice((1, 3, 6))) for _ in range(25)} | {"nothing shared whatsoever"})
    titles = [(text(rng.choice((1, 2, 4, 7))), rng.choice((None, *range(30)))) for _ in range(120)]
    own = lambda t: set(re.findall("[a-z]{3,}", t.lower())) - set(linking.NEWS_STOP)
    first = {}
    for t, d in titles:
        known = [x for x in (first.get(t), d) if x is not None]
        first[t] = min(known) if known else None
    want = set()
    for s in statements:
        scored = []
        for t, d in first.items():
            score = len(own(s) & own(t)) + (2 if "iran" in t else 0)
            if score >= 2:
                scored.append((-score, d is not None, d or 0, t))
        want |= {(s, t, -n, i) for i, (n, _, _, t) in enumerate(sorted(scored)[:6], 1)}
    got = linking.news_scores(spark.createDataFrame([(s,) for s in statements], "statement string"), spark.createDataFrame(titles, "title string, dt int"))
    assert {tuple(r) for r in got.collect()} == want


def test_openings_against_the_last_of_others(spark):
    rng = random.Random(2)
    posts = [(i, rng.choice((1, 1, 1, 2, 3)), " ".join(rng.choice("abcd") for _ in range(rng.choice((2, 5, 9))))) for i in range(90)]

    def grams(t):
        w = t.split()[:12]
        return {" ".join(w[i : i + 3]) for i in range(len(w) - 2)}

    want = {}
    for i, p, t in posts:
        others = sorted(x for x in posts if x[1] != p)[-20:]
        want[i] = max([0.0, *(len(grams(t) & grams(o[2])) / len(grams(t) | grams(o[2])) for o in others if grams(t) and grams(o[2]))])
    df = spark.createDataFrame(posts, "k int, p int, t string").withColumn("o", F.col("k"))
    got = linking.opening_similarity_to_others(df, df, "p", "k", "t", "o", "[a-z]+")
    assert {r.k: round(r.similarity, 9) for r in got.collect()} == {k: round(v, 9) for k, v in want.items()}


# many labels ----------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("block", [1 << 20, 20_000])
def test_ten_thousand_labels(spark, block, monkeypatch):
    monkeypatch.setattr(automaton, "BLOCK_BYTES", block)
    rng = random.Random(1)
    labels = [f"label {i} of {rng.randrange(100)}" + (" (dollars)" if i % 3 == 0 else "") for i in range(10_000)] + ["abc", "", None, "(only)", "çédille é"]
    posts = [(i, " ".join(rng.choice(labels[:-5]).replace(" (dollars)", rng.choice(("", " (dollars)"))) + rng.choice(("", " 12", " and a long way off from any figure at all, as it were")) for _ in range(4)) + " çédille é") for i in range(40)] + [(99, None), (98, "")]
    want = set()
    for k, text in posts:
        for label in labels:
            if label is None or not text:
                continue
            whole, base = label.strip(), re.sub(r"\s*\([^)]*\)\s*", "", label).strip()
            hit = whole if len(whole) >= 4 and whole in text else base if len(base) >= 4 and base in text else None
            if hit:
                at = text.index(hit)
                want.add((k, whole, bool(re.search("[0-9۰-۹]", text[max(0, at - 40) : at + len(hit) + 40]))))
    df = spark.createDataFrame(posts, "k int, t string").repartition(3)
    got = intake.mentions(df, spark.createDataFrame([(x,) for x in labels], "label string"), "k", "t", "label")
    assert {tuple(r) for r in got.collect()} == want and "Cartesian" not in got._jdf.queryExecution().toString() and "NestedLoop" not in got._jdf.queryExecution().toString()


def test_no_labels_or_posts(spark):
    none = spark.createDataFrame([], "label string")
    assert not intake.mentions(spark.createDataFrame([(1, "x")], "k int, t string"), none, "k", "t", "label").count()
    assert not intake.mentions(spark.createDataFrame([], "k int, t string"), spark.createDataFrame([("label",)], "label string"), "k", "t", "label").count()


# changes --------------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("short", [0, 64])
def test_nearest_changes_equal_the_listing(seed, short, monkeypatch):
    monkeypatch.setattr(changes, "SHORT", short)
    rng = random.Random(seed)
    values = [rng.choice((None, 0.0, rng.randrange(-5, 6) / 2, rng.random() * 100, 7.0)) for _ in range(60)]
    wanted = [rng.choice((0.0, 100.0, -100.0, rng.uniform(-300, 300), 14.2857)) for _ in range(40)]
    points = [v for v in values if v is not None]
    listed = [(b - a) / abs(a) * 100 for i, a in enumerate(points) for b in points[i + 1 :] if a != 0 and b != a]
    for p, (below, above) in zip(wanted, changes.nearest_changes(values, wanted), strict=True):
        assert below == max((c for c in listed if c <= p), default=None) and above == min((c for c in listed if c >= p), default=None)
    assert changes.nearest_changes([], [1.0]) == [(None, None)] and changes.nearest_changes([1.0, 1.0], [0.0]) == [(None, None)]


def test_long_series_take_no_square():
    rng = random.Random(3)
    took = []
    for n in (5_000, 40_000):
        values = [rng.random() * 1000 + 1 for _ in range(n)]
        began = time.process_time()
        changes.nearest_changes(values, [12.5, -3.0])
        took.append(time.process_time() - began)
    assert took[1] < 8 * 3 * took[0] + 1  # eight times the points; the square would be 64 times


def test_changes_bind_as_the_index_does(spark):
    rng = random.Random(4)
    series = spark.createDataFrame([(k, f"s{s}", str(2000 + y), round(rng.uniform(-50, 400), 2)) for k in (1, 2) for s in range(3) for y in range(12)], "k int, evidence_id string, period string, value double")
    numbers = spark.createDataFrame([(k, f"{rng.uniform(-120, 400):.{d}f}{p}") for k in (1, 2) for d in (0, 1, 2) for p in ("", "%") for _ in range(15)] + [(1, "abc")], "k int, number string").distinct()
    got = {tuple(r) for r in changes.bound_changes(numbers, series, "k").collect()}
    # the listing: an index of nothing but changes
    texts = series.select("k", "evidence_id", F.lit("").alias("text")).limit(0)
    points = {(r.k, r.evidence_id, n) for r in series.collect() for n in (r.period, f"{r.value:.6f}".rstrip("0").rstrip("."))}
    listed = [r for r in verify.evidence_index(texts, series, "k").collect() if (r.k, r.evidence_id, r.number) not in points]
    want = {(r.k, r.number, i.evidence_id) for r in numbers.collect() if r.number != "abc" for i in listed if i.k == r.k and near(float(i.number), float(r.number.rstrip("%")))}
    assert got == want and got


# classes --------------------------------------------------------------------------------------------------------------------


def test_classes_expand_to_all_links(spark):
    rng = random.Random(6)
    topics = spark.createDataFrame([(i, t) for i in range(120) for t in rng.sample(["generic", "a", "b", "c", "d"], rng.choice((1, 1, 2)))], "problem_id int, topic string")
    members, linked = evidence.topic_classes(topics, ["generic"])
    pairs = {(r.a, r.b, r.score) for r in evidence.topic_links(topics, ["generic"]).collect()}
    assert linked.agg(F.sum("links")).first()[0] == len(pairs) and linked.count() < len(pairs) / 10
    asked = spark.createDataFrame([(i,) for i in range(0, 120, 50)], "problem_id int")
    got = {tuple(r) for r in evidence.topic_links_of(asked, members, linked).collect()}
    assert got == {(a, b, s) for x, y, s in pairs for a, b in ((x, y), (y, x)) if a % 50 == 0}


# pages ----------------------------------------------------------------------------------------------------------------------

PAGE = """<html><head><title>T</title><script>var t="</p><p>never</p>";</script></head><body><nav><ul><li><a href=x>Home page of the site</a></li></ul></nav><!-- <p>not this text at all either</p> -->
<div class="ad">Buy this thing now it is so very cheap today</div><div><p>The first paragraph has words enough &amp;lt; to count.</p><p>And a <a href=y>short link</a> within the second paragraph of text.</p><table><tr><td>cells of a table</td></tr></table>
<p>Ends &#8212; &#x41;&nbsp;here.</p></div><div><a href=z>One more link</a> <a href=w>and another link to click on</a></div><footer>Imprint and legal words of the publishing house</footer></body></html>"""


def test_main_text_of_a_page(spark):
    df = spark.createDataFrame([(1, PAGE), (2, None), (3, ""), (4, "plain words only"), (5, "<p>cut <b"), (6, "<nav>all menu</nav>")], "k int, h string").withColumn("__x", F.lit(1))
    got = {r.k: r.text for r in pages.main_texts(df, "h").collect()}
    assert got[1] == "The first paragraph has words enough &lt; to count.\nAnd a short link within the second paragraph of text.\nEnds — A here."
    assert got[2] == got[3] == got[6] == "" and got[4] == "plain words only" and got[5].startswith("cut")
    assert pages.main_texts(df, "h").columns == ["k", "h", "__x", "text"]


@pytest.mark.parametrize("seed", range(3))
def test_best_run_equals_all_runs(spark, seed):
    rng = random.Random(seed)
    rows = [(i, [rng.randrange(-4, 5) for _ in range(rng.randrange(9))]) for i in range(80)]
    got = {r.i: tuple(r.x) for r in spark.createDataFrame(rows, "i int, s array<int>").select("i", pages.best_run(F.col("s")).alias("x")).collect()}
    for i, s in rows:
        runs = [(sum(s[a : b + 1]), b, b - a, a) for a in range(len(s)) for b in range(a, len(s))]
        top = max(runs, default=(0, 0, 0, 0))
        assert got[i] == ((top[0], top[3], top[1]) if top[0] > 0 else (0, -1, -1)), (s, got[i])


def test_markup_takes_time_in_proportion(spark):
    n = 40_000
    odd = ["<script>" * n, "<nav" * n, "<!-- " * n, "<p " * n, "<div><a>" * n, "< a > b" * n, "&#6" * n]
    took = []
    for part in (4, 1):
        df = spark.createDataFrame([(i, x[: len(x) // part]) for i, x in enumerate(odd)], "k int, h string")
        began = time.perf_counter()
        pages.main_texts(df, "h").select(F.sum(F.length("text"))).collect()
        took.append(time.perf_counter() - began)
    assert took[1] < 4 * 4 * took[0] + 5


def test_articles_once_per_content(spark):
    long = "word " * 60
    df = spark.createDataFrame([(1, "b", f"<p>{long}</p>"), (2, "a", f"<div>{long.upper()}</div>"), (3, "c", "<p>short</p>")], "k int, url string, h string")
    assert [r.k for r in readers.articles(pages.main_texts(df, "h"), "text", "url", key="k").collect()] == [2]
