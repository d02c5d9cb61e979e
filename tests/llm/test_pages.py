"""Web archives and main text."""

import base64
import hashlib
import io

import numpy as np
from gleaner.llm import html_main, warc

ROWS = [(1, "http://a/1", "<p>one</p>"), (2, "http://a/2", "<p>one</p>"), (3, None, None), (4, "http://a/4", ""), (5, "u", "é" * 1_500_000), (None, "http://a/5", "<p>one</p>"), (6, "http://a/6\nx", "two"), (2, "http://a/2", "<p>one</p>"), (-5, "http://a/7", "minus"), (-1, "http://a/8", "minus")]


def _pages(spark):
    from pyspark.sql import functions as F

    clash = ("path", "chunk", "record", "data", "__id", "__body", "__key", "__len", "__digest", "__size", "__first", "__at", "__piece")
    return spark.createDataFrame(ROWS, "page_id long, url string, html string").withColumns({c: F.lit("extra") for c in clash}).repartition(3)


def test_round_trip(spark):
    got = warc.round_trip(spark, _pages(spark)).collect()
    assert len(got) == len(ROWS) and all(r.intact for r in got)
    want = {1: ("revisit", 2), 2: ("response", None), 3: ("revisit", 4), 4: ("response", None), 5: ("response", None), 6: ("response", None), None: ("response", None), -5: ("revisit", -1), -1: ("response", None)}
    for r in got:
        body = next((h or "").encode() for i, _, h in ROWS if i == r.record_id)
        assert (r.payload_bytes, r.payload_digest) == (len(body), base64.b32encode(hashlib.sha1(body).digest()).decode())
        assert (r.record_type, r.refers_to) == want[r.record_id]
        assert r.chunks == (1 if r.record_type == "revisit" else max(1, -(-len(body) // warc.CHUNK_BYTES)))


def test_chunks_carry_digests_and_bytes(spark):
    folder = warc.scratch_path(spark, "warc")
    chunks = warc.read(warc.write(_pages(spark), folder), folder, chunk_bytes=100_000)
    five = sorted(chunks.filter("record_id = 5").collect(), key=lambda r: r.chunk)
    assert len(five) == 30 and [r.start for r in five] == [100_000 * k for k in range(30)]
    body = b"".join(bytes(r["data"]) for r in five)
    assert body == ("é" * 1_500_000).encode() and five[-1].last
    assert five[3].digest == base64.b32encode(hashlib.sha1(body[:400_000]).digest()).decode()
    # a chunk table that lacks rows isn't intact
    broken = warc.records(chunks.filter("NOT (record_id = 5 AND chunk = 7)")).filter("record_id = 5").collect()
    assert [r.intact for r in broken] == [False]


def test_smaller_payloads_are_responses(spark):
    folder = warc.scratch_path(spark, "warc")
    got = warc.records(warc.read(warc.write(_pages(spark), folder, smallest=1), folder)).collect()
    assert {r.record_type for r in got if r.record_id in (3, 4)} == {"response"}


def test_empty_archive(spark):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.round_trip(spark, none).collect() == []
    assert html_main.extract(none).collect() == []


def test_reads_plain_archives_in_any_chunks():
    out = io.BytesIO()
    w = warc.Writer(out)
    for record, data in ((7, b"0123456789"), (8, b"")):
        w.begin(record, "http://x", len(data), warc.base32_sha1(data), None)
        for at in range(0, len(data), 3):
            w.part(data[at : at + 3])
        w.end()
    got = list(warc.parse(io.BytesIO(out.getvalue()), 4))
    assert [(c["record"], c["record_id"], c["data"]) for c in got] == [(0, 7, b"0123"), (0, 7, b"4567"), (0, 7, b"89"), (1, 8, b"")]


def test_page_with_several_chunks_in_the_query(spark):
    from gleaner.llm import queries

    got = queries.op2_warc(spark, "/root/testdata/sf0.1")
    assert got.columns[:5] == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert got.filter("chunks > 1 AND intact").count() > 0 and got.filter("NOT intact").count() == 0


PAGE = (
    '<html><head><title>no</title><style>p{}</style></head><body class=home><header><a href=/>Site</a></header><nav><ul><li><a href=a>One</a><li><a href=b>Two</a></ul></nav>'
    '<div class="cookie-notice">We use cookies</div><div id="main"><h1>Title &amp; more</h1><p>First <b>wo</b>rd, a long paragraph of article text; it goes on for a while.<p>Second&nbsp;one with <a href=y>a link</a> in it, '
    'and more words than that.<script>var x="</p>";</script></div><div class="comments"><p>Great post, thanks a lot!</p></div><aside class=sidebar><ul><li><a>Rel</a></ul></aside><form><label>Name</label><input></form><footer>(c) 2024</footer>'
)


def test_main_text():
    trees = html_main.trained()
    assert html_main.main_text(PAGE, trees) == "Title & more First word, a long paragraph of article text; it goes on for a while. Second one with a link in it, and more words than that."
    assert html_main.main_text(None, trees) == html_main.main_text("", trees) == ""
    cut = PAGE[: PAGE.index("goes on")]
    assert html_main.main_text(cut, trees).endswith("it")
    for k in range(0, len(PAGE), 7):  # markup cut anywhere doesn't fail
        html_main.main_text(PAGE[:k], trees)
    assert "a" * 200_000 in html_main.main_text(f"<article><h1>t</h1><p>{'a' * 200_000}</p></article>", trees)
    html_main.main_text("<div>" * 3000 + "deep", trees)


def test_held_out_layouts_and_hierarchy():
    trees, right, total = html_main.trained(), 0, 0
    for root in html_main.make_pages(60, 99):
        nodes = html_main.flat(root)
        kept = html_main.decode(nodes, trees.logits(html_main.features(nodes)))
        right, total = right + (kept == np.array([n.label for n in nodes], bool)).sum(), total + len(nodes)
        assert all(kept[n.parent.number] for n in nodes if n.parent is not None and kept[n.number])
    assert right / total > 0.97


def test_extract_rows(spark):
    rows = [(1, "u", PAGE), (1, "u", PAGE), (None, None, None)]
    got = html_main.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert sorted(str(r.page_id) for r in got) == ["1", "1", "None"] and all(r.n_chars == len(r.text) for r in got)


def test_siblings_are_numbered_at_any_size():
    nodes = html_main.flat(html_main.parse("<div>" + "".join(f"<p>paragraph number {k} of a long page</p>" for k in range(600)) + "</div>"))
    mates = max((n.children for n in nodes), key=len)
    x = html_main.features(nodes)
    assert len(mates) == 600 and np.allclose([x[m.number, 10] for m in mates], np.arange(600) / 600)
    assert all(x[m.number, 12] == 600 for m in mates)


def test_time_grows_with_the_page_alone():
    import time

    trees, n = html_main.trained(), 20_000
    html_main.main_text("<p>once</p>", trees)
    long = {
        "siblings": "<article>" + "<p>some words of a paragraph</p>" * (n * 5 // 2) + "</article>",
        "open quotes": '<p class="x' * (n * 5 // 2) + "end",
        "quotes and tags": "<p a='" * n + '<b c="' * n + ">end",
        "plain signs": "< a " * n,
        "tags without an end": "<p " * n,
        "one end for all": "<p " * n + ">end",
        "unclosed": "<div>" * n + "</section>" * n,
        "skipped": "<select>" * n + "</video>" * n,
        "drawings": "<svg>" * n,
        "comments": "<!-- " * n,
        "headings": "<h1>" * n + "<p>" * n,
        "rows under strange elements": "<td><table>" + "<x>" * n + "<tr></tr>" * n,
        "links under strange elements": "<a><li>" + "<x>" * n + "<a></a>" * n,
        "nested lists": "<ul><li>" * n + "<li>" * n,
    }
    for name, page in long.items():
        began = time.perf_counter()
        html_main.main_text(page, trees)
        assert time.perf_counter() - began < 10, name


def test_quotes_without_a_match_end_with_the_tag():
    root = html_main.parse('<div class="a><p>one</p></div><p title=\'x > y\'>two</p>')
    texts = ["".join(t for _, t in n.own if isinstance(t, str)) for n in html_main.flat(root)]
    assert [t for t in texts if t] == ["one", "two"]
    assert html_main.parse("<p>kept<b title='cut").children[0].own[0][1] == "kept"
    assert html_main.main_text("<article><h1>A < B</h1><p>1 < 2 and 3 <4 stay, as plain signs do in a long line of article text</p></article>", html_main.trained()).count("<") == 3


def test_parsing_large_pages_is_linear():
    import random
    import time

    rng, n = random.Random(4), 100_000
    for page in ("<td><table>" + "<x>" * n + "<tr></tr>" * n, "<a><li>" + "<x>" * n + "<a></a>" * n):
        began = time.perf_counter()
        html_main.parse(page)
        assert time.perf_counter() - began < 5
    tags = "p div li ul td tr table a x section h1 dt dd dl form".split()
    soup = ["".join(rng.choice(("<%s>", "<%s>", "</%s>")) % rng.choice(tags) for _ in range(k)) for k in (40_000, 160_000)]
    html_main.parse(soup[0])
    took = []
    for page in soup:
        began = time.process_time()
        html_main.parse(page)
        took.append(time.process_time() - began)
    assert took[1] < 4 * 2.5 * took[0]
