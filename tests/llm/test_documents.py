"""Operators over documents against brute force, on the small tables and on a fixture of odd rows."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pytest
import xxhash

from gleaner.llm import class_lm, line_quality, nbsvm, packing, positional_index, simhash, suffix_dedup, toxicity
from gleaner.llm.graph import components, forest
from gleaner.llm.queries import tokenizer_path
from gleaner.llm.suffix_array import common_prefixes, suffix_array

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def ascii_lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


# quality rules ----------------------------------------------------------------------------------------------------------


def base(text):
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    c, covered = collections.Counter(zip(w, w[1:], w[2:], strict=False)), set()
    for i in range(len(w) - 2):
        if c[tuple(w[i : i + 3])] > 1:
            covered |= {i, i + 1, i + 2}
    return len(w), sum(map(len, w)), sum(text.count(x) for x in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


@pytest.mark.parametrize("which", ["docs", "real"])
def test_base_statistics(which, request):
    df = request.getfixturevalue(which)
    got = collections.Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in line_quality.judge(df).collect())
    want = collections.Counter()
    for r in df.collect():
        b = base(r.text)
        want[(r.doc_id, *b, b[0] < 50 or 100 * b[4] > 50 * b[0])] += 1
    assert got == want


def test_frequent_lines_deplete(spark):
    line = "subscribe to our newsletter and follow us on all of the usual channels today please do so now"
    rows = [(i, f"{line}\n{line} again\n" + (" ".join(f"own{i}word{j}" for j in range(60)) if i % 2 else "tiny rest"), "host") for i in range(80)]
    rows += [(1000 + i, "\n".join(f"copied line number {k} of a text that many have word for word and line for line" for k in range(6)), "host") for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = {r.doc_id: r.kept for r in line_quality.judge(df, min_words=10, max_repeat_percent=100).collect()}
    assert all(kept[i] for i in range(1, 80, 2)) and not any(kept[i] for i in range(0, 80, 2))
    assert all(kept[1000 + i] for i in range(200))  # copies aren't boilerplate
    assert {r.doc_id for r in line_quality.keep(df, min_words=10, max_repeat_percent=100).collect()} == {i for i, k in kept.items() if k}


def test_long_templates_are_counted_per_document(spark):
    template = ["\n".join(" ".join(f"shared{k}word{j}" for j in range(n)) for k, n in enumerate((30, 25, 15)))]
    rows = [(i, f"{template[0]}\nown{i} text{i} here{i}", "long") for i in range(100)]
    # copies and empty texts count once for the share as well: 30 of 530 distinct texts have the line
    few = "a line that thirty of the documents of this host have"
    rows += [(1000 + i, f"{few}\n" + " ".join(f"few{i}word{j}" for j in range(60)), "few") for i in range(30)]
    rows += [(2000 + i, " ".join(f"other{i}word{j}" for j in range(60)), "few") for i in range(499)] + [(3000 + i, "", "few") for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: (r.base_failed, r.removed_words, r.kept) for r in line_quality.judge(df).collect()}
    assert all(got[i] == (False, 70, False) for i in range(100))
    assert all(got[1000 + i] == (False, len(few.split()), True) for i in range(30))


# near-duplicates ---------------------------------------------------------------------------------------------------------


def fingerprint(text):
    w = WORD.findall(ascii_lower(text))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("which", ["docs", "real"])
@pytest.mark.parametrize("least,whole,halves", [(4096, 4_000_000, 64_000_000), (3, 4_000_000, 64_000_000), (3, 0, 64_000_000), (8, 0, 0)])
def test_components(which, least, whole, halves, request, monkeypatch):
    # tiles of few fingerprints, by ones, halves and quarters
    for name, value in (("LEAST", least), ("WHOLE", whole), ("HALVES", halves)):
        monkeypatch.setattr(simhash, name, value)
    if least < 4096:
        monkeypatch.setattr(simhash, "_layout", lambda n: (1 if whole else 2 if halves else 4, least))
    df = request.getfixturevalue(which)
    got = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in simhash.fingerprint_components(df).collect()), key=repr)
    rows = [(r.doc_id, fingerprint(r.text)) for r in df.collect()]
    known = [(i, f) for i, f in rows if i is not None]
    root = {i: i for i, _ in known}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, f in known:
        for j, g in known:
            if (f ^ g).bit_count() <= 4:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    assert got == sorted(((i, f"{f:016x}", None if i is None else find(i)) for i, f in rows), key=repr)


def test_every_link_comes_from_a_pair_of_tiles(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    marked = simhash.staged(simhash.fingerprints(docs), "test")
    distinct = marked.groupBy("__fp").agg({"__id": "min"}).withColumnRenamed("min(__id)", "__node")
    fp = {r["__node"]: r["__fp"] & (1 << 64) - 1 for r in distinct.collect()}
    found = simhash.links(distinct).collect()
    for r in found:
        assert {r.t // simhash._SALT, r.u // simhash._SALT} == {fp[r.a].bit_count(), fp[r.b].bit_count()}
        assert abs(r.t // simhash._SALT - r.u // simhash._SALT) <= 4
    nodes, values = np.array(list(fp)), np.array(list(fp.values()), np.uint64)
    x, y = np.nonzero(np.bitwise_count(values[:, None] ^ values[None, :]) <= 4)
    want = forest(nodes[x], nodes[y])
    assert len(want[0]) > 1
    got = forest(np.array([r.a for r in found]), np.array([r.b for r in found]))
    assert [g.tolist() for g in got] == [w.tolist() for w in want]


def test_tiles_lose_no_link():
    rng = np.random.default_rng(5)
    seeds = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    fp = np.concatenate([seeds, *[seeds ^ (np.uint64(1) << rng.integers(0, 64, 40).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 40).astype(np.uint64)) for _ in range(60)]])
    node, near = np.arange(len(fp)), np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 4
    for side in (np.zeros(len(fp), int), rng.integers(0, 2, len(fp))):
        got = simhash.compare(fp, node, side, 4)
        x, y = np.nonzero(near if not side.any() else near & (side[:, None] != side[None, :]))
        assert [a.tolist() for a in got] == [a.tolist() for a in forest(x, y)]


def test_deduplicate_keeps_one(docs):
    kept = [r.doc_id for r in simhash.deduplicate(docs).collect()]
    assert len([i for i in kept if i is not None]) == len({i for i in kept if i is not None}) and None in kept
    assert {4, 1} <= set(kept) and not {2, 5, 6} & set(kept)  # empty texts are copies of each other
    assert simhash.deduplicate(docs).columns == docs.columns


def test_long_chain_is_one_component(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1001)], "a long, b long")
    got = {r.node: r.root for r in components(links).collect()}
    assert got == {i: 0 for i in range(1, 301)} | {1001: 1000}
    node, root = forest(np.array([5, 4, 9]), np.array([4, 2, 8]))
    assert dict(zip(node.tolist(), root.tolist(), strict=True)) == {4: 2, 5: 2, 9: 8}


# repeated passages ---------------------------------------------------------------------------------------------------------


def removed(rows):
    smallest, out = {}, []
    ids = [(2**63 - 1 if r.doc_id is None else r.doc_id, r.doc_id, (r.text or "").encode()) for r in rows]
    for i, _, b in ids:
        for k in range(len(b) - 49):
            smallest[b[k : k + 50]] = min(smallest.get(b[k : k + 50], i), i)
    for i, shown, b in ids:
        gone = bytearray(len(b))
        for k in range(len(b) - 49):
            if smallest[b[k : k + 50]] < i:
                gone[k : k + 50] = b"\1" * 50
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        out.append((shown, len(b), sum(gone), len([x for x in bytes(gone).split(b"\0") if x]), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("which", ["docs", "real"])
@pytest.mark.parametrize("chunk,hot,array", [(1_000_000, 4000, 1_500_000), (2_000, 1, 3_000)])
def test_repeated_passages(which, chunk, hot, array, request, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "CHUNK_BYTES", chunk)
    monkeypatch.setattr(suffix_dedup, "HOT_CHUNKS", hot)
    monkeypatch.setattr(suffix_dedup, "ARRAY_BYTES", array)
    df = request.getfixturevalue(which)
    got = sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.repeated_passages(df).collect()), key=repr)
    assert got == removed(df.collect())


def test_remove_keeps_columns_and_characters(spark, docs):
    out = suffix_dedup.remove(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    assert [r.text for r in out.filter("doc_id = 4").collect()] == [None]
    rows = [(1, "é" * 60, 60), (2, "x" + "é" * 60 + "à tail", 99)]  # the last removed byte is the first of à, which é shares
    got = {r.doc_id: (r.text, r.n_chars) for r in suffix_dedup.remove(spark.createDataFrame(rows, "doc_id long, text string, n_chars long")).collect()}
    assert got == {1: ("é" * 60, 60), 2: ("x tail", 6)}


def test_suffix_order_decides_all(spark, monkeypatch):
    """All that goes, whole copies included, comes from the sorted suffixes: with them blind, nothing goes."""
    rows = [(i, f"passage number {k} that several documents of this little table share, word for word, and then some more of it", "s") for i, k in ((1, 1), (2, 1), (3, 2), (9, 1))]
    rows += [(4, "own start. " + rows[2][1] + " own end", "s"), (5, "another start. " + rows[0][1][10:] + " another end", "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").coalesce(1)
    for chunk in (1_000_000, 150):  # in one chunk, and across chunks
        monkeypatch.setattr(suffix_dedup, "CHUNK_BYTES", chunk)
        given = df.select("doc_id", "text").collect()
        assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.repeated_passages(df).collect()), key=repr) == removed(given)
        with monkeypatch.context() as m:
            def blind(texts, owner, length):
                of = np.repeat(np.arange(len(texts)), [max(0, len(x) - length + 1) for x in texts])
                return of, np.arange(len(of)) - np.searchsorted(of, of), owner[of]

            m.setattr(suffix_dedup, "window_owners", blind)
            chunk_ = type("C", (), {"t": np.zeros(200, np.uint8), "body": b"x" * 200, "ids": np.array([1, 2])})
            at = np.array([0, 100])
            assert not len(suffix_dedup.local_hits(chunk_, np.array([0, 1]), at, at + 50, at.astype(np.uint64), 50, 1000))
            m.setattr(suffix_dedup, "local_hits", lambda chunk, doc, low, *rest: low[:0])
            assert {r.n_removed for r in suffix_dedup.repeated_passages(df).collect()} == {0}


def test_suffix_array_in_parts(monkeypatch):
    from gleaner.llm import suffix_array as sa

    t = np.random.default_rng(2).integers(0, 3, 500).astype(np.uint8)  # null bytes among them
    monkeypatch.setattr(sa, "MOST", 20)
    b = t.tobytes()
    order = suffix_array(t, 501).tolist()
    assert sorted(order) == list(range(500)) and all(b[i:] <= b[j:] or b[i:].rstrip(b"\0") == b[j:].rstrip(b"\0") for i, j in zip(order, order[1:], strict=False))


def test_suffix_array_is_exact():
    rng = np.random.default_rng(0)
    for n, letters in ((1, 3), (2, 1), (10, 2), (300, 2), (400, 1), (700, 26)):
        t = rng.integers(0, letters, n).astype(np.uint8) + 97
        b = t.tobytes()
        want = sorted(range(n), key=lambda i: b[i:])
        assert suffix_array(t, n + 1).tolist() == want
        for wanted in (rng.random(n) < 0.2, np.arange(n) % 9 < 3, np.zeros(n, bool)):
            got = [i for i in suffix_array(t, n + 1, wanted).tolist() if wanted[i]]
            assert got == [i for i in want if wanted[i]]

        def shared(x, y):
            return next((k for k in range(min(len(x), len(y), 50)) if x[k] != y[k]), min(len(x), len(y), 50))

        assert common_prefixes(t, np.array(want), 50).tolist() == [0] + [shared(b[want[i] :], b[want[i - 1] :]) for i in range(1, n)]


# decontamination -----------------------------------------------------------------------------------------------------------


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", ascii_lower(text))


def judged(rows, items):
    wins = collections.defaultdict(set)
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - 12) if w else 0):
            wins[tuple(w[k : k + 13])].add(i)
    out = []
    for r in rows:
        w, hit, found = words(r.text), set(), set()
        for size in {len(x) for x in wins}:
            for k in range(len(w) - size + 1):
                if own := wins.get(tuple(w[k : k + size])):
                    hit |= set(range(k, k + size))
                    found |= own
        out.append((r.doc_id, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("block", [8_000_000, 0])
@pytest.mark.parametrize("segment", [4_000_000, 500])
def test_contamination(spark, small, real, docs, block, segment, monkeypatch):
    monkeypatch.setattr(positional_index, "BLOCK_BYTES", block)
    monkeypatch.setattr(positional_index, "SEGMENT_BYTES", segment)
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    more = [*bench, (900, "theta iota kappa"), (901, None), (902, "..."), (903, "theta iota kappa"), (904, " ".join(f"w{i % 997}x{i % 31}" for i in range(40, 60)))]
    for df, items in ((real, bench), (docs, more)):
        got = positional_index.contamination(df, spark.createDataFrame(items, "item_id long, text string"))
        assert sorted((tuple(r[c] for c in ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")) for r in got.collect()), key=repr) == judged(df.collect(), items)


def test_decontaminate_and_proximity(spark):
    rows = [(1, "start " + "a1 b2 c3 d4 " * 4), (2, "far a1 x x x b2 x x c3"), (3, "none of it")]
    df, items = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(7, "a1 b2 c3")], "item_id long, text string")
    assert {r.doc_id for r in positional_index.decontaminate(df, items).collect()} == {2, 3}
    near = positional_index.proximity(positional_index.build(df), items, span=8).collect()
    assert {r.doc_id for r in near} == {1, 2} and {r.item_id for r in near} == {7}
    assert not [r for r in positional_index.proximity(positional_index.build(df), items, span=2).collect() if r.doc_id == 2]


def test_windows_go_where_their_rarest_term_is(spark, monkeypatch):
    monkeypatch.setattr(positional_index, "BLOCK_BYTES", 0)
    rows = [(i, f"common words stand here and there term{i} more common words", "s") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(8)
    items = spark.createDataFrame([(1, "here and there term7 more"), (2, "term8 term9"), (3, "absent term7"), (4, "common words")], "item_id long, text string")
    got = {r.doc_id: (r.n_hit, r.n_items) for r in positional_index.contamination(df, items, width=5).collect()}
    assert got == {i: (5 + 4, 2) if i == 7 else (4, 1) for i in range(40)}
    index = positional_index.staged(positional_index.build(df), "test")
    given, _ = positional_index._put(index, positional_index.sought(items, 5))
    asked = sorted(len(r.asked or []) for r in given.select("asked").collect())
    assert sum(asked) == index.count() + 2  # the common window goes everywhere, those of term7 and term8 to one segment each, the other nowhere


# packing ---------------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("which", ["docs", "real"])
def test_packing_round_trip(which, request):
    from tokenizers import Tokenizer

    df, path, limit = request.getfixturevalue(which), tokenizer_path(), 1024
    plain = Tokenizer.from_file(path)
    rows = packing.pack(df, path).collect()
    want = collections.Counter()
    for r in df.collect():
        ids = [*plain.encode(r.text or "", add_special_tokens=False).ids, 2]
        first = len(ids) % limit or limit
        cuts = [0, *range(first, len(ids) + 1, limit)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            want[(r.doc_id, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes()))] += 1
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    bins = collections.defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for spans in bins.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= limit
    assert len(bins) <= math.ceil(sum(r.length for r in rows) / limit) * 1.05 + 3


def test_odd_texts_are_encoded_as_the_library_does(spark):
    from tokenizers import Tokenizer

    path = tokenizer_path()
    plain, encode = Tokenizer.from_file(path), packing.encoder(path)
    odd = [" " * 1_000_000, "\n" * 100_000, "a" * 60_000, "7" * 60_000, "!" * 60_000, "\u3000" * 30_000, "é" * 30_000, "x <|endoftext|> y", "<|endoftext|>", "a" + " " * 20_000 + "b", "ab1 " * 30_000, "\u0301" * 20_000, "\u200d" * 20_000, "a\u0300" * 20_000]
    for text in odd:
        assert encode(text) == plain.encode(text, add_special_tokens=False).ids, text[:10]
    out = packing.pack(spark.createDataFrame([(1, odd[0]), (2, odd[7])], "doc_id long, text string"), path).collect()
    assert sum(r.length for r in out if r.doc_id == 1) == len(plain.encode(odd[0], add_special_tokens=False).ids) + 1


def test_best_fit_and_merge_rounds(spark, monkeypatch):
    where, at, fill = packing.best_fit([6, 5, 5, 4, 10, 3], 10)
    assert len(fill) == 4 and all(f <= 10 for f in fill) and sum(fill) == 33
    monkeypatch.setattr(packing, "GROUP_BINS", 50)
    bins = spark.createDataFrame([(i, 100 + i % 300) for i in range(600)], "bin long, bin_fill long")
    moved = packing.merge(bins, 1024, 1022).collect()
    size = dict((i, 100 + i % 300) for i in range(600))
    spans = collections.defaultdict(list)
    for r in moved:
        spans[r["into"]].append((r["at"], size[r["bin"]]))
    assert len(moved) == 600 and len(spans) < 1.1 * sum(size.values()) / 1024
    for s in spans.values():
        end = 0
        for a, n in sorted(s):
            assert a == end
            end += n
        assert end <= 1024


# language model ------------------------------------------------------------------------------------------------------------------


def lm_tokens(text):
    return [*WORD.findall(ascii_lower(text)), " "]


def lm_held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 7 == 2


@pytest.mark.parametrize("piece", [1, 7, 1 << 20])
def test_words_are_the_same_in_pieces(piece, monkeypatch):
    monkeypatch.setattr(class_lm, "PIECE", piece)
    for text in (b"", b"  \n", b"One two\x0bTHREE  four " + b"x" * 30 + b" end", "Ünï codé\u00a0and\u2003more".encode()):
        assert class_lm.tokens(text) == [*(w.encode() for w in WORD.findall(ascii_lower(text.decode()))), b" "]


@pytest.mark.parametrize("which,chunk", [("docs", 400_000), ("docs", 50), ("real", 20_000)])
def test_language_model_base(which, chunk, request, monkeypatch):
    monkeypatch.setattr(class_lm, "CHUNK_TOKENS", chunk)
    df = request.getfixturevalue(which)
    rows = df.collect()
    c = collections.Counter(x for r in rows if not lm_held(r.doc_id) for x in lm_tokens(r.text))
    total, distinct = sum(c.values()), len(c)
    got = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in class_lm.train_and_score(df, core=100).collect()), key=repr)
    want = []
    for r in rows:
        w = lm_tokens(r.text)
        want.append((r.doc_id, lm_held(r.doc_id), len(w), sum(c[x] > 0 for x in w), total, round(sum(math.log10((c[x] + 1) / (total + distinct + 1)) for x in w), 4)))
    assert got == sorted(want, key=repr)


@pytest.mark.parametrize("which", ["docs", "real"])
def test_language_model_by_brute_force(which, request, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(class_lm, "CHUNK_TOKENS", 5_000)
    df = request.getfixturevalue(which)
    rows = df.collect()
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7)) == 2, F.lit(False))
    fitted = class_lm.fit(df, held, core=60, classes=6)
    known = {bytes(r["word"]).decode(): (r["n"], r["class"]) for r in class_lm.word_classes(fitted).collect()}
    train = [lm_tokens(r.text) for r in rows if not lm_held(r.doc_id)]
    counts = collections.Counter(x for t in train for x in t)
    # every training word, however rare, has its whole count and one class
    assert {w: n for w, (n, _) in known.items()} == dict(counts)
    g = 1 + max(c for _, c in known.values())
    assert known[" "][1] == g - 1 and sum(c == g - 1 for _, c in known.values()) == 1
    mass, once, pairs = np.zeros(g), np.ones(g), np.zeros((g + 1, g))
    for w, n in counts.items():
        mass[known[w][1]] += n
        once[known[w][1]] += n == 1
    for t in train:
        for a, b in zip([" ", *t], t, strict=False):
            pairs[known[a][1], known[b][1]] += 1
    shares = (pairs.sum(0) + 0.5) / (pairs.sum() + 0.5 * g)
    chance = (pairs + 20 * shares) / (pairs.sum(1, keepdims=True) + 20)
    assert np.allclose((chance * (mass / (mass + once))).sum(1) + (chance * (once / (mass + once))).sum(1), 1)
    want = []
    for r in rows:
        total, before = 0.0, g - 1
        for x in lm_tokens(r.text):
            n, c = known.get(x, (0, g))
            p = chance[before, c] * n / (mass[c] + once[c]) if n else (chance[before] * once / (mass + once)).sum()
            total, before = total + math.log10(p), c
        want.append((r.doc_id, round(total, 4)))
    got = [(r["__id"], round(r.score, 4)) for r in class_lm.scored(fitted.ready, fitted.model).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_language_model_beats_word_counts_out_of_sample(spark):
    out = class_lm.train_and_score(spark.read.parquet("/root/testdata/sf0.1/documents.parquet")).filter("held_out").toPandas()
    n = out["n_tokens"].sum()
    assert 10 ** (-out["score"].sum() / n) < 0.25 * 10 ** (-out["base_score"].sum() / n)


def test_assign_takes_the_best_class():
    rng = np.random.default_rng(3)
    g, size = 5, 40
    grid = rng.integers(0, 40, (g, g)).astype(float)
    word, near = np.nonzero(rng.random((size - 1, 2 * g)) < 0.3)
    n = rng.integers(1, 14, len(word))
    own = np.where(rng.random(size) < 0.5, rng.integers(0, g - 1, size), -1)

    def info(x):
        return x * math.log(max(x, 1))

    got = class_lm.assign(size, word, near, n, grid, own)
    for w in range(size):
        mine = [(int(d), int(k)) for x, d, k in zip(word, near, n, strict=True) if x == w]
        if not mine:
            assert got[w] == -1
            continue
        value = []
        for c in range(g - 1):
            # with the word in class c against without it, the two sides of a pair apart
            total = 0.0
            for d, k in mine:
                cell = grid[d, c] if d < g else grid[c, d - g]
                total += info(cell) - info(max(cell - k, 0)) if own[w] == c else info(cell + k) - info(cell)
            for side, whole in ((0, grid[:, c].sum()), (1, grid[c].sum())):
                k = sum(k for d, k in mine if (d >= g) == bool(side))
                total -= info(whole) - info(max(whole - k, 0)) if own[w] == c else info(whole + k) - info(whole)
            value.append(total)
        assert value[got[w]] >= max(value) - 1e-6


def test_merge_goes_on_while_rounds_gain(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP_BINS", 50)
    bins = spark.createDataFrame([(i, 900) for i in range(1000)] + [(1000 + i, 500) for i in range(40)], "bin long, bin_fill long")
    into = collections.Counter(r["into"] for r in packing.merge(bins, 1024, 1022).collect())
    alone = sum(1 for b, n in into.items() if b >= 1000 and n == 1)
    assert sum(into.values()) == 1040 and alone <= 2


def test_exchange_finds_alternating_classes():
    rng = np.random.default_rng(1)
    n, kind = 40, np.arange(40) % 2
    counts = np.where(kind[:, None] != kind[None, :], rng.integers(20, 60, (n, n)), rng.integers(0, 3, (n, n))).astype(float)
    of = class_lm.exchange(counts, 2)
    assert len({(int(of[i]), int(kind[i])) for i in range(n)}) == 2


# classifiers ---------------------------------------------------------------------------------------------------------------------


def test_quality_held_out(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    out = nbsvm.classify(docs, labels)
    assert out.count() == docs.count() and out.filter("score < 0 OR score > 1").isEmpty()
    held = {r.doc_id for r in out.filter("held_out").collect()}
    assert held == {r.doc_id for r in docs.select("doc_id").collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0}
    both = out.filter("held_out").join(labels, "doc_id").toPandas()
    assert (both.quality == both.predicted).mean() > 0.9


def test_toxicity_held_out(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    both = toxicity.classify(docs.join(labels, "doc_id", "left_semi"), labels).filter("held_out").join(labels, "doc_id").toPandas()
    assert both[both.toxic == 1].predicted.mean() > 0.8 and both[both.toxic == 0].predicted.mean() < 0.05


def test_classifiers_on_odd_rows(spark, docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    some = spark.createDataFrame([(1, 1, 0), (7, 0, 1), (8, 1, 0), (9, None, None), (10, 1, 0), (11, 0, 1)], "doc_id long, quality int, toxic int")
    for labels in (none, some):
        for got in (nbsvm.classify(docs, labels), toxicity.classify(docs, labels)):
            rows = got.collect()
            assert sorted(str(r.doc_id) for r in rows) == sorted(str(r.doc_id) for r in docs.collect())
            assert all(0 <= r.score <= 1 and r.predicted in (0, 1) for r in rows)
    assert {r.score for r in nbsvm.classify(docs, none).collect()} == {0.5}


def test_dual_descent_separates():
    rows_ = [np.array([0, 2]), np.array([0, 3]), np.array([1, 2]), np.array([1, 3])]
    w, b = nbsvm.descend(rows_, np.array([1.0, 1, -1, -1]), np.ones(4), rounds=50)
    assert all((w[r].sum() / math.sqrt(2) + b > 0) == (k < 2) for k, r in enumerate(rows_))


# clashing names ---------------------------------------------------------------------------------------------------------------------

OWN = "__id __sha __host __at __line __words __text __raw __ls __whole __l __n __docs __body __fp __node __gone __lid __did __y __key __bad __rest __held keep node root a b t u cell mate gone id fp c0 c1 c2 chunk bucket bin into at fill from state words".split()


def test_clashing_names(spark, docs):
    """Columns named like those that operators use for themselves: nothing fails, and what is kept keeps them."""
    from pyspark.sql import functions as F

    df = docs.select("doc_id", "text", "lang", "source", "n_chars")
    clash = df.withColumns({c: F.lit("extra") for c in OWN})
    items = spark.createDataFrame([(1, "alpha beta gamma delta")], "item_id long, text string")
    labels = spark.createDataFrame([(1, 1, 0), (7, 0, 1), (8, 1, 0), (11, 0, 1)], "doc_id long, quality int, toxic int").withColumns({c: F.lit("extra") for c in OWN})

    def seen(out, names):
        return sorted((tuple(r[n] for n in names) for r in out.select(*names).collect()), key=repr)

    for run in (
        line_quality.judge, simhash.fingerprint_components, suffix_dedup.repeated_passages, lambda d: positional_index.contamination(d, items), lambda d: packing.pack(d, tokenizer_path()).drop("sequence_id", "offset"),
        lambda d: class_lm.train_and_score(d, core=20).drop("score", "perplexity"), lambda d: nbsvm.classify(d, labels), lambda d: toxicity.classify(d, labels),
    ):
        plain = run(df)
        assert seen(run(clash), plain.columns) == seen(plain, plain.columns)
    for run in (line_quality.keep, simhash.deduplicate, suffix_dedup.remove, lambda d: positional_index.decontaminate(d, items)):
        out = run(clash)
        assert out.columns == clash.columns
        assert seen(out, df.columns) == seen(run(df), df.columns)
        assert {r["__id"] for r in out.collect()} == {"extra"}


# empty tables ----------------------------------------------------------------------------------------------------------------------


def test_empty_tables(spark, no_docs):
    items = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    for out in (
        line_quality.judge(no_docs), line_quality.keep(no_docs), simhash.fingerprint_components(no_docs), simhash.deduplicate(no_docs), suffix_dedup.repeated_passages(no_docs), suffix_dedup.remove(no_docs),
        positional_index.contamination(no_docs, items), positional_index.decontaminate(no_docs, items), packing.pack(no_docs, tokenizer_path()), class_lm.train_and_score(no_docs), nbsvm.classify(no_docs, labels), toxicity.classify(no_docs, labels),
    ):
        assert out.collect() == []


def test_no_benchmark_items(spark, docs):
    out = positional_index.contamination(docs, spark.createDataFrame([], "item_id long, text string")).collect()
    assert len(out) == docs.count() and not any(r.contaminated for r in out)
