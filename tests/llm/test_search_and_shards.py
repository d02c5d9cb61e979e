"""Vector codes, shards and ranked search against brute force, on the small tables and on odd rows."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleaner.llm import common, queries, ranked_search, sharding, vector_codes

# vector codes -------------------------------------------------------------------------------------------------------------


def lloyd(rows, parts=8, entries=16, rounds=6, scale=4096):
    kept = [(i, x, label) for i, x, label in rows if x and all(v is not None and math.isfinite(v) for v in x)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    q = np.floor(np.array([x for _, x, _ in kept], np.float64) * scale).astype(np.int64).reshape(len(kept), parts, -1)
    books = q[:entries].swapaxes(0, 1).copy()
    for r in range(rounds + 1):
        codes = np.stack([((q[:, p, None] - books[p][None]) ** 2).sum(2).argmin(1) for p in range(parts)], 1)
        if r == rounds:
            break
        for p in range(parts):
            for e in range(books.shape[1]):
                if (own := codes[:, p] == e).any():
                    books[p, e] = q[own, p].sum(0) // own.sum()
    error = sum(((q[:, p] - books[p][codes[:, p]]) ** 2).sum(1) for p in range(parts)).tolist()
    of = collections.Counter()
    for (_, _, label), e in zip(kept, error, strict=True):
        of[label] += e
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    return collections.Counter((i, bytes(c.tolist()).hex(), e, of[label], digest) for (i, _, label), c, e in zip(kept, codes, error, strict=True))


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3)


def test_codes_equal_plain_rounds(spark, small):
    df = common.table(spark, small, "embeddings")
    assert collections.Counter(map(tuple, vector_codes.encode(df).collect())) == lloyd([tuple(r[c] for c in ("vec_id", "embedding", "label")) for r in df.collect()])


@pytest.mark.parametrize("seed", range(3))
def test_codes_with_ties_and_odd_vectors(spark, seed, monkeypatch):
    monkeypatch.setattr(vector_codes, "BLOCK_ROWS", 37)
    rng = random.Random(seed)
    # few values, so that many distances are equal; a third of all rows is one vector
    few = lambda: [rng.choice((-0.5, -0.25, 0.0, 0.25, 0.5)) * (1 + seed) for _ in range(16)]
    same = few()
    rows = [(rng.randrange(200) if i % 11 else None, same if i % 3 == 0 else few(), rng.choice((None, 1, 2))) for i in range(300)]
    odd = [(1000, None, 1), (1001, [], 1), (1002, [float("nan")] * 16, 1), (1003, [None] + [0.0] * 15, 1), (1004, [float("-inf")] * 16, None)]
    df = vectors(spark, rows + odd).withColumns({"x": F.lit(1), "code": F.lit("c"), "keys": F.lit("k")})
    assert collections.Counter(map(tuple, vector_codes.encode(df).collect())) == lloyd(rows + odd)


def test_codes_of_few_or_no_vectors(spark):
    rows = [(i, [i / 7.0] * 8, None) for i in range(5)] + [(2, [2 / 7.0] * 8, None)]
    rows = [(i, [float(np.float32(v)) for v in x], label) for i, x, label in rows]
    assert collections.Counter(map(tuple, vector_codes.encode(vectors(spark, rows)).collect())) == lloyd(rows)
    got = vector_codes.encode(vectors(spark, [(1, None, 1)]))
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"] and not got.count()


def test_vectors_that_cannot_be_cut_or_measured(spark):
    with pytest.raises(ValueError, match="equally long"):
        vector_codes.encode(vectors(spark, [(1, [0.0] * 8, 1), (2, [0.0] * 16, 1)]))
    with pytest.raises(Exception, match="too large"):
        vector_codes.encode(vectors(spark, [(1, [1e30] * 8, 1)]))


def test_heaps_leave_out_parts_that_cannot_have_changed():
    rng = np.random.default_rng(1)
    x = (rng.normal(size=(400, 8)) * 20 + np.repeat(np.arange(4) * 4000, 100)[:, None]).astype(np.int32)
    start = x[[0, 100, 200, 300]].astype(np.int64)[None]
    books = vector_codes.Codebooks(start, np.zeros((1, 4)))
    block = vector_codes.Block.start(list(range(400)), [None] * 400, x, books)
    sums = block.first(books)
    books = books.moved(sums[:, :, :-1], sums[:, :, -1])
    scanned = []
    block._assign = lambda *a: scanned.append(a)
    assert not block.again(books).any() and not scanned


# shards ---------------------------------------------------------------------------------------------------------------------


def check_shards(df, shards=40, spread=None):
    got, given = sharding.shard(df, shards).collect(), df.select("doc_id", "text").collect()
    body = [(r.doc_id, (r.text or "").encode()) for r in given]
    assert collections.Counter((r.doc_id, r.size, r.text_crc32) for r in got) == collections.Counter((i, len(t) + 16, zlib.crc32(t)) for i, t in body)
    assert {(r.law, r.grown_shard) for r in got} <= {("bytes", None)}
    slots, loads = collections.defaultdict(list), collections.Counter({s: 0 for s in range(shards)})
    for r in got:
        slots[r.shard].append(r.slot)
        loads[r.shard] += r["size"]
    assert set(slots) <= set(range(shards)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    if spread is not None:
        mean = sum(loads.values()) / shards
        assert max(loads.values()) - min(loads.values()) <= spread * mean, loads
    return got


def test_shards_of_the_table(spark):
    check_shards(common.table(spark, "/root/testdata/sf0.01", "documents"), spread=0.05)


def test_shards_of_odd_rows(docs, no_docs):
    check_shards(docs)
    got = sharding.shard(no_docs)
    assert got.columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"] and not got.count()


def test_shards_of_hot_ids_and_large_records(spark, monkeypatch):
    # most rows share no id, or one id; wholly equal rows, and records many times a range's size
    rows = [(None, "equal text")] * 3000 + [(7, f"text {i}") for i in range(3000)] + [(100 + i, "x" * (20_000 if i % 50 == 0 else 30)) for i in range(1000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    check_shards(df, 8, spread=0.02)
    monkeypatch.setattr(sharding, "OVERFULL", 0.01)  # every range is cut up
    check_shards(df, 8, spread=0.02)
    monkeypatch.setattr(sharding, "SAMPLES_PER_RANGE", 0.2)  # poor boundaries: most ranges are overfull
    check_shards(df, 8, spread=0.02)


def test_range_is_the_number_of_boundaries_at_or_below(spark):
    rng = random.Random(3)
    keys = [(rng.randrange(20), rng.randrange(5)) for _ in range(300)]
    for n in (0, 1, 2, 7, 8, 33):
        bounds = sorted({(rng.randrange(20), rng.randrange(5)) for _ in range(n)})
        df = spark.createDataFrame(keys, "k long, tie long")
        got = sharding.range_of(df, bounds) if bounds else df.withColumn("r", F.lit(0))
        assert all(r.r == sum(b <= (r.k, r.tie) for b in bounds) for r in got.collect())


# ranked search --------------------------------------------------------------------------------------------------------------

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def found_terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def ranked(docs, items, k=20):
    counted = [(i, c) for i, c in ((i, collections.Counter(found_terms(t))) for i, t in docs) if c]
    n, length = len(counted), sum(c.total() for _, c in counted)
    df = collections.Counter(t for _, c in counted for t in c)
    out = []
    for item, text in dict.fromkeys(items):
        asked, scores = collections.Counter(found_terms(text)), []
        for i, c in counted:
            m = 100 - 25 + 25 * c.total() * n // length
            s = sum(times * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 12 * m)) for t, times in asked.items() if t in c)
            if s > 0:
                scores.append((-s, i is None, i or 0))
        out += [(item, rank, None if null else i, -s) for rank, (s, null, i) in enumerate(sorted(scores)[:k], 1)]
    return collections.Counter(out)


ITEMS = [(1, "Alpha beta, number2 number3"), (2, None), (3, "..."), (4, "çà LÀ und w5x5 w7x7 w7x7"), (None, "short TEXT"), (5, "nowhere to be found"), (1, "Alpha beta, number2 number3"), (6, "same line of boilerplate alpha alpha")]


@pytest.mark.parametrize("which", ["docs", "real"])
def test_ranking(which, request, spark, small):
    df = request.getfixturevalue(which)
    items = spark.createDataFrame(ITEMS, "item_id long, text string").withColumns({"score": F.lit(1), "rank": F.lit(2)})
    if which == "real":
        items = common.table(spark, small, "benchmark")
    got = collections.Counter(map(tuple, ranked_search.rank_documents(df, items).collect()))
    assert got == ranked([(r.doc_id, r.text) for r in df.collect()], [(r.item_id, r.text) for r in items.collect()])


@pytest.mark.parametrize("seed", range(4))
def test_ranking_in_small_segments_and_blocks(spark, seed, monkeypatch):
    """Many equal scores, repeated ids, small ranges, several segments, blocks and batches."""
    monkeypatch.setattr(ranked_search, "SEGMENT_BYTES", 1500)
    monkeypatch.setattr(ranked_search, "BLOCK_BYTES", 60)
    monkeypatch.setattr(ranked_search, "TOGETHER", 3)
    monkeypatch.setattr(ranked_search, "LEAF_ENTRIES", 4)
    monkeypatch.setattr(ranked_search.Treaps.best, "__defaults__", (2,))
    rng = random.Random(seed)
    words = [f"w{min(int(rng.expovariate(0.3)), 25)}" for _ in range(4000)]
    docs = [(rng.randrange(150) if i % 17 else None, " ".join(rng.choice(words) for _ in range(rng.choice((0, 1, 3, 20))))) for i in range(400)]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.choice((1, 2, 6, 12))))) for i in range(12)]
    df, asked = spark.createDataFrame(docs, "doc_id long, text string").repartition(2), spark.createDataFrame(items, "item_id long, text string")
    assert collections.Counter(map(tuple, ranked_search.rank_documents(df, asked, 5).collect())) == ranked(docs, items, 5)


def test_treaps_are_search_trees_and_heaps():
    rng = np.random.default_rng(5)
    for high in (2, 10, 10**6):
        sizes = rng.integers(1, 60, 30)
        docs = np.concatenate([np.sort(rng.choice(200, n, replace=False)) for n in sizes])
        impact = np.concatenate([rng.integers(1, high + 1, n) if n % 2 else np.arange(1, n + 1) for n in sizes])
        t = ranked_search.Treaps(docs, impact, sizes)

        def walk(x, low, top, t=t):
            if x < 0:
                return []
            assert t.impact[x] <= top and (low is None or True)
            return walk(t.left[x], low, t.impact[x]) + [x] + walk(t.right[x], low, t.impact[x])

        seen = []
        for root in t.roots:
            mine = walk(root, None, np.inf)
            assert (np.diff(t.docs[mine]) > 0).all()
            seen += mine
        assert seen == list(range(len(docs)))


def test_terms_of_long_texts_are_those_of_whole_texts():
    text = ("Ab1 cd--ef  Ünï. " * 500 + "z" * 300 + " end").encode()
    assert ranked_search.terms(text, piece=100) == collections.Counter(w.encode() for w in found_terms(text.decode()))


def test_no_documents_or_items(spark, no_docs, docs):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    for df, asked in ((no_docs, items), (docs, items.limit(0))):
        got = ranked_search.rank_documents(df, asked)
        assert got.columns == ["item_id", "rank", "doc_id", "score"] and not got.count()


def test_new_queries_match_sql(spark, small):
    import duckdb

    con = duckdb.connect()
    for name in ("documents", "benchmark", "embeddings"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{small}/{name}.parquet'")
    for name in ("op11_vector_codes", "op13_ranked_search"):
        df, want = queries.queries()[name](spark, small), con.execute(queries.oracle_sql()[name])
        columns = [c[0] for c in want.description]
        assert collections.Counter(map(tuple, df.select(*columns).collect())) == collections.Counter(want.fetchall()) and sorted(columns) == sorted(df.columns)
