"""Picking in rounds against the plain fold."""

import random

import pytest

from gleaner.operators import picking as P


def fold_clusters(rows, shared):
    out, groups = set(), {}
    for g, n, t in rows:
        groups.setdefault(g, []).append((n, set(t.split())))
    for g, texts in groups.items():
        texts.sort(key=lambda x: x[0])
        taken = set()
        for i, (n, words) in enumerate(texts):
            if n in taken:
                continue
            members = [m for m, w in texts[i + 1 :] if m not in taken and len(words & w) >= shared]
            taken |= {n, *members}
            out |= {(g, m, n) for m in [n, *members]} if members else set()
    return out


def fold_distinct(rows, threshold):
    out, groups = set(), {}
    for g, n, t in rows:
        groups.setdefault(g, []).append((n, set(t.split())))
    for g, texts in groups.items():
        kept = []
        for n, own in sorted(texts, key=lambda x: x[0]):
            ok = not any(own | k and len(own & k) >= threshold * len(own | k) for k in kept)
            out.add((g, n, ok))
            kept += [own] if ok else []
    return out


def texts(seed, n=160, vocabulary=14):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(vocabulary)]
    return [(rng.choice(("x", "x", "y", None)), i, " ".join(rng.sample(words, rng.choice((0, 1, 3, 4, 5, 6))))) for i in rng.sample(range(10 * n), n)]


@pytest.mark.parametrize("seed,vocabulary", [(1, 14), (2, 40), (3, 8)])
def test_rounds_equal_the_fold(spark, seed, vocabulary):
    shares = P.SHARES if seed != 2 else (1.0,)
    rows = texts(seed, vocabulary=vocabulary)
    df = spark.createDataFrame(rows, "g string, n int, t string").repartition(3)
    assert {tuple(r) for r in P.seed_clusters(df, ["g"], "n", "t", "[a-z0-9]+", 3, shares).collect()} == fold_clusters(rows, 3)
    got = [tuple(r) for r in P.greedy_distinct(df, ["g"], "n", "t", "[a-z0-9]+", 0.5, shares).collect()]
    assert len(got) == len(rows) and set(got) == fold_distinct(rows, 0.5)


def test_a_chain_alternates(spark):
    # each text is similar to its neighbours only: every second one is picked
    rows = [("g", i, f"a{i} b{i} a{i + 1} b{i + 1}") for i in range(12)]
    df = spark.createDataFrame(rows, "g string, n int, t string")
    got = {tuple(r) for r in P.greedy_distinct(df, ["g"], "n", "t", "[a-z0-9]+", 0.3, (1.0,)).collect()}
    assert got == {("g", i, i % 2 == 0) for i in range(12)} == fold_distinct(rows, 0.3)


def test_one_large_group_of_similar_texts_stays_apart(spark):
    """A source whose titles nearly all share three words: no plan gathers the group, and few pairs are listed."""
    rng = random.Random(7)
    rows = [("one", i, " ".join(["same", "opening", "words"] * (i % 10 != 0) + [f"x{rng.randrange(4000)}y" for _ in range(3)])) for i in range(4000)]
    df = spark.createDataFrame(rows, "g string, n int, t string")
    listed = []
    similar = P._similar

    def counted(*a):
        listed.append(similar(*a).count())
        return similar(*a)

    P._similar = counted
    try:
        out = P.seed_clusters(df, ["g"], "n", "t", "[a-z0-9]+", 3)
    finally:
        P._similar = similar
    assert {tuple(r) for r in out.collect()} == fold_clusters(rows, 3)
    assert sum(listed) < 4000 * 40  # of 6.5 million similar pairs
    assert "Pandas" not in out._jdf.queryExecution().toString() and "Window" not in out._jdf.queryExecution().toString()


def test_no_texts_and_nulls(spark):
    df = spark.createDataFrame([], "g string, n int, t string")
    assert not P.seed_clusters(df, ["g"], "n", "t", "[a-z]+").count() and not P.greedy_distinct(df, ["g"], "n", "t", "[a-z]+", 0.5).count()
    df = spark.createDataFrame([("g", 1, None), ("g", 2, ""), ("g", 3, "a b"), ("g", 4, "b a")], "g string, n int, t string")
    assert {tuple(r) for r in P.greedy_distinct(df, ["g"], "n", "t", "[a-z]+", 0.5).collect()} == {("g", 1, True), ("g", 2, True), ("g", 3, True), ("g", 4, False)}
