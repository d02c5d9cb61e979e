"""Queries that SQL doesn't express, against brute force on the small tables and on literal rows."""

import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from gleaner.functions import persian as P
from gleaner.functions import rules as R
from gleaner.operators import intake as I
from gleaner.operators import linking as L
from gleaner.plans import catalogue
from gleaner.plans.tables import Tables


@pytest.fixture(scope="module")
def t(spark, small):
    return Tables(spark, small)


def run(name, spark, small):
    return catalogue.queries()[name](spark, small).collect()


def tokens(text, pattern):
    return set(re.findall(pattern, (text or "").lower()))


def test_greedy_distinct_claims(spark, small, t):
    groups = defaultdict(list)
    for r in t.claims().collect():
        groups[r.artifact_id].append((r.pos, tokens(r.proposition, "[a-z0-9]+")))
    want = set()
    for key, rows in groups.items():
        kept = []
        for pos, own in sorted(rows, key=lambda x: x[0]):
            ok = not any(own | k and len(own & k) / len(own | k) >= 0.72 for k in kept)
            want.add((key, pos, ok))
            if ok:
                kept.append(own)
    got = {(r.artifact_id, r.place, r.kept) for r in run("greedy_distinct_claims", spark, small)}
    assert got == want and {k for *_, k in got} == {True, False}


def test_title_clusters(spark, small, t):
    first = {}
    for r in t.claims().collect():
        if r.artifact_id not in first or r.pos < first[r.artifact_id][0]:
            first[r.artifact_id] = (r.pos, r.source, tokens(r.proposition, "[a-zA-Z\u0600-\u06FF]{4,}"))
    groups = defaultdict(list)
    for key, (_, source, words) in sorted(first.items()):
        groups[source].append((key, words))
    want = set()
    for source, rows in groups.items():
        taken = set()
        for i, (key, words) in enumerate(rows):
            if key in taken:
                continue
            members = [k for k, w in rows[i + 1 :] if k not in taken and len(words & w) >= 3]
            taken |= {key, *members}
            want |= {(source, k, key) for k in ([key, *members] if members else [])}
    got = {(r.source, r.place, r.cluster) for r in run("title_clusters", spark, small)}
    assert got == want and got


def stem(w):
    return w[:-1] if len(w) > 4 and w.endswith("s") else w


def domains(text):
    low = text.lower()
    for phrase in R.FALSE_FRIENDS:
        low = low.replace(phrase, " ")
    out = set()
    for name, terms in R.LINK_DOMAINS.items():
        if any(re.search(rf"\b{x}\b", low) if len(x) < 6 else x in low for x in terms):
            out.add(name)
    return out


def test_series_linker(spark, small, t):
    counts = defaultdict(lambda: [0, False])
    for r in t.measurements().collect():
        if r.status != "projection":
            counts[r.indicator][0] += 1
            counts[r.indicator][1] |= "-" in r.period
    families = lambda ws: {k for k, f in enumerate(R.FAMILIES) if ws & set(f)}
    want = set()
    for s in {r.statement for r in t.problems().collect()}:
        own = {stem(w) for w in tokens(s, "[a-z]{4,}")}
        scored = []
        for r in t.registry().collect():
            n, monthly = counts.get(r.indicator, (0, False))
            if not (n >= 5 or monthly):
                continue
            topics = {L.TOPIC_ALIASES.get(x.strip(), x.strip()) for x in r.topics.split(",")}
            words = {stem(w) for w in tokens(r.label, "[a-z]{4,}")} - set(L.GENERIC_WORDS)
            score = len(words & own) + len(families(words) & families(own))
            if topics & domains(s) and score:
                scored.append((-score, r.indicator))
        want |= {(s, i, -n, k + 1) for k, (n, i) in enumerate(sorted(scored)[:3])}
    got = {(r.statement, r.indicator, r.score, r.place) for r in run("series_linker", spark, small)}
    assert got == want and got


def query_words(text):
    low = (text or "").lower().replace("?", " ")
    low = re.sub("^(?:" + "|".join(I.LEADS) + ")+", "", low)
    words = [re.sub(r"^[^\w]+|[^\w]+$", "", w) for w in re.split(r"\s+", low.replace(",", " "))]
    return list(dict.fromkeys(w for w in words if len(w) > 3 and w not in I.QUERY_STOP))


def test_query_phrases(spark, small, t):
    asked = defaultdict(list)
    for r in t.questions().collect():
        if len(re.sub("[^a-zA-Z]", "", r.question)) >= 4:
            asked[r.problem_id].append((r.asked, r.question_id, r.question))
    want = set()
    for p in t.problems().collect():
        words = []
        for *_, q in sorted(asked[p.problem_id]):
            if len(words) < 6:
                words += [w for w in query_words(q) if w not in words]
        want.add((p.problem_id, " ".join(words or query_words(p.statement))[:140]))
    assert {(r.problem_id, r["query"]) for r in run("query_phrases", spark, small)} == want


def test_entity_merge(spark, small, t):
    rows = {r.s_suppkey: r.s_name for r in t.raw("supplier").collect()}
    names = {}
    for k in sorted(rows, reverse=True):  # the smallest id counts
        names[rows[k].strip().lower()] = names[f"sup {k}"] = k
    merged, fresh = {k: [f"sup {k}"] for k in rows}, {}
    for k in rows:
        name = f"SUP {k + 3}"
        if (at := names.get(name.lower())) is not None:
            merged[at] = list(dict.fromkeys([*merged[at], *sorted({name, "extra"})]))
        else:
            fresh[name] = ["extra"]
    want = {(k, rows[k], tuple(a)) for k, a in merged.items()} | {(None, n, tuple(a)) for n, a in fresh.items()}
    assert {(r.entity_id, r.entity_name, tuple(r.aliases)) for r in run("entity_merge", spark, small)} == want


def test_persian_normalise(spark, small, t):
    text = {r.question_id: f"{r.question_fa} {r.asked} می شود  ،،" for r in t.questions().collect()}
    z = P.ZWNJ

    def normal(s):
        s = s.translate(str.maketrans("يك", "یک"))
        s = re.sub(r"(^|[\s(«])(ن?می) +(?=[؀-ۿ])", rf"\1\2{z}", s)
        s = re.sub(r"(?<=[؀-ۿ]) +(هایی|های|ها|ترین|تر)(?=[\s،؛.!؟:)]|$)", rf"{z}\1", s)
        s = re.sub(r"(?<=[0-9۰-۹])\.(?=[0-9۰-۹])", "٫", s).translate(str.maketrans("0123456789", P.DIGITS))
        s = re.sub(r"([،؛!؟])\1+", r"\1", re.sub(r" +([،؛.!؟:])", r"\1", s))
        return re.sub(r"[ \t]{2,}", " ", s).strip(" ")

    for r in run("persian_normalise", spark, small):
        assert r.normalised == normal(text[r.question_id])
        assert r.issues == sum(len(re.findall(p, text[r.question_id])) for p in (r"(?:^|\s)ن?می [؀-ۿ]", r" [،؛.!؟:]", r"([،؛!؟])\1", r"[0-9]"))


def test_persian_repairs(spark, small, t):
    digits = str.maketrans("0123456789.", P.DIGITS + "٫")
    for r in run("persian_repairs", spark, small):
        value = r.question_id * 7919 + 1_000_000
        size, name = (1e9, "میلیارد") if value >= 1e9 else (1e6, "میلیون")
        shown = f"{value / size:.1f}".rstrip("0").rstrip(".").translate(digits)
        # the second of two equal sources goes, the number is rounded, sentences are short
        assert r.repaired.endswith(f" {shown} {name} (منبع: بانک) و") and r.repaired.count("منبع") == 1


def test_split_runons(spark):
    long = " ".join(["کلمه"] * 20 + ["و"] + ["واژه"] * 20) + "."
    rows = spark.createDataFrame([(long,), ("کوتاه است.",), (None,)], "x string")
    got = [r[0] for r in rows.select(P.split_runons(F.col("x"))).collect()]
    assert got[0] == " ".join(["کلمه"] * 20) + ". " + " ".join(["واژه"] * 20) + "." and got[1:] == ["کوتاه است.", None]
