"""What the fourth round's findings were about."""

from pyspark.sql import functions as F


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_jaccard_meets_sets_by_sketches(spark, monkeypatch):
    import random

    from gleaner.operators import matching as M

    random.seed(7)
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(random.sample(words, random.randint(40, 80))) for _ in range(300)]
    texts += [x.rsplit(" ", 3)[0] + " own" for x in texts[:20]] + texts[:5]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    met, group = [], type(df).groupBy

    def counted(self, *cols):
        if "other" in [c for c in cols if isinstance(c, str)]:  # pairs that share a rare token
            met.append(self.count())
        return group(self, *cols)

    monkeypatch.setattr(type(df), "groupBy", counted)
    found = M.jaccard_pairs(df, "id", "t", "[a-z0-9]+", 0.72)
    monkeypatch.undo()
    sets = [set(x.split()) for x in texts]
    want = {(a, b) for a in range(len(sets)) for b in range(a + 1, len(sets)) if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.72}
    assert {(r.a, r.b) for r in found.collect()} == want and len(want) >= 25
    assert met and met[0] < 1000  # shuffled once a token; 15 tokens or so for each found pair


def test_series_texts_are_not_shuffled_for_each_dossier(spark, small, monkeypatch):
    from gleaner.plans import catalogue, dossiers
    from gleaner.plans.tables import Tables

    class Two(Tables):
        def problem_subjects(self):  # some problems have two subjects, some have none
            own = super().problem_subjects()
            return own.filter("problem_id % 5 > 0").unionByName(own.filter("problem_id % 3 = 0").withColumn("subject", F.when(F.col("subject") < "F", "FRANCE").otherwise("CHINA")))

    grouped, group = [], type(spark.range(0)).groupBy

    def counted(self, *cols):
        if "section" in self.columns:
            grouped.append(self.filter("section = 'series'").count())
        return group(self, *cols)

    monkeypatch.setattr(type(spark.range(0)), "groupBy", counted)
    df = catalogue.queries()["dossier_text"](spark, small)
    monkeypatch.undo()
    assert df.count() > 0 and grouped and not any(grouped)
    t = Two(spark, small)
    from gleaner.operators import dossier as D

    assert rows(dossiers.dossier_text(t)) == rows(D.rendered(dossiers.dossier_full(t)))


def test_evidence_index_lists_figures_with_their_ids(spark, small):
    from gleaner.operators import verify as V
    from gleaner.plans import catalogue, dossiers
    from gleaner.plans.tables import Tables

    t = Tables(spark, small)
    index = catalogue.queries()["evidence_index"](spark, small).cache()
    assert index.columns == ["problem_id", "subject", "number", "ids"]
    member = index.filter("number IS NULL").select("problem_id", "subject")
    listed = index.filter("subject IS NULL").select("problem_id", "number", "ids").unionByName(index.filter("problem_id IS NULL").select("subject", "number", "ids").join(member, "subject").select("problem_id", "number", "ids"))
    one = lambda df: df.select("problem_id", "number", F.explode(F.split("ids", ",")).alias("evidence_id"))
    texts, series = dossiers._evidence(t)
    want = V.evidence_index(texts, series.join(t.problem_subjects(), "subject"), "problem_id").select("problem_id", "number", "evidence_id")
    assert want.exceptAll(one(listed).distinct()).isEmpty()
    # values of months are found, too
    month = t.measurements().filter("length(period) > 4").select("subject", F.concat_ws("|", "indicator", "source").alias("evidence_id"), V.plain_decimal(F.col("value")).alias("number"))
    held = index.filter("problem_id IS NULL").select("subject", F.explode(F.split("ids", ",")).alias("evidence_id"), "number")
    assert not month.isEmpty() and month.join(held, ["subject", "evidence_id", "number"], "left_anti").isEmpty()
    index.unpersist()
