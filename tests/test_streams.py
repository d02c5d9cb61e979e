"""Streams against the batch queries, over several batches and restarts."""

import datetime
import json
import random

import pytest
from pyspark.sql import functions as F

from gleaner.operators import posts
from gleaner.sources import readers
from gleaner.streaming import reports, routes

START = datetime.datetime(2024, 1, 1)


def calls(seed, n=120):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        at = START + datetime.timedelta(minutes=10 * i + rng.randrange(9))
        out.append((f"r{rng.randrange(4)}", at, rng.choice(("ok", "fail", "fail", "fail")), None))
    return out


def stream(spark, folder, checkpoint, out, late="12 hours"):
    df = routes.route_states(spark.readStream.schema(routes.CALLS).option("maxFilesPerTrigger", 1).parquet(str(folder)), late)
    query = df.writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(checkpoint)).trigger(availableNow=True).outputMode("append").start()
    query.awaitTermination(180)
    assert query.exception() is None


@pytest.mark.parametrize("seed", [1])
def test_route_states_equal_the_batch_query_after_restarts(spark, tmp_path, seed):
    rows = calls(seed)
    folder = tmp_path / "in"
    for part in range(3):
        mine = rows[40 * part : 40 * part + 40]
        random.Random(part).shuffle(mine)
        # calls of one batch arrive in two files and in any order, some hours late
        for half in (0, 1):
            spark.createDataFrame(mine[half::2], routes.CALLS).coalesce(1).write.mode("append").parquet(str(folder))
        stream(spark, folder, tmp_path / "checkpoint", tmp_path / "out")
    got = {r.route: (r.fails, r.disabled_until) for r in spark.read.parquet(str(tmp_path / "out")).groupBy("route").agg(F.max_by(F.struct("fails", "disabled_until"), F.struct("calls", "usable")).alias("x")).select("route", "x.*").collect()}
    whole = spark.createDataFrame(rows, routes.CALLS).select("route", "at", (F.col("kind") == "ok").alias("ok"))
    want = {r.route: (r.fails, r.disabled_until) for r in posts.route_state(whole, "route", "at", "ok").collect()}
    assert got == want


def test_quarantine_ends_by_hand_by_success_and_by_time(spark, tmp_path):
    minute = lambda m: START + datetime.timedelta(minutes=m)
    steps = [
        [("a", minute(0), "fail", None), ("a", minute(1), "fail", None), ("b", minute(0), "disable", 2.0), ("c", minute(0), "fail", None), ("c", minute(1), "fail", None)],
        [("b", minute(5), "enable", None), ("c", minute(6), "ok", None)],
        [("z", minute(600), "ok", None)], [("z", minute(700), "ok", None)],
    ]
    for rows in steps:
        spark.createDataFrame(rows, routes.CALLS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream(spark, tmp_path / "in", tmp_path / "checkpoint", tmp_path / "out", "1 hour")
    got = sorted((r.route, r.at, r.fails, r.usable) for r in spark.read.parquet(str(tmp_path / "out")).collect() if r.route != "z")
    assert ("a", minute(1), 2, False) in got and ("a", minute(31), 2, True) in got  # the timer
    assert ("b", minute(0), 0, False) in got and ("b", minute(5), 0, True) in got
    assert ("c", minute(1), 2, False) in got and ("c", minute(6), 0, True) in got


# reports --------------------------------------------------------------------------------------------------------------------

REPORT = reports.Report(("source",), "subject", "value")


def test_report_after_batches_equals_the_whole(spark, tmp_path):
    rng = random.Random(5)
    rows = [(rng.choice(("a", "a", "a", "b", None)), f"s{rng.randrange(9000)}", round(rng.random() * 100, 2)) for _ in range(20_000)] + [("b", None, None)]
    for part in range(3):
        spark.createDataFrame(rows[7000 * part : 7000 * part + 7000], "source string, subject string, value double").coalesce(2).write.mode("append").parquet(str(tmp_path / "in"))
        source = spark.readStream.schema("source string, subject string, value double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        query = reports.keep(source, REPORT, str(tmp_path / "report"), str(tmp_path / "checkpoint"))
        query.awaitTermination(180)
        assert query.exception() is None
    state = reports.newest(spark, str(tmp_path / "report"))
    got = {r.source: r for r in reports.shown(state, REPORT).collect()}
    whole = spark.createDataFrame(rows, "source string, subject string, value double").groupBy("source").agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(28,6)")).alias("t"), F.min("value").alias("lo"), F.max("value").alias("hi"), F.countDistinct("subject").alias("d")).collect()
    assert set(got) == {r.source for r in whole}
    for r in whole:
        g = got[r.source]
        assert (g.n, g.least, g.most, g["values"]) == (r.n, r.lo, r.hi, r.d) and abs(float(g["mean"]) - float(r.t) / r.n) < 1e-6
        assert abs(g.estimated - r.d) <= 4 * 1.04 / 2 ** (reports.LG_K / 2) * r.d


def test_a_repeated_batch_changes_nothing(spark, tmp_path):
    batches = [spark.createDataFrame([("a", "x", 1.0), ("a", "y", 2.0)], "source string, subject string, value double"), spark.createDataFrame([("a", "y", 4.0), ("b", "z", 3.0)], "source string, subject string, value double")]
    for number in (0, 1, 1):
        reports.merge_batch(batches[number], number, REPORT, str(tmp_path / "r"))
    got = {r.source: (r.n, r["values"], r.most) for r in reports.shown(reports.newest(spark, str(tmp_path / "r")), REPORT).collect()}
    assert got == {"a": (3, 2, 4.0), "b": (1, 1, 3.0)}


# large answers --------------------------------------------------------------------------------------------------------------


def test_one_large_answer_is_read_by_many_tasks(spark, tmp_path):
    rows = [{"indicator": {"id": "X", "value": f'said {{"indicator": {i % 7}}}, [x]'}, "country": {"id": "IR", "value": "Iran"}, "date": str(1900 + i % 120), "value": None if i % 5 == 0 else i / 4} for i in range(20_000)]
    (tmp_path / "one.json").write_text(json.dumps([{"page": 1}, rows], separators=(",", ":")))
    (tmp_path / "pretty.json").write_text(json.dumps([{"page": 1}, rows[:50]], indent=1))
    (tmp_path / "down.json").write_text("<html>502</html>")
    (tmp_path / "none.json").write_text('[{"page":1},null]')
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200k")
    try:
        out = readers.world_bank(spark, str(tmp_path), 2025)
        assert out.rdd.getNumPartitions() > 8
        got = sorted((r.indicator, r.period, r.value) for r in out.collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == sorted((r["indicator"]["value"], r["date"], r["value"]) for r in rows + rows[:50] if r["value"] is not None)
    query = readers.world_bank(spark, str(tmp_path), 2025, stream=True).writeStream.format("memory").queryName("landed").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert spark.table("landed").count() == len(got)
