"""Reports kept up to date from increments: mergeable states, merged batch by batch.

A state has one row per group: exact counts, sums (decimals), extremes, and a sketch of the distinct values. Beside the sketch stands an exact count, for which the values seen so far are a table
of their own; each batch adds to it what it lacks. Every batch writes a state of its own number from that of the number before, so a batch that is run again after a failure
writes the same state again.

The sketch is HyperLogLog with 2^LG_K registers: its relative standard error is 1.04 / sqrt(2^LG_K), 1.6 % at 12.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gleaner.operators.stages import _delete

LG_K = 12
#: States of so many batches stay, so that the one before a repeated batch is there.
KEPT = 2


@dataclass(frozen=True)
class Report:
    """Groups, the column whose distinct values are counted, and the one that is summed and whose extremes are told."""

    keys: tuple[str, ...]
    distinct: str
    measure: str


def partial(rows: DataFrame, report: Report) -> DataFrame:
    """The state of some rows alone, without the exact count."""
    m = F.col(report.measure)
    return rows.groupBy(*report.keys).agg(
        F.count("*").alias("n"), F.sum(m.cast("decimal(28,6)")).cast("decimal(38,6)").alias("total"), F.min(m).alias("least"), F.max(m).alias("most"), F.hll_sketch_agg(F.col(report.distinct).cast("string"), F.lit(LG_K)).alias("sketch")
    )


def merged(parts: DataFrame, report: Report) -> DataFrame:
    """One state of several: groups meet, sketches are united."""
    return parts.groupBy(*report.keys).agg(F.sum("n").alias("n"), F.sum("total").cast("decimal(38,6)").alias("total"), F.min("least").alias("least"), F.max("most").alias("most"), F.hll_union_agg("sketch").alias("sketch"), F.sum("values").alias("values"))


def shown(state: DataFrame, report: Report) -> DataFrame:
    """The report of a state: count, mean, extremes, distinct values as estimated and exact."""
    return state.select(*report.keys, "n", (F.col("total") / F.col("n")).alias("mean"), "least", "most", F.hll_sketch_estimate("sketch").alias("estimated"), "values")


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def merge_batch(batch: DataFrame, number: int, report: Report, path: str) -> None:
    """Write the state after batch number: that of the number before, where there is one, and the batch's own."""
    spark = batch.sparkSession
    own, found = partial(batch, report), batch.select(*report.keys, F.col(report.distinct).cast("string").alias("__value")).filter("__value IS NOT NULL").distinct()
    before = f"{path}/state/{number - 1}"
    if _exists(spark, before):
        # values of this number would be those of an earlier try
        seen = spark.read.parquet(f"{path}/values").filter(F.col("__batch") < number).drop("__batch")
        same = [found[c].eqNullSafe(seen[c]) for c in found.columns]
        found = found.join(seen, same, "left_anti")
    found.write.mode("overwrite").parquet(f"{path}/values/__batch={number}")
    fresh = spark.read.schema(found.schema).parquet(f"{path}/values/__batch={number}").groupBy(*report.keys).agg(F.count("*").alias("values"))
    o, f = own.alias("o"), fresh.alias("f")
    both = o.join(f, [F.col(f"o.{k}").eqNullSafe(F.col(f"f.{k}")) for k in report.keys], "left").select("o.*", F.coalesce("f.values", F.lit(0)).alias("values"))
    if _exists(spark, before):
        both = spark.read.parquet(before).unionByName(both)
    merged(both, report).write.mode("overwrite").parquet(f"{path}/state/{number}")
    if number >= KEPT and _exists(spark, old := f"{path}/state/{number - KEPT}"):
        _delete(spark, old)


def keep(rows: DataFrame, report: Report, path: str, checkpoint: str) -> StreamingQuery:
    """Merge each batch of a stream into the report's state; ends when all that has landed is in."""
    return rows.writeStream.foreachBatch(lambda batch, number: merge_batch(batch, number, report, path)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def newest(spark: SparkSession, path: str) -> DataFrame:
    """The last state written."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/state")
    listed = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(where)
    return spark.read.parquet(f"{path}/state/{max(int(x.getPath().getName()) for x in listed)}")
