"""Small relational helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: The rows that a task is meant to sort or to hold, where a table is dealt out by its count.
TASK_ROWS = 1_000_000


def dealt(df: DataFrame, key: str, rows: int) -> DataFrame:
    """df, of about so many rows, dealt out by key. A large table goes to more tasks than the session's, so that a task's memory doesn't grow with it."""
    tasks = -(-rows // TASK_ROWS)
    return df.repartition(tasks, key) if tasks > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df.repartition(key)


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str | None = None) -> DataFrame:
    """The first k rows of each key in the given total order. Spark prunes each task's rows to k before the shuffle."""
    n = rank or "__rank"
    out = df.withColumn(n, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col(n) <= k)
    return out if rank else out.drop(n)


def latest(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """One row per key: the one with the greatest order columns. An aggregate, so it combines before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max(F.struct(*order, *[c for c in rest if c not in order])).alias("__best"))
    return best.select(*keys, *[F.col(f"__best.{c}").alias(c) for c in rest]).select(*df.columns)


def insert_absent(new: DataFrame, old: DataFrame, keys: list[str], order: list[Column] | None = None) -> DataFrame:
    """Rows of new whose keys (null-safe) old lacks; the first per key in order, or any."""
    rows = top_k(new, keys, order, 1) if order else new.dropDuplicates(keys)
    same = [rows[k].eqNullSafe(old[k]) for k in keys]
    return rows.join(old.select(*keys).distinct(), same, "left_anti")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old with the rows of new in place of those with the same keys."""
    kept = old.join(new.select(*keys).distinct(), [old[k].eqNullSafe(new[k]) for k in keys], "left_anti")
    return kept.unionByName(new, allowMissingColumns=True)


def undirected(edges: DataFrame, a: str, b: str, keys: list[str]) -> DataFrame:
    """Edges with a <= b, each once per keys."""
    return edges.select(*keys, F.least(a, b).alias(a), F.greatest(a, b).alias(b), *[c for c in edges.columns if c not in (a, b, *keys)]).dropDuplicates([*keys, a, b])
