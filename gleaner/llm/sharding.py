"""Sharding by sampled splitters (native): key ranges of near-equal bytes, dealt to a fixed number of shards.

Only DataFrame and SQL functions run here; of the rows just id, size and checksum travel, texts don't.

1. Key samples are drawn with a chance in proportion to a row's size; a row larger than the distance between samples weighs in full.
2. Quantiles of the samples' weights are the boundaries of many more ranges than shards. Keys are (doc_id, checksum, row number), so
   that rows of one id, a third of the table or more, still fall into many ranges.
3. Each row finds its range by a binary search of column expressions over the boundaries. Ranges that turn out overfull are
   subdivided at multiples of the bound, and a record larger than the bound is a piece of its own.
4. Pieces, at most a few per range, are dealt to the shards, largest first, each to the shard with the fewest bytes.
   A record's slot is its piece's place in its shard, and its place in the piece; pieces of a shard stand in the order of keys.

The law is ``bytes``: shards hold near-equal sums of sizes, at most one small piece apart wherever no single record exceeds a shard's share.
Records aren't grouped, so equal texts may go to different shards, and no other shard count is planned for (grown_shard is null).

What reaches the driver and all tasks: boundaries and pieces, at most MOST_RANGES of one and four times as many of the other.

Defined cases: a null or empty text has the size of its overhead and checksum 0; rows without an id come first; repeated rows are all placed, each
in a slot of its own; an empty table gives no rows; extra columns are ignored, whatever their names. Which of several wholly equal rows has
which slot isn't told, as they can't be told apart.
"""

from __future__ import annotations

import heapq
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gleaner.llm.common import check_columns, staged

#: Ranges for each shard at least; bytes of a range from which on there are more; ranges at most; samples for each range; bytes over the mean of a range from which on it is overfull.
RANGES_PER_SHARD, RANGE_BYTES, MOST_RANGES, SAMPLES_PER_RANGE, OVERFULL = 32, 128 << 20, 16384, 16, 1.5
_OUT = ("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def sized(docs: DataFrame, text: str, doc_id: str, overhead: int) -> DataFrame:
    """(id, size, crc, k, tie) of each row; (k, tie) is its key."""
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    df = docs.select(F.col(doc_id).alias("id"), (F.octet_length(body) + overhead).cast("long").alias("size"), F.crc32(body).alias("crc"), F.monotonically_increasing_id().alias("n"))
    return df.select("id", "size", "crc", F.coalesce(F.col("id").cast("long"), F.lit(-(2**63))).alias("k"), (F.col("crc") * (1 << 31) + F.col("n") % (1 << 31)).alias("tie"))


def sample_keys(records: DataFrame, total: int, draws: int, seed: int = 42) -> DataFrame:
    """(k, tie, weight): about so many keys at most, drawn by size; what a row's size has over the distance of draws is in its weight."""
    share = F.col("size") * F.lit(draws / total)
    chance = F.pmod(F.xxhash64("k", "tie", F.lit(seed)), F.lit(1 << 32)) / F.lit(float(1 << 32))
    return records.select("k", "tie", "size", share.alias("share")).filter(chance < F.col("share")).select("k", "tie", F.greatest(F.lit(1.0), "share").alias("weight"))


def splitters(samples: DataFrame, ranges: int) -> list[tuple[int, int]]:
    """The least sampled keys of each further quantile of the weights, ascending. The sample's size is bounded, so one task orders it."""
    weighed = samples.withColumns({"upto": F.sum("weight").over(W.orderBy("k", "tie")), "all": F.sum("weight").over(W.partitionBy())})
    quantile = F.floor((F.col("upto") - F.col("weight")) * ranges / F.col("all"))
    found = weighed.groupBy(quantile.alias("q")).agg(F.min(F.struct("k", "tie")).alias("least")).filter("q > 0").select("least.*").collect()
    return sorted({(r.k, r.tie) for r in found})


def range_of(records: DataFrame, bounds: list[tuple[int, int]]) -> DataFrame:
    """records with r, the number of boundaries at or below the key, by binary search in column expressions."""
    ks, ties = (F.from_json(F.lit(json.dumps([b[i] for b in bounds])), "array<bigint>") for i in (0, 1))
    df = records.withColumn("r", F.lit(0))
    for step in (1 << b for b in range(len(bounds).bit_length() - 1, -1, -1)):
        at = F.col("r") + (step - 1)
        k, tie = F.get(ks, at), F.get(ties, at)  # null beyond the end
        df = df.withColumn("r", F.when((F.col("k") > k) | ((F.col("k") == k) & (F.col("tie") >= tie)), F.col("r") + step).otherwise(F.col("r")))
    return df


def subdivided(placed: DataFrame, limit: int) -> DataFrame:
    """placed with piece and place (from 1, in its range): ranges above the limit are cut at its multiples, a record above it is a piece of its own."""
    own = W.partitionBy("r").orderBy("k", "tie").rowsBetween(W.unboundedPreceding, W.currentRow)
    df = placed.withColumns({"before": F.sum("size").over(own) - F.col("size"), "place": F.row_number().over(own)})
    return df.withColumn("piece", 2 * F.floor(F.col("before") / F.lit(limit)) + (F.col("size") > limit).cast("int")).drop("before", "k", "tie")


def deal(pieces: list[tuple[int, int, int, int, int]], shards: int) -> list[dict[str, int]]:
    """Of pieces (r, piece, bytes, rows, first place): the shard of each, largest first to the emptiest, and what to add to a row's place for its slot."""
    loads, of = [(0, s) for s in range(shards)], {}
    for r, piece, size, _, _ in sorted(pieces, key=lambda p: (-p[2], p[0], p[1])):
        load, s = heapq.heappop(loads)
        of[r, piece] = s
        heapq.heappush(loads, (load + size, s))
    used, out = [0] * shards, []
    for r, piece, _, n, first in sorted(pieces):
        s = of[r, piece]
        out.append({"r": r, "piece": piece, "shard": s, "add": used[s] - first})
        used[s] += n
    return out


def _relation(spark: SparkSession, rows: list[dict[str, int]], schema: str) -> DataFrame:
    """A small table of literals, without a detour over Python workers."""
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")))


def shard(docs: DataFrame, shards: int = 40, text: str = "text", doc_id: str = "doc_id", overhead: int = 16, seed: int = 42) -> DataFrame:
    """Per row: doc_id, size, text_crc32, law, shard (from 0), slot (gapless from 0 in each shard), grown_shard (null)."""
    check_columns(docs, text, doc_id)
    records = staged(sized(docs, text, doc_id, overhead), "sized")
    total = records.agg(F.sum("size")).first()[0]
    if total is None:
        placed = records.withColumns({"shard": F.lit(0), "slot": F.lit(0).cast("long")})
        return placed.select(*_columns(doc_id))
    ranges = min(max(shards * RANGES_PER_SHARD, -(-total // RANGE_BYTES)), MOST_RANGES)
    bounds = splitters(sample_keys(records, total, ranges * SAMPLES_PER_RANGE, seed), ranges)
    placed = staged(subdivided(range_of(records, bounds), int(OVERFULL * total / ranges) + 1), "placed")
    pieces = placed.groupBy("r", "piece").agg(F.sum("size"), F.count("*"), F.min("place")).collect()
    where = _relation(docs.sparkSession, deal([tuple(p) for p in pieces], shards), "r: int, piece: bigint, shard: int, add: bigint")
    return placed.join(F.broadcast(where), ["r", "piece"]).withColumn("slot", F.col("place") + F.col("add")).select(*_columns(doc_id))


def _columns(doc_id: str) -> list[Column]:
    return [F.col("id").alias(doc_id), F.col("size"), F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), F.col("shard"), F.col("slot"), F.lit(None).cast("int").alias("grown_shard")]
