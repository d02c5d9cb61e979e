"""SimHash near-duplicates: exact comparison of fingerprints in tiles, by numpy exclusive-or and bit counts.

Tiles. All distinct fingerprints are dealt to tiles by their number of ones, or, for larger inputs, by the numbers of
ones of their halves or quarters; a tile that would be too large is cut by a salt. A pair of tiles whose population counts
differ by more than the radius can't hold a link and is skipped; every other pair is dealt out, to a task that holds just
these two tiles. There both are sorted by the population counts of their quarters and cut into small tiles, pairs of
which are skipped by the same rule, and the rest is compared, each fingerprint with each, by exclusive-or and bit
counts. All links come from such a comparison, at any number of fingerprints, and each task gives a spanning forest of its
links, not all pairs.

Cost. With n distinct fingerprints each is sent to the tiles within reach: 9 at most by ones, 41 by halves, 321 by
quarters, times the salts of a tile (2 or 3 as tiles grow with n, more once they have MOST). Work within a task is the square of a tile, less what
is skipped, and at most 2^34 comparisons, some seconds; work on the whole is the square of n, less what is skipped.

Defined cases: null and empty texts have fingerprint zero and link like any other; a text of fewer words than a
shingle has one shingle; rows without a doc_id get a fingerprint and no component; repeated rows are all returned by
``fingerprint_components`` and one of them stays in ``deduplicate``; rows that share an id but not a text have each the component of their text, and all go if one
of them does; extra columns are ignored or kept, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import bounded_batches, broadcast_if_small, check_columns, emit, numbered, rows, staged, trim
from gleaner.llm.graph import components, forest

#: Fingerprints in a small tile; in a tile at least and at most.
SMALL, LEAST, MOST = 256, 4096, 1 << 17
#: Up to so many distinct fingerprints tiles go by all ones, by those of halves, beyond by those of quarters.
WHOLE, HALVES = 4_000_000, 64_000_000
_STEP, _SALT = 128, 1 << 24


def fingerprint(text: bytes | None, width: int = 4, seed: int = 42) -> int:
    """64 bits: bit i is one if it is set in over half of the hashes of the text's shingles of width words."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    body, n = b" ".join(words), max(1, len(words) - width + 1)
    gaps = np.flatnonzero(np.frombuffer(body, np.uint8) == 32)
    starts = np.concatenate([[0], gaps + 1])[:n].tolist()
    ends = np.concatenate([gaps, [len(body)]])[-n:].tolist()
    one = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 16384):
        h = np.array([one(body[a:b], seed) for a, b in zip(starts[at : at + 16384], ends[at : at + 16384], strict=True)], np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", width: int = 4) -> DataFrame:
    """(__id long, __fp long): the fingerprint of each row's whole text, its 64 bits as a signed long."""
    check_columns(docs, text, doc_id)
    bounded_batches(docs.sparkSession)
    schema = pa.schema([("__id", pa.int64()), ("__fp", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, fps = [], []
            for i, t in rows(iter([batch]), "__id", "__text"):
                ids.append(i)
                fps.append(fingerprint(t, width))
            yield emit({"__id": ids, "__fp": np.array(fps, np.uint64).view(np.int64)}, schema)
        trim()

    given = docs.select(F.col(doc_id).cast("long").alias("__id"), F.col(text).cast("binary").alias("__text"))
    return given.mapInArrow(run, "__id long, __fp long")


def _pairs_near(a: np.ndarray, b: np.ndarray, radius: int, within: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of a and b that link, by small tiles; within: a and b are the same, and each pair counts once."""
    shifts = np.arange(4, dtype=np.uint64) * np.uint64(16)

    def cut(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        ones = np.bitwise_count((fp[:, None] >> shifts) & np.uint64(0xFFFF)).astype(np.int16)
        order = np.lexsort(ones.T[::-1])
        starts = np.arange(0, len(fp), SMALL)
        return order, fp[order], np.minimum.reduceat(ones[order], starts), np.maximum.reduceat(ones[order], starts)

    if not len(a) or not len(b):
        return
    order_a, fa, low_a, high_a = cut(a)
    order_b, fb, low_b, high_b = (order_a, fa, low_a, high_a) if within else cut(b)
    for i in range(len(low_a)):
        # the least by which population counts of these two tiles' quarters can differ
        apart = np.maximum(0, np.maximum(low_a[i] - high_b, low_b - high_a[i])).sum(1)
        own = fa[i * SMALL : (i + 1) * SMALL, None]
        for j in np.flatnonzero(apart <= radius).tolist():
            if within and j < i:
                continue
            near = np.bitwise_count(own ^ fb[None, j * SMALL : (j + 1) * SMALL]) <= radius
            if within and i == j:
                near = np.triu(near, 1)
            if near.any():
                x, y = np.nonzero(near)
                yield order_a[i * SMALL + x], order_b[j * SMALL + y]


def compare(fp: np.ndarray, node: np.ndarray, side: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """The links of one pair of tiles, as a forest: within the one tile if all sides are 0, else between sides 0 and 1."""
    within = not side.any()
    a = np.flatnonzero(side == 0)
    b = a if within else np.flatnonzero(side == 1)
    found, held = [], 0
    for x, y in _pairs_near(fp[a], fp[b], radius, within):
        found.append((node[a[x]], node[b[y]]))
        held += len(x)
        if held > 2_000_000:
            found, held = [forest(*map(np.concatenate, zip(*found, strict=True)))], 0
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return forest(*map(np.concatenate, zip(*found, strict=True)))


def _layout(n: int) -> tuple[int, int]:
    """Into how many parts the bits are cut for the tiles' population counts, and the fingerprints of a tile at most."""
    return 1 if n <= WHOLE else 2 if n <= HALVES else 4, min(max(LEAST, n // 16), MOST)


def _cell(parts: int) -> Column:
    width = 64 // parts
    if parts == 1:
        return F.bit_count("__fp").cast("long")
    ones = [F.bit_count(F.shiftrightunsigned("__fp", i * width).bitwiseAND(F.lit((1 << width) - 1))) * F.lit(_STEP**i) for i in range(parts)]
    return sum(ones[1:], ones[0]).cast("long")


def links(distinct: DataFrame, radius: int = 4) -> DataFrame:
    """(a, b, t, u): a spanning set of all pairs of distinct(__fp, __node) within radius bits of each other, with the pair of tiles they come from."""
    parts, most = _layout(distinct.count())
    placed = distinct.withColumn("cell", _cell(parts))
    # at most 65, 33^2 or 17^4 rows
    cells = staged(placed.groupBy("cell").agg(F.ceil(F.count("*") / F.lit(most)).cast("long").alias("salts")), "cells")
    reach = sorted(sum(d * _STEP**i for i, d in enumerate(x)) for x in product(range(-radius, radius + 1), repeat=parts) if sum(map(abs, x)) <= radius)
    dealt = placed.join(F.broadcast(cells), "cell").select(
        F.col("__fp").alias("fp"), F.col("__node").alias("node"), (F.col("cell") * _SALT + F.pmod(F.xxhash64("__node"), F.col("salts"))).alias("own"), F.explode(F.array(*[F.col("cell") + d for d in reach])).alias("mate")
    )
    mates = cells.select(F.col("cell").alias("mate"), F.col("salts").alias("mate_salts"))
    dealt = dealt.join(F.broadcast(mates), "mate").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("mate_salts") - 1)))
    other = F.col("mate") * _SALT + F.col("salt")
    dealt = dealt.select("fp", "node", F.least("own", other).alias("t"), F.greatest("own", other).alias("u"), (F.col("own") > other).cast("int").alias("side"))
    names = ("fp", "node", "side", "t", "u")
    schema = pa.schema([(n, pa.int64()) for n in ("a", "b", "t", "u")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def judged(columns: dict[str, np.ndarray], bounds: np.ndarray) -> Iterator[pa.RecordBatch]:
            for i, j in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                t, u = int(columns["t"][i]), int(columns["u"][i])
                side = columns["side"][i:j]
                if t != u and (not side.any() or side.all()):
                    continue  # the other tile is empty
                a, b = compare(columns["fp"][i:j].view(np.uint64), columns["node"][i:j], side, radius)
                yield emit({"a": a, "b": b, "t": np.full(len(a), t), "u": np.full(len(a), u)}, schema)

        held: list[dict[str, np.ndarray]] = []
        for batch in batches:
            held.append({x: batch.column(x).to_numpy() for x in names})
            if sum(len(x["fp"]) for x in held) < 100_000:
                continue
            columns = {x: np.concatenate([h[x] for h in held]) for x in names}
            bounds = _bounds(columns)
            rest = bounds[-2]  # the last pair of tiles may go on
            held = [{x: v[rest:] for x, v in columns.items()}]
            yield from judged({x: v[:rest] for x, v in columns.items()}, bounds[:-1])
        if held:
            columns = {x: np.concatenate([h[x] for h in held]) for x in names}
            yield from judged(columns, _bounds(columns))
        trim()

    return dealt.repartition("t", "u").sortWithinPartitions("t", "u").mapInArrow(run, "a long, b long, t long, u long")


def _bounds(columns: dict[str, np.ndarray]) -> np.ndarray:
    """Where pairs of tiles start in the sorted columns, and the end."""
    new = np.zeros(len(columns["fp"]), bool)
    new[:1] = True
    for x in ("t", "u"):
        new[1:] |= columns[x][1:] != columns[x][:-1]
    return np.append(np.flatnonzero(new), len(new))


def _components(docs: DataFrame, text: str, doc_id: str, width: int, radius: int) -> DataFrame:
    """(id, fp, root) of each row."""
    marked = staged(fingerprints(docs, text, doc_id, width), "fingerprints")
    distinct = staged(marked.filter("__id IS NOT NULL").groupBy("__fp").agg(F.min("__id").alias("__node")), "distinct")
    roots = components(links(distinct, radius).select("a", "b"))
    classes = distinct.join(roots, F.col("__node") == F.col("node"), "left").select("__fp", F.coalesce("root", "__node").alias("root"))
    # a fingerprint of many copies is a hot key here: adaptive execution splits it
    return marked.join(classes, "__fp", "left").select(F.col("__id").alias("id"), F.col("__fp").alias("fp"), F.when(F.col("__id").isNotNull(), F.col("root")).alias("root"))


def fingerprint_components(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", width: int = 4, radius: int = 4) -> DataFrame:
    """Per row: doc_id, fingerprint (16 hex digits), component_id (the smallest doc_id reachable over links)."""
    found = _components(docs, text, doc_id, width, radius)
    return found.select(F.col("id").alias(doc_id), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("root").alias("component_id"))


def deduplicate(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", width: int = 4, radius: int = 4) -> DataFrame:
    """The rows of docs that stay: of each component that with the smallest doc_id, once; rows without doc_id stay."""
    found = staged(_components(docs, text, doc_id, width, radius), "components")
    gone = staged(found.filter("id != root").select(F.col("id").alias("gone")).distinct(), "gone")
    plain, at = numbered(docs)
    key = F.col(at[doc_id])
    left = plain.join(broadcast_if_small(gone), key.cast("long") == F.col("gone"), "left_anti")
    ids = found.filter("id IS NOT NULL")
    if ids.select("id").distinct().count() != ids.count():
        left = left.filter(key.isNotNull()).dropDuplicates([at[doc_id]]).unionByName(left.filter(key.isNull()))
    return left.toDF(*docs.columns)
