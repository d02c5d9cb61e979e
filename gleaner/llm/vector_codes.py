"""Product codes of vectors: exact Lloyd rounds with bounds kept in heaps.

A vector becomes integers, floor(scale * x), and is cut into equal consecutive parts; each part position has a codebook of its own, learnt by
Lloyd's rounds. All arithmetic that decides a result is on integers, so results don't depend on how rows are dealt to tasks.

Heaps. A block of vectors holds, for each part position and codebook entry, a binary heap of the parts assigned to that entry. A part's key is its slack
(the lower bound of its distance to any other entry less the upper bound of that to its own), plus the entry's cumulative drift at
the time it was pushed. An entry's drift grows each round by how far it moved and by the farthest that any other entry of the position
moved; a part can have changed only once the drift has reached its key. So each round pops from each heap just while the least key is at most the drift,
rescans the popped parts exactly, against all entries, and pushes them where they belong; the others aren't looked at. Bounds are doubles
and rounded to the safe side; equal distances have no slack, so they are always rescanned and go to the lower index.

Rounds. Each round reads the blocks and writes them to the shared folder with their new heaps, and with the changes of each entry's sum and count
that its moved parts make; the changes are summed over blocks by Spark. The driver holds codebooks, sums and drifts only: a few
times entries * dimensions integers. A lost executor costs tasks of the current round.

Defined cases: rows whose vector is null, empty, or holds null or non-finite components are left out; vectors of differing lengths, of a length that parts
doesn't divide, or with components beyond about 2^29 / scale / sqrt(part length) raise an error, as distances would pass 64 bits; rows without an id or label are coded,
a null id comes after all others when entries are chosen, null labels are one group; of repeated ids each row counts, the smaller
vector first; with fewer rows than entries there are as many entries as rows; an empty table gives no rows; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import bounded_batches, broadcast_if_small, check_columns, emit, release, scratch, staged, trim

#: Bytes of a block's integers; vectors of a block at most.
BLOCK_BYTES, BLOCK_ROWS = 4 << 20, 8192
#: Doubles are rounded by this share to the safe side.
_SLACK = 1e-9

_STATE = "ids array<bigint>, labels array<bigint>, vectors binary, keys binary, places binary, sizes binary, changes array<bigint>"
_STATE_ARROW = pa.schema([("ids", pa.list_(pa.int64())), ("labels", pa.list_(pa.int64())), ("vectors", pa.binary()), ("keys", pa.binary()), ("places", pa.binary()), ("sizes", pa.binary()), ("changes", pa.list_(pa.int64()))])


@dataclass
class Codebooks:
    """entries: parts x entries x part length, integers; drift: parts x entries, cumulative."""

    entries: np.ndarray
    drift: np.ndarray

    @property
    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()

    def distances(self, part: int, x: np.ndarray) -> np.ndarray:
        """Squared distances of rows of one part position to its entries."""
        return ((x[:, None, :] - self.entries[part][None]) ** 2).sum(2)

    def moved(self, sums: np.ndarray, counts: np.ndarray) -> Codebooks:
        """The codebooks after entries went to the floors of their parts' means; unused entries stay."""
        used = counts > 0
        entries = self.entries.copy()
        entries[used] = sums[used] // counts[used][:, None]
        step = np.sqrt(((entries - self.entries) ** 2).sum(2).astype(np.float64)) * (1 + _SLACK)
        others = np.zeros_like(step)
        if step.shape[1] > 1:
            top = np.sort(step, axis=1)[:, -2:]
            others = np.where(step == top[:, 1:], top[:, :1], top[:, 1:])
        return Codebooks(entries, (self.drift + step + others) * (1 + _SLACK))


class Block:
    """Vectors of one block with a heap of (key, row) for each part position and entry."""

    def __init__(self, ids: list, labels: list, vectors: np.ndarray, heaps: list[list[list[tuple[float, int]]]]) -> None:
        self.ids, self.labels, self.vectors, self.heaps = ids, labels, vectors, heaps

    @classmethod
    def start(cls, ids: list, labels: list, vectors: np.ndarray, books: Codebooks) -> Block:
        parts, k, _ = books.entries.shape
        return cls(ids, labels, vectors, [[[] for _ in range(k)] for _ in range(parts)])

    def _assign(self, books: Codebooks, part: int, rows: np.ndarray) -> np.ndarray:
        """Rescan the rows' parts exactly and push them; the entries they belong to."""
        length = books.entries.shape[2]
        found, keys = np.zeros(len(rows), np.int64), np.zeros(len(rows))
        for at in range(0, len(rows), 2048):
            d = books.distances(part, self.vectors[rows[at : at + 2048], part * length : (part + 1) * length].astype(np.int64))
            best = d.argmin(1)  # the first of equals
            own = np.sqrt(d[np.arange(len(d)), best].astype(np.float64)) * (1 + _SLACK)
            d[np.arange(len(d)), best] = np.iinfo(np.int64).max
            other = np.sqrt(d.min(1).astype(np.float64)) * (1 - _SLACK) if d.shape[1] > 1 else np.full(len(d), np.inf)
            found[at : at + 2048] = best
            keys[at : at + 2048] = other - own + books.drift[part][best]
        for entry, heap in enumerate(self.heaps[part]):
            mine = np.flatnonzero(found == entry)
            new = list(zip(keys[mine].tolist(), rows[mine].tolist(), strict=True))
            if len(new) > len(heap) // 4:
                heap += new
                heapq.heapify(heap)
            else:
                for item in new:
                    heapq.heappush(heap, item)
        return found

    def first(self, books: Codebooks) -> np.ndarray:
        """Assign all parts; the sums and counts of entries."""
        parts, k, length = books.entries.shape
        changes = np.zeros((parts, k, length + 1), np.int64)
        every = np.arange(len(self.vectors))
        for part in range(parts):
            self._count(changes[part], part, every, self._assign(books, part, every), 1, length)
        return changes

    def again(self, books: Codebooks) -> np.ndarray:
        """Pop what drift has reached, rescan it; the changes of entries' sums and counts."""
        parts, k, length = books.entries.shape
        changes = np.zeros((parts, k, length + 1), np.int64)
        for part in range(parts):
            rows, old = [], []
            for entry, heap in enumerate(self.heaps[part]):
                reached = books.drift[part, entry] * (1 + _SLACK) + _SLACK
                n = len(rows)
                while heap and heap[0][0] <= reached:
                    rows.append(heapq.heappop(heap)[1])
                old += [entry] * (len(rows) - n)
            if rows:
                at, before = np.array(rows), np.array(old)
                after = self._assign(books, part, at)
                moved = before != after
                self._count(changes[part], part, at[moved], before[moved], -1, length)
                self._count(changes[part], part, at[moved], after[moved], 1, length)
        return changes

    def _count(self, changes: np.ndarray, part: int, rows: np.ndarray, entries: np.ndarray, sign: int, length: int) -> None:
        np.add.at(changes[:, :length], entries, sign * self.vectors[rows, part * length : (part + 1) * length].astype(np.int64))
        np.add.at(changes[:, length], entries, sign)

    def codes(self) -> np.ndarray:
        """Row by row the entries of all parts."""
        out = np.zeros((len(self.vectors), len(self.heaps)), np.int64)
        for part, heaps in enumerate(self.heaps):
            for entry, heap in enumerate(heaps):
                out[[row for _, row in heap], part] = entry
        return out

    def pack(self, changes: np.ndarray) -> pa.RecordBatch:
        flat = [heap for heaps in self.heaps for heap in heaps]
        keys = np.array([key for heap in flat for key, _ in heap], np.float64)
        places = np.array([row for heap in flat for _, row in heap], np.int32)
        sizes = np.array([len(heap) for heap in flat], np.int32)
        values = (self.ids, self.labels, self.vectors.tobytes(), keys.tobytes(), places.tobytes(), sizes.tobytes(), changes.ravel())
        return emit({f.name: [v] for f, v in zip(_STATE_ARROW, values, strict=True)}, _STATE_ARROW)

    @classmethod
    def unpack(cls, row: dict, parts: int) -> Block:
        ids = row["ids"]
        keys, places, sizes = np.frombuffer(row["keys"]).tolist(), np.frombuffer(row["places"], np.int32).tolist(), np.frombuffer(row["sizes"], np.int32)
        ends = np.cumsum(sizes).tolist()
        flat = [list(zip(keys[e - n : e], places[e - n : e], strict=True)) for e, n in zip(ends, sizes.tolist(), strict=True)]
        k = len(flat) // parts
        vectors = np.frombuffer(row["vectors"], np.int32).reshape(len(ids), -1)
        return cls(ids, row["labels"], vectors, [flat[p * k : (p + 1) * k] for p in range(parts)])


def quantized(vectors: list, scale: int) -> np.ndarray:
    """floor(scale * x) of equally long vectors, as 32-bit integers; an error where they don't fit."""
    x = np.floor(np.array(vectors, np.float64) * scale)
    if x.size and np.abs(x).max() > 2**29 / math.sqrt(x.shape[1]):
        raise ValueError("a component is too large for exact distances in 64 bits")
    return x.astype(np.int32)


def usable(vectors: DataFrame, vec_id: str, embedding: str, label: str) -> DataFrame:
    """(id, label, x) of the rows whose vectors can be coded."""
    check_columns(vectors, vec_id, embedding, label)
    df = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.col(embedding).cast("array<double>").alias("x"))
    odd = F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return df.filter(F.col("x").isNotNull() & (F.size("x") > 0) & ~odd)


def _blocks(kept: DataFrame, books: Codebooks, scale: int) -> DataFrame:
    """The state after the first assignment: blocks of vectors with their heaps."""
    parts, _, length = books.entries.shape
    size = max(1, min(BLOCK_ROWS, BLOCK_BYTES // (4 * parts * length)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, labels, held, n = [], [], [], 0

        def done() -> pa.RecordBatch:
            block = Block.start(ids, labels, np.concatenate(held), books)
            return block.pack(block.first(books))

        for batch in batches:
            for at in range(0, batch.num_rows, size):
                part = batch.slice(at, size)
                if n and n + part.num_rows > size:
                    yield done()
                    ids, labels, held, n = [], [], [], 0
                x = part.column("x")
                held.append(quantized(x.flatten().to_numpy().reshape(part.num_rows, -1), scale))
                ids += part.column("id").to_pylist()
                labels += part.column("label").to_pylist()
                n += part.num_rows
        if n:
            yield done()
        trim()

    return kept.mapInArrow(run, _STATE)


def _round(state: DataFrame, books: Codebooks) -> DataFrame:
    parts = len(books.entries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                block = Block.unpack(batch.slice(i, 1).to_pylist()[0], parts)
                yield block.pack(block.again(books))
        trim()

    return state.drop("changes").mapInArrow(run, _STATE)


def _summed(state: DataFrame, shape: tuple[int, ...]) -> np.ndarray:
    """The blocks' changes, added up by Spark: one row for each number of the codebooks' sums and counts."""
    found = state.select(F.posexplode("changes").alias("at", "change")).groupBy("at").agg(F.sum("change").alias("change")).collect()
    out = np.zeros(math.prod(shape), np.int64)
    for r in found:
        out[r["at"]] = r["change"]
    return out.reshape(shape)


def learn(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> tuple[Codebooks, DataFrame] | None:
    """Codebooks after the rounds and the blocks assigned to them; None if no vector can be coded."""
    bounded_batches(vectors.sparkSession)
    kept = usable(vectors, vec_id, embedding, label)
    lengths = kept.agg(F.min(F.size("x")), F.max(F.size("x"))).first()
    if lengths[0] is None:
        return None
    if lengths[0] != lengths[1] or lengths[0] % parts:
        raise ValueError(f"vectors must be equally long, a multiple of {parts}; lengths are from {lengths[0]} to {lengths[1]}")
    first = quantized([r.x for r in kept.orderBy(F.col("id").asc_nulls_last(), "x").limit(entries).collect()], scale).astype(np.int64)
    start = first.reshape(len(first), parts, -1).swapaxes(0, 1)
    books = Codebooks(start, np.zeros(start.shape[:2]))
    before = set(scratch())
    state = staged(_blocks(kept, books, scale), "blocks")
    shape = (*start.shape[:2], start.shape[2] + 1)
    sums = np.zeros(shape, np.int64)
    for _ in range(rounds):
        sums += _summed(state, shape)
        books = books.moved(sums[:, :, :-1], sums[:, :, -1])
        state = staged(_round(state, books), "blocks")
        release([path for path in scratch()[:-1] if path not in before])  # earlier rounds' blocks
    return books, state


def coded(state: DataFrame, books: Codebooks) -> DataFrame:
    """(id, label, code, error) of each vector: entries as two hex digits in part order, and squared distances summed."""
    parts, _, length = books.entries.shape
    schema = pa.schema([("id", pa.int64()), ("label", pa.int64()), ("code", pa.string()), ("error", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                block = Block.unpack(batch.slice(i, 1).to_pylist()[0], parts)
                codes = block.codes()
                nearest = books.entries[np.arange(parts)[None], codes].reshape(len(codes), parts * length)
                error = ((block.vectors.astype(np.int64) - nearest) ** 2).sum(1)
                yield emit({"id": block.ids, "label": block.labels, "code": [bytes(c).hex() for c in codes.astype(np.uint8)], "error": error}, schema)
        trim()

    return state.select("ids", "labels", "vectors", "keys", "places", "sizes").mapInArrow(run, "id long, label long, code string, error long")


def encode(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", **how) -> DataFrame:
    """Per kept row: vec_id, code, error, label_error (of all rows of its label) and the codebooks' digest."""
    learnt = learn(vectors, vec_id, embedding, label, **how)
    if learnt is None:
        empty = usable(vectors, vec_id, embedding, label).limit(0)
        none: list[Column] = [F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256")]
        return empty.select(F.col("id").alias(vec_id), *none)
    books, state = learnt
    found = staged(coded(state, books), "codes")
    by_label = found.groupBy("label").agg(F.sum("error").alias("label_error"))
    f, b = found.alias("f"), broadcast_if_small(by_label).alias("b")
    out = f.join(b, F.col("f.label").eqNullSafe(F.col("b.label")))
    return out.select(F.col("f.id").alias(vec_id), "f.code", "f.error", "b.label_error", F.lit(books.digest).alias("codebooks_sha256"))
