"""Benchmark decontamination over a distributed positional inverted index.

``build`` cuts the documents into segments, one row each, as search engines do: a segment holds its documents' ids and
places and, for each of its terms, the sorted list of the term's positions. ``phrases`` takes the test windows to the
segments: for a window it starts from the term with the shortest list, takes the term's offset off its positions, and
intersects these with the other terms' lists, shortest first, until none are left or all terms agree.
``proximity`` finds places where all terms of an item stand within a span of words, in any order.

The test items are the stated query set, as a table of distinct windows. A set of at most ``BLOCK_BYTES`` is broadcast; a larger
one is dealt out by a join: each window goes, under the term of it that is rarest in the whole index, to the segments that hold that
term. The driver never sees more than one such block.

Defined cases: a null or empty text has no words, and is never hit; an item without words is ignored; a null item_id
is ignored; equal windows of several items count for each; repeated rows are each judged and returned; windows never
cross documents; a document longer than a segment has one of its own (its positions take some 30 bytes a word in one task); extra
columns are ignored or kept, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import bounded_batches, broadcast_if_small, check_columns, emit, numbered, rows, staged, trim

_WORD = regex.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: Bytes of text in a segment (a longer document has one of its own), and of windows that are broadcast at most.
SEGMENT_BYTES = 4_000_000
BLOCK_BYTES = 8_000_000
#: Between documents the positions jump, so that no window reaches over.
_APART = 1

INDEX_SCHEMA = "segment long, doc_ids array<long>, starts array<long>, sizes array<long>, terms array<binary>, list_ends array<long>, positions binary"
_ARROW = pa.schema(
    [("segment", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("starts", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())), ("terms", pa.list_(pa.binary())), ("list_ends", pa.list_(pa.int64())), ("positions", pa.binary())]
)


def words(text: bytes | None) -> list[bytes]:
    return _WORD.findall((text or b"").lower())


def _segment(segment: int, ids: list, texts: list[list[bytes]]) -> dict:
    number: dict[bytes, int] = {}
    starts, parts, at = [], [], 0
    for ws in texts:
        starts.append(at)
        parts.append(np.array([number.setdefault(w, len(number)) for w in ws], np.int32))
        at += len(ws) + _APART
    places = [np.arange(a, a + len(p), dtype=np.int32) for a, p in zip(starts, parts, strict=True)]
    term, place = np.concatenate([np.zeros(0, np.int32), *parts]), np.concatenate([np.zeros(0, np.int32), *places])
    order = np.argsort(term, kind="stable")
    sizes = np.bincount(term, minlength=len(number))
    # each list as differences, which Parquet packs well
    place = place[order]
    ends = np.cumsum(sizes)
    gaps = np.diff(place, prepend=np.int32(0)).astype("<i4")
    if len(place):
        first = np.concatenate([[0], ends[:-1]]).astype(np.int64)
        gaps[first] = place[first]
    return {"segment": segment, "doc_ids": ids, "starts": starts, "sizes": [len(p) for p in parts], "terms": list(number), "list_ends": ends.tolist(), "positions": gaps.tobytes()}


def build(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The index of all documents as a table of segments (INDEX_SCHEMA)."""
    check_columns(docs, text, doc_id)
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, held, number = [], [], 0, TaskContext.get().partitionId() << 32
        for i, t in rows(batches, "__id", "__text"):
            ids.append(i)
            texts.append(words(t))
            held += len(t or b"") + 8
            if held >= SEGMENT_BYTES:
                one = _segment(number, ids, texts)
                ids, texts, held, number = [], [], 0, number + 1
                yield emit({k: [v] for k, v in one.items()}, _ARROW)
                del one
                trim()
        if ids:
            yield emit({k: [v] for k, v in _segment(number, ids, texts).items()}, _ARROW)

    given = docs.select(F.col(doc_id).cast("long").alias("__id"), F.col(text).cast("binary").alias("__text"))
    return given.mapInArrow(run, INDEX_SCHEMA)


class Segment:
    """One row of the index, opened: position lists by term, and documents by position."""

    def __init__(self, row: dict[str, pa.Scalar]) -> None:
        self.segment = row["segment"].as_py()
        self.doc_ids = row["doc_ids"].values
        self.starts = row["starts"].values.to_numpy()
        self.sizes = row["sizes"].values.to_numpy()
        self.number = {w: i for i, w in enumerate(row["terms"].values.to_pylist())}
        ends = row["list_ends"].values.to_numpy()
        self.first = np.concatenate([[0], ends]).astype(np.int64)
        gaps = np.frombuffer(row["positions"].as_buffer(), "<i4")
        run = np.cumsum(gaps, dtype=np.int64)
        base = run[self.first[:-1]] - gaps[self.first[:-1]] if len(ends) else run[:0]
        self.place = run - np.repeat(base, np.diff(self.first))

    def listed(self, term: int) -> np.ndarray:
        return self.place[self.first[term] : self.first[term + 1]]

    def phrase(self, terms: list[bytes]) -> np.ndarray:
        """Positions at which the terms stand one after another."""
        number = self.number
        try:
            numbers = [number[t] for t in terms]
        except KeyError:
            return self.place[:0]
        first = self.first
        order = sorted(range(len(terms)), key=lambda i: first[numbers[i] + 1] - first[numbers[i]])
        at = self.listed(numbers[order[0]]) - order[0]
        for i in order[1:]:
            if not len(at):
                break
            other = self.listed(numbers[i])
            k = np.searchsorted(other, at + i)
            at = at[(k < len(other)) & (other[np.minimum(k, len(other) - 1)] == at + i)]
        return at

    def near(self, terms: list[bytes], span: int) -> np.ndarray:
        """Positions of the rarest term around which each other term stands within span words on either side."""
        numbers = [self.number.get(t) for t in set(terms)]
        if not numbers or None in numbers:
            return self.place[:0]
        numbers.sort(key=lambda n: self.first[n + 1] - self.first[n])
        at = self.listed(numbers[0])
        where = self.document(at)
        for n in numbers[1:]:
            other = self.listed(n)
            low = np.maximum(at - span, self.starts[where])
            high = np.minimum(at + span, self.starts[where] + self.sizes[where] - 1)
            ok = np.searchsorted(other, high, "right") > np.searchsorted(other, low)
            at, where = at[ok], where[ok]
        return at

    def document(self, at: np.ndarray) -> np.ndarray:
        # documents without words share a start with none, as positions jump between documents
        return np.searchsorted(self.starts, at, "right") - 1


def windows(text: bytes | None, width: int) -> Iterator[list[bytes]]:
    """An item's windows: width words in a row, or all words of a shorter one."""
    ws = words(text)
    for i in range(max(1, len(ws) - width + 1) if ws else 0):
        yield ws[i : i + width]


def sought(items: DataFrame, width: int | None, text: str = "text", item_id: str = "item_id") -> DataFrame:
    """(terms, items): the distinct windows of the items and the ids of those that have them; without a width, all words of an item at once."""
    check_columns(items, text, item_id)
    bounded_batches(items.sparkSession)
    schema = pa.schema([("item", pa.int64()), ("terms", pa.list_(pa.binary()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: dict[str, list] = {"item": [], "terms": []}
        for i, t in rows(batches, "__id", "__text"):
            for terms in windows(t, width) if width else filter(None, [words(t)]):
                out["item"].append(i)
                out["terms"].append(terms)
                if len(out["item"]) >= 5000:
                    yield emit(out, schema)
                    out = {"item": [], "terms": []}
        yield emit(out, schema)

    given = items.filter(F.col(item_id).isNotNull()).select(F.col(item_id).cast("long").alias("__id"), F.col(text).cast("binary").alias("__text"))
    return given.mapInArrow(run, "item long, terms array<binary>").groupBy("terms").agg(F.collect_set("item").alias("items"))


class _Asked:
    """What is sought in a segment: the same for all (broadcast), or its row's own list."""

    def __init__(self, held=None) -> None:
        self.held = held

    def of(self, row: dict[str, pa.Scalar]) -> list[tuple[list[bytes], list[int]]]:
        return self.held.value if self.held is not None else [(x["terms"], x["items"]) for x in row["asked"].as_py() or []]


def _put(index: DataFrame, asked: DataFrame) -> tuple[DataFrame, _Asked]:
    """The index, with a column of what is asked of each segment where that isn't broadcast."""
    asked = staged(asked, "sought")
    size = asked.agg(F.coalesce(F.sum(F.aggregate("terms", F.lit(0).cast("long"), lambda a, t: a + F.octet_length(t) + 9) + 8 * F.size("items")), F.lit(0))).first()[0]
    if size <= BLOCK_BYTES:
        found = [([bytes(t) for t in r["terms"]], list(r["items"])) for r in asked.collect()]
        return index, _Asked(index.sparkSession.sparkContext.broadcast(found))
    keyed = asked.withColumn("key", F.xxhash64("terms"))
    listed = index.select("segment", F.posexplode("terms").alias("at", "term"), "list_ends")
    listed = listed.select("segment", "term", (F.col("list_ends")[F.col("at")] - F.when(F.col("at") > 0, F.col("list_ends")[F.greatest(F.col("at") - 1, F.lit(0))]).otherwise(0)).alias("n"))
    terms = keyed.select("terms", "key", F.explode(F.array_distinct("terms")).alias("term"))
    # counted over the whole index; a window with a term that no segment has isn't sought at all
    often = listed.join(terms.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("n").alias("n"))
    rarest = terms.join(often, "term", "left").groupBy("key", "terms").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "term")).alias("least")).filter("least.n > 0")
    dealt = keyed.join(rarest.select("key", "terms", F.col("least.term").alias("term")), ["key", "terms"])
    own = listed.select("segment", "term").join(dealt, "term").groupBy("segment").agg(F.collect_list(F.struct("terms", "items")).alias("asked"))
    return index.join(own, "segment", "left"), _Asked()


_HIT = "__seg long, __row int, __id long, n_words long, items array<long>, runs array<long>"
_HIT_ARROW = pa.schema([("__seg", pa.int64()), ("__row", pa.int32()), ("__id", pa.int64()), ("n_words", pa.int64()), ("items", pa.list_(pa.int64())), ("runs", pa.list_(pa.int64()))])


def _open(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Segment, dict[str, pa.Scalar]]]:
    for batch in batches:
        for i in range(batch.num_rows):
            row = {n: batch.column(n)[i] for n in batch.schema.names}
            yield Segment(row), row
            trim()


def phrases(index: DataFrame, asked: DataFrame) -> DataFrame:
    """Per document: its words, the ids of the items with windows in it, and the runs of words hit (starts and ends). asked: as by ``sought``."""
    given, ask = _put(index, asked)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for seg, row in _open(batches):
            hits: dict[int, tuple[set[int], list[tuple[int, int]]]] = {}
            for terms, owners in ask.of(row):
                at = seg.phrase(terms)
                for p, d in zip(at.tolist(), seg.document(at).tolist(), strict=True):
                    items, spans = hits.setdefault(d, (set(), []))
                    items.update(owners)
                    spans.append((p, p + len(terms)))
            out = {n: [] for n in _HIT_ARROW.names}
            for d, (i, n) in enumerate(zip(seg.doc_ids.to_pylist(), seg.sizes.tolist(), strict=True)):
                items, spans = hits.get(d, ((), ()))
                start = int(seg.starts[d])
                for k, v in zip(_HIT_ARROW.names, (seg.segment, d, i, n, sorted(items), [x - start for r in merged(spans) for x in r]), strict=True):
                    out[k].append(v)
            yield emit(out, _HIT_ARROW)

    return given.mapInArrow(run, _HIT)


def merged(spans) -> list[tuple[int, int]]:
    """Spans as disjoint runs in order."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def proximity(index: DataFrame, items: DataFrame, span: int = 20, text: str = "text", item_id: str = "item_id") -> DataFrame:
    """(doc_id, item_id, position): the item's rarest term stands there, and all its others within span words of it."""
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("position", pa.int64())])
    given, ask = _put(index, sought(items, None, text, item_id))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for seg, row in _open(batches):
            ids = seg.doc_ids.to_pylist()
            for terms, owners in ask.of(row):
                at = seg.near(terms, span)
                if len(at):
                    d = seg.document(at)
                    for i in owners:
                        yield emit({"doc_id": [ids[k] for k in d.tolist()], "item_id": [i] * len(at), "position": at - seg.starts[d]}, schema)

    return given.mapInArrow(run, "doc_id long, item_id long, position long")


def contamination(
    docs: DataFrame, items: DataFrame, text: str = "text", doc_id: str = "doc_id", item_text: str = "text", item_id: str = "item_id", width: int = 13, share: int = 20
) -> DataFrame:
    """Per row: doc_id, n_words, n_hit, n_items, items_sha256, contaminated (n_hit > 0 and share * n_hit >= n_words)."""
    index = staged(build(docs, text, doc_id), "index")
    found = phrases(index, sought(items, width, item_text, item_id))
    hit = F.expr("aggregate(sequence(0, greatest(size(runs) DIV 2 - 1, 0)), 0L, (s, i) -> s + coalesce(get(runs, 2 * i + 1) - get(runs, 2 * i), 0L))")
    named = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    out = found.select(F.col("__id").alias(doc_id), "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(named.cast("binary"), 256).alias("items_sha256"))
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words")))


def decontaminate(docs: DataFrame, items: DataFrame, text: str = "text", doc_id: str = "doc_id", **how) -> DataFrame:
    """The rows of docs that aren't contaminated; documents are told apart by doc_id and, for rows that share one, by text."""
    plain, at = numbered(docs)
    key = F.xxhash64(F.col(at[doc_id]), F.coalesce(F.col(at[text]), F.lit("")))
    marked = plain.select(key.alias("key"), F.col(at[text]).alias("body"))
    bad = contamination(marked, items, text="body", doc_id="key", **how).filter("contaminated").select(F.col("key").alias("bad")).distinct()
    return plain.join(broadcast_if_small(staged(bad, "contaminated")), key == F.col("bad"), "left_anti").toDF(*docs.columns)
