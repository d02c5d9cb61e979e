"""Ranked lexical search over inverted treaps.

``build`` cuts the documents into segments, one row each: its documents in the order of ids with their lengths, and for each of its terms
the list of (document, occurrences). ``search`` first adds up, over all segments, in how many documents each query term stands, then opens
the segments again. There each query term's list becomes a treap: a search tree by document and a heap by impact, so the root of a
subtree is its range's largest impact. Treaps are built when a segment is searched, as impacts rest on the whole
corpus' counts. They take linear space and are built by pointer jumping over arrays.

Traversal. An item's terms walk their treaps together over shrinking ranges of documents. The weighted impacts of the
subtrees' roots, summed, bound every score in a range; ranges whose bound is below the k-th best score so far, of this and of the task's
earlier segments, are pruned. Other ranges are split at the document of the largest weighted impact: each term's search path to that document gives its
exact score and the roots of both halves. Ranges of at most LEAF postings, all terms together, are scored from the lists, best bounds first. All ranges
of a level, of many items at once, go through the same array operations.

The k best of each task meet in one ranking per item, of tasks * k rows at most. Query items come in blocks of BLOCK_BYTES of text, so neither
the driver nor a task holds more than one block; each block reads the index twice.

Scores are integers, as the contract gives them. N counts documents with a term, L all their terms, df a term's documents.

Defined cases: a null or empty text, or one without terms, is never found and counts nowhere; an item without terms, or none of whose terms occurs, has no
rows; equal rows of items count once, rows that share an id but not a text are ranked each on its own; repeated documents are ranked each; a null doc_id comes last among equals,
a null item_id is an item; a document longer than a segment has one of its own; extra columns are ignored, whatever their names; an empty table gives no rows.
Ids that aren't integers raise an error.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gleaner.llm.common import bounded_batches, check_columns, emit, rows, staged, trim

#: Bytes of text in a segment (a longer document has one of its own), and of query texts at once (a longer item is a block of its own).
SEGMENT_BYTES, BLOCK_BYTES = 16_000_000, 8_000_000
#: Postings of a range, all terms together, that is scored from the lists; leaves' entries scored at once; terms of items that are searched for together.
LEAF, LEAF_ENTRIES, TOGETHER = 1024, 20_000, 20_000

_FOLD = bytes(c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else c + 32 if 0x41 <= c <= 0x5A else 32 for c in range(256))
INDEX_SCHEMA = "segment long, doc_ids array<long>, sizes array<long>, n_docs long, n_terms long, terms binary, counts binary, docs binary, tfs binary"
_ARROW = pa.schema(
    [("segment", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())), ("n_docs", pa.int64()), ("n_terms", pa.int64()), ("terms", pa.binary()), ("counts", pa.binary()), ("docs", pa.binary()), ("tfs", pa.binary())]
)


def terms(text: bytes | None, piece: int = 1 << 22) -> Counter[bytes]:
    """A text's terms with their occurrences: runs of letters and digits, all signs beyond ASCII included, A-Z lower-cased."""
    folded, found, at = (text or b"").translate(_FOLD), Counter(), 0
    while at < len(folded):
        to = folded.find(b" ", at + piece)
        to = len(folded) if to < 0 else to
        found.update(folded[at:to].split(b" ") if at == 0 and to == len(folded) and b"  " not in folded else folded[at:to].split())
        at = to
    del found[b""]
    return found


def _segment(segment: int, held: list[tuple[int | None, int, np.ndarray, np.ndarray]], number: dict[bytes, int]) -> pa.RecordBatch:
    held.sort(key=lambda d: (d[0] is None, d[0] or 0))
    term = np.concatenate([d[2] for d in held])
    order = np.argsort(term, kind="stable")
    docs = np.repeat(np.arange(len(held), dtype="<i4"), [len(d[2]) for d in held])[order]
    tfs = np.concatenate([d[3] for d in held])[order]
    counts = np.bincount(term, minlength=len(number)).astype("<i4")
    sizes = [d[1] for d in held]
    row = (segment, [d[0] for d in held], sizes, len(held), sum(sizes), b" ".join(number), counts.tobytes(), docs.tobytes(), tfs.astype("<i4").tobytes())
    return emit({f.name: [v] for f, v in zip(_ARROW, row, strict=True)}, _ARROW)


def build(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The index of all documents as a table of segments (INDEX_SCHEMA)."""
    check_columns(docs, text, doc_id)
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, number, size, segment = [], {}, 0, TaskContext.get().partitionId() << 32
        for i, t in rows(batches, "__id", "__text"):
            if not (found := terms(t)):
                continue
            own = np.fromiter((number.setdefault(w, len(number)) for w in found), np.int32, len(found))
            held.append((i, found.total(), own, np.fromiter(found.values(), np.int64, len(found))))
            size += len(t)
            if size >= SEGMENT_BYTES:
                yield _segment(segment, held, number)
                held, number, size, segment = [], {}, 0, segment + 1
                trim()
        if held:
            yield _segment(segment, held, number)

    given = docs.select(F.col(doc_id).cast("long").alias("__id"), F.col(text).cast("binary").alias("__text"))
    return given.mapInArrow(run, INDEX_SCHEMA)


def _greater(impact: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place the nearest place before it in its list with an impact as large or larger, and the nearest after it with a larger one; -1 for none."""

    def jump(at: np.ndarray, beyond: np.ndarray, step: int, smaller) -> np.ndarray:
        to = at + step
        open_ = at
        while len(open_):
            t = to[open_]
            open_ = open_[(t >= beyond[open_]) if step < 0 else (t <= beyond[open_])]
            open_ = open_[smaller(impact[to[open_]], impact[open_])]
            to[open_] = to[to[open_]]  # all between a place and the one it points to is smaller
        out = (to < beyond) if step < 0 else (to > beyond)
        to[out] = -1
        return to

    at = np.arange(len(impact))
    return jump(at, starts, -1, np.less), jump(at, ends, 1, np.less_equal)


class Treaps:
    """The treaps of some lists: for each posting its document, impact and children; for each list its root."""

    def __init__(self, docs: np.ndarray, impact: np.ndarray, sizes: np.ndarray) -> None:
        n, ends = len(docs), np.cumsum(sizes)
        self.n_docs = int(docs.max()) + 1 if n else 0
        self.docs = np.append(docs.astype(np.int64), -1)
        self.impact = np.append(impact, 0)  # what place -1 has
        self.left, self.right = np.full(n + 1, -1), np.full(n + 1, -1)
        of = np.repeat(np.arange(len(sizes)), sizes)
        before, after = _greater(impact, (ends - sizes)[of], (ends - 1)[of])
        # the parent is the lesser of both; of equals the earlier is the greater
        up = (before >= 0) & ((after < 0) | (self.impact[before] < self.impact[after]))
        self.right[before[up]] = np.flatnonzero(up)
        down = (after >= 0) & ~up
        self.left[after[down]] = np.flatnonzero(down)
        self.roots = np.full(len(sizes), -1)
        top = (before < 0) & (after < 0)
        self.roots[of[top]] = np.flatnonzero(top)
        self.order = of * (self.n_docs + 1) + docs  # ascending: lists, and documents in each

    def split(self, node: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """By the search path from each node to document at: the root of what comes before it, the posting of the document itself, the root of what comes after; -1 for none."""
        left, own, right = (np.full(len(node), -1) for _ in range(3))
        now, going = node.copy(), np.flatnonzero(node >= 0)
        while len(going):
            x = now[going]
            doc, to = self.docs[x], at[going]
            less, more = doc < to, doc > to
            for side, hit in ((left, less), (right, more)):
                g = going[hit]
                new = side[g] < 0
                side[g[new]] = x[hit][new]
            same = ~(less | more)
            g, y = going[same], x[same]
            own[g] = y
            for side, child in ((left, self.left), (right, self.right)):
                new = side[g] < 0
                side[g[new]] = child[y[new]]
            now[going] = np.where(less, self.right[x], self.left[x])
            going = going[~same & (now[going] >= 0)]
        return left, own, right

    def within(self, node: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The root of each subtree's part in a range of documents."""
        node, going = node.copy(), np.flatnonzero(node >= 0)
        while len(going):
            x = node[going]
            doc = self.docs[x]
            below, above = doc < low[going], doc > high[going]
            going, x, below = going[below | above], x[below | above], below[below | above]
            node[going] = np.where(below, self.right[x], self.left[x])
            going = going[node[going] >= 0]
        return node

    def best(self, owner: np.ndarray, lists: np.ndarray, weights: np.ndarray, k: int, least: np.ndarray, leaf: int = LEAF) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(items, documents, scores) among which are each item's k best of its least score or more.

        owner, lists, weights: of each term of some items, the item's number (ascending from 0), the list, the weight above 0; least: for each item.
        """
        found: list[tuple[np.ndarray, ...]] = []
        least = least.copy()
        top = np.zeros((len(least), k), np.int64)  # each item's best scores so far

        def seen(item: np.ndarray, doc: np.ndarray, score: np.ndarray) -> None:
            good = score >= least[item]
            item, doc, score = item[good], doc[good], score[good]
            found.append((item, doc, score))
            touched, at = np.unique(item, return_inverse=True)
            every = np.concatenate([np.repeat(np.arange(len(touched)), k), at])
            values = np.concatenate([top[touched].ravel(), score])
            order = np.lexsort([-values, every])
            first = np.searchsorted(every[order], np.arange(len(touched)))
            top[touched] = values[order[first[:, None] + np.arange(k)]]
            least[touched] = np.maximum(least[touched], top[touched, k - 1])

        leaves: list[tuple[np.ndarray, ...]] = []
        term, node, of = np.arange(len(lists)), self.roots[lists], owner
        items, low, high = np.arange(len(least)), np.zeros(len(least), np.int64), np.full(len(least), self.n_docs - 1)
        while len(node):
            # of: each entry's range, ascending; every range has entries
            value = weights[term] * self.impact[node]
            starts = np.flatnonzero(np.diff(of, prepend=-1))
            bound = np.add.reduceat(value, starts)
            keep = bound >= least[items]
            base = lists[term] * (self.n_docs + 1)
            first = np.searchsorted(self.order, base + low[of])
            many = np.searchsorted(self.order, base + high[of], "right") - first
            small = keep & (np.add.reduceat(many, starts) <= leaf)
            chosen = small[of]
            leaves.append((bound[of[chosen]], items[of[chosen]], low[of[chosen]], weights[term[chosen]], first[chosen], many[chosen]))
            go = keep & ~small
            chosen = go[of]
            if not chosen.any():
                break
            term, node, value, of = term[chosen], node[chosen], value[chosen], (np.cumsum(go) - 1)[of[chosen]]
            items, low, high = items[go], low[go], high[go]
            starts = np.flatnonzero(np.diff(of, prepend=-1))
            largest = np.maximum.reduceat(value, starts)
            at = np.minimum.reduceat(np.where(value == largest[of], self.docs[node], self.n_docs), starts)
            left, own, right = self.split(node, at[of])
            seen(items, at, np.add.reduceat(weights[term] * self.impact[own], starts))
            left, right = self.within(left, low[of], at[of] - 1), self.within(right, at[of] + 1, high[of])
            term, node, of = np.concatenate([term, term]), np.concatenate([left, right]), np.concatenate([2 * of, 2 * of + 1])
            items, low, high = np.repeat(items, 2), np.stack([low, at + 1], 1).ravel(), np.stack([at - 1, high], 1).ravel()
            some = np.flatnonzero(node >= 0)
            some = some[np.argsort(of[some], kind="stable")]
            term, node, of = term[some], node[some], of[some]
            used, of = np.unique(of, return_inverse=True)
            items, low, high = items[used], low[used], high[used]
        bound, item, low, weight, first, many = (np.concatenate(x) for x in zip(*leaves, strict=True))
        order = np.lexsort([low, item, -bound])
        at = 0
        while at < len(order):
            to = at + LEAF_ENTRIES
            while to < len(order) and (low[order[to]], item[order[to]]) == (low[order[to - 1]], item[order[to - 1]]):
                to += 1  # a range's entries stay together
            part = order[at:to]
            at = to
            part = part[bound[part] >= least[item[part]]]
            n = many[part]
            x = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[part], n)
            where, at_doc = np.unique(np.repeat(item[part], n) * self.n_docs + self.docs[x], return_inverse=True)
            score = np.zeros(len(where), np.int64)
            np.add.at(score, at_doc, np.repeat(weight[part], n) * self.impact[x])
            seen(where // self.n_docs, where % self.n_docs, score)
        item, doc, score = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3
        good = score >= least[item]
        return item[good], doc[good], score[good]


class Items:
    """A block of query items: each item's terms by their numbers and how often it has them."""

    def __init__(self, given: list[tuple[int | None, bytes]]) -> None:
        self.number: dict[bytes, int] = {}
        self.ids, self.terms, self.times = [], [], []
        for item, text in given:
            found = terms(text)
            self.ids.append(item)
            self.terms.append(np.array([self.number.setdefault(w, len(self.number)) for w in found], np.int64))
            self.times.append(np.array(list(found.values()), np.int64))
        # items that are searched for together: so many that their terms are about TOGETHER
        ends, self.batches = np.cumsum([len(t) for t in self.terms]), []
        low = 0
        while low < len(self.ids):
            high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + TOGETHER, "right")))
            self.batches.append((low, high))
            low = high

    def flat(self, low: int, high: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(item, term, times) of the terms of the items from low to high."""
        sizes = [len(t) for t in self.terms[low:high]]
        return np.repeat(np.arange(low, high), sizes), np.concatenate(self.terms[low:high]), np.concatenate(self.times[low:high])


def _weights(df: dict[int, int], n: int, terms_: int) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * df.get(t, 0) + 1))) for t in range(terms_)], np.int64)


def _opened(row: dict, number: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """Of a segment's terms those of the items: their places in the segment, and their numbers."""
    found = [(i, number[w]) for i, w in enumerate(row["terms"].split(b" ")) if w in number]
    return np.array([i for i, _ in found], np.int64), np.array([t for _, t in found], np.int64)


def _frequencies(index: DataFrame, items: Items) -> dict[int, int]:
    """In how many documents each term of the items stands."""
    number = items.number
    schema = pa.schema([("term", pa.int64()), ("df", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(number), np.int64)
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                at, term = _opened(row, number)
                total[term] += np.frombuffer(row["counts"], "<i4")[at]
        yield emit({"term": np.flatnonzero(total), "df": total[total > 0]}, schema)

    found = index.select("terms", "counts").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))
    return {r.term: r.df for r in found.collect()}


def _candidates(index: DataFrame, items: Items, n: int, length: int, k: int) -> DataFrame:
    """(item, item_id, doc_id, score): the k best of each task for each item of the block."""
    number, weights = items.number, _weights(_frequencies(index, items), n, len(items.number))
    schema = pa.schema([("item", pa.int64()), ("item_id", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[tuple]] = [[] for _ in items.ids]
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                at, term = _opened(row, number)
                counts = np.frombuffer(row["counts"], "<i4").astype(np.int64)
                sizes, first = counts[at], (np.cumsum(counts) - counts)[at]
                x = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(first, sizes)
                docs, tf = np.frombuffer(row["docs"], "<i4")[x], np.frombuffer(row["tfs"], "<i4")[x].astype(np.int64)
                norm = np.array([75 + 25 * s * n // length for s in row["sizes"]], np.int64)
                treaps = Treaps(docs, 1_000_000_000 * tf // (1000 * tf + 12 * norm[docs]), sizes)
                place = np.full(len(number), -1)
                place[term] = np.arange(len(term))
                for low, high in items.batches:
                    asked, own, times = items.flat(low, high)
                    weight, lists = weights[own] * times, place[own]
                    use = (weight > 0) & (lists >= 0)
                    some, asked = np.unique(asked[use], return_inverse=True)
                    if not len(some):
                        continue
                    least = np.array([-best[item][-1][0] if len(best[item]) == k else 1 for item in some.tolist()], np.int64)
                    for item, doc, score in zip(*(x.tolist() for x in treaps.best(asked, lists[use], weight[use], k, least)), strict=True):
                        best[some[item]].append((-score, row["doc_ids"][doc] is None, row["doc_ids"][doc] or 0))
                    for item in some.tolist():
                        best[item].sort()
                        del best[item][k:]
        out = [(item, items.ids[item], None if null else doc, -score) for item, have in enumerate(best) for score, null, doc in have]
        yield emit({f.name: [r[i] for r in out] for i, f in enumerate(schema)}, schema)
        trim()

    return index.mapInArrow(run, "item long, item_id long, doc_id long, score long")


def _blocks(items: DataFrame) -> Iterator[list[tuple[int | None, bytes]]]:
    held, size = [], 0
    for r in items.toLocalIterator():
        if held and size + len(r.text) > BLOCK_BYTES:
            yield held
            held, size = [], 0
        held.append((r.id, bytes(r.text)))
        size += len(r.text)
    if held:
        yield held


def search(index: DataFrame, items: DataFrame, k: int = 20, text: str = "text", item_id: str = "item_id", doc_id: str = "doc_id") -> DataFrame:
    """Per item its k documents of the highest scores above 0: item_id, rank (from 1), doc_id, score; of equal scores the smaller id first."""
    check_columns(items, text, item_id)
    bounded_batches(index.sparkSession)
    n, length = index.agg(F.sum("n_docs"), F.sum("n_terms")).first()
    asked = items.select(F.col(item_id).cast("long").alias("id"), F.col(text).cast("binary").alias("text")).filter("text IS NOT NULL").distinct()
    found = []
    for block in _blocks(asked) if n else ():
        order = W.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        ranked = _candidates(index, Items(block), n, length, k).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        found.append(staged(ranked.select("item_id", "rank", "doc_id", "score"), "ranked"))
    if not found:
        return index.sparkSession.createDataFrame([], f"`{item_id}` long, rank int, `{doc_id}` long, score long")
    out = reduce(DataFrame.unionByName, found)
    return out.select(F.col("item_id").alias(item_id), "rank", F.col("doc_id").alias(doc_id), "score")


def rank_documents(docs: DataFrame, items: DataFrame, k: int = 20, text: str = "text", doc_id: str = "doc_id", item_text: str = "text", item_id: str = "item_id") -> DataFrame:
    """Index docs and search them for items."""
    return search(staged(build(docs, text, doc_id), "lists"), items, k, item_text, item_id, doc_id)
