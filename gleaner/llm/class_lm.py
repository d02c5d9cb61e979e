"""Language-model scores by a Brown class-based bigram model over the whole vocabulary.

1. *Chunks.* Documents are tokenised once, into chunks: a chunk lists its distinct words, sorted by the bucket that a hash deals
   them to, and holds its tokens as numbers of that list.
2. *Counts.* Buckets add up the words' counts in training documents; totals and the ``core`` most frequent words come from there.
3. *Core classes.* Pairs of neighbouring core words, counted over the whole corpus, are clustered by exchange: each word in turn
   goes to the class that raises the likelihood of the pairs most.
4. *All other words.* In ``rounds`` distributed rounds of exchange each chunk sends its words to their buckets, with the
   classes found before and after them; the bucket adds a word's neighbours up over all chunks, takes the word out of its class, and
   puts it where the likelihood of the pairs gains most against the class pairs of the round before. Every training word
   gets a class, words seen once included; a word all of whose neighbours lack a class in every round ties between all classes and goes
   to the first.
5. *Scores.* Chunks get their words' counts and classes back, class pairs are counted once more, and a token's probability
   is P(class | class before) * P(token | class). A class reserves the share of its words seen once for unknown words (Good and
   Turing); an unknown word may come from any class, and tells nothing of the next. All this sums to one over the known tokens and one unknown.

Nothing that grows with the vocabulary reaches the driver or all tasks: only the core words (a documented bound; their pair
counts are at most core squared) and tables of classes by classes.

Defined cases: a null or empty text is the end token alone; repeated rows count and are scored each; rows without an id are in training;
equal counts at the edge of the core are told apart by the words' bytes, and equal gains go to the lower class; long texts are
tokenised in parts; extra columns are ignored, whatever their names; an empty table gives no rows; without any training document N and V are zero
and all tokens are unknown.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import bounded_batches, check_columns, emit, release, rows, scratch, staged, trim

#: The end token; no word holds a blank.
END = b" "
#: Tokens in a chunk (a longer document has one of its own), bytes of text that one bucket of words stands for, bytes tokenised at once.
CHUNK_TOKENS, BUCKET_BYTES, PIECE = 1_000_000, 8_000_000, 1 << 20
_GAP = re.compile(rb"[\x20\x09-\x0D]")


def pieces(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, a part at a time."""
    at = 0
    while at < len(text):
        gap = _GAP.search(text, at + PIECE)
        end = gap.start() if gap else len(text)
        yield text[at:end].lower().split()
        at = end


def tokens(text: bytes | None) -> list[bytes]:
    return [w for part in pieces(text or b"") for w in part] + [END]


# chunks -----------------------------------------------------------------------------------------------------------------

_CHUNK = "chunk long, ids array<long>, held array<boolean>, sizes array<long>, buckets array<long>, ends array<long>, words binary, body binary"
_CHUNK_ARROW = pa.schema(
    [("chunk", pa.int64()), ("ids", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_())), ("sizes", pa.list_(pa.int64())), ("buckets", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64())), ("words", pa.binary()), ("body", pa.binary())]
)


def _zip(data: bytes) -> bytes:
    return len(data).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True)


def _unzip(data: bytes) -> bytes:
    return pa.decompress(data[8:], int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)


def packed(numbers: np.ndarray) -> bytes:
    """Integers as planes of bytes, compressed: planes of zeros take next to nothing."""
    return _zip(np.ascontiguousarray(numbers.astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes())


def unpacked(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(_unzip(data), np.uint8).reshape(8, -1).T).view("<i8").ravel()


def chunks(docs: DataFrame, held_out: Column, buckets: int, text: str, doc_id: str) -> DataFrame:
    """The documents' tokens in chunks; words of a chunk are sorted by bucket and by themselves, and joined by line ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = TaskContext.get().partitionId() << 32
        number: defaultdict[bytes, int] = defaultdict()
        number.default_factory = number.__len__
        ids, held, sizes, parts, n = [], [], [], [], 0

        def chunk() -> pa.RecordBatch:
            words = sorted(number)
            bucket = np.array([crc32(w) for w in words], np.int64) % buckets
            order = np.argsort(bucket, kind="stable")
            words = [words[k] for k in order.tolist()]
            rank = np.empty(len(words), np.int64)
            rank[np.array([number[w] for w in words])] = np.arange(len(words))
            bucket = bucket[order]
            last = np.flatnonzero(np.append(bucket[1:] != bucket[:-1], True))
            return emit({"chunk": [turn], "ids": [ids], "held": [held], "sizes": [sizes], "buckets": [bucket[last].tolist()], "ends": [(last + 1).tolist()], "words": [_zip(b"\n".join(words))], "body": [packed(rank[np.concatenate(parts)])]}, _CHUNK_ARROW)

        for i, h, t in rows(batches, "__id", "__held", "__text"):
            before = n
            for ws in (*pieces(t or b""), [END]):
                parts.append(np.fromiter(map(number.__getitem__, ws), np.int32, len(ws)))
                n += len(ws)
            ids.append(i)
            held.append(h)
            sizes.append(n - before)
            if n >= CHUNK_TOKENS:
                yield chunk()
                number.clear()
                ids, held, sizes, parts, n, turn = [], [], [], [], 0, turn + 1
                trim()
        if ids:
            yield chunk()

    given = docs.select(F.col(doc_id).cast("long").alias("__id"), held_out.alias("__held"), F.col(text).cast("binary").alias("__text"))
    return given.mapInArrow(run, _CHUNK)


class _Chunk:
    def __init__(self, row: dict) -> None:
        self.number, self.ids, self.held = row["chunk"], row["ids"], row["held"]
        self.sizes = np.array(row["sizes"], np.int64)
        self.ends = np.cumsum(self.sizes)
        self.x = unpacked(row["body"])
        self.words = _unzip(row["words"]).split(b"\n") if "words" in row else []
        self.train = np.repeat(~np.array(self.held, bool), self.sizes)
        self.end = int(self.x[-1])
        self.before = np.append(self.end, self.x[:-1])  # each document ends with the end token, which the next one follows
        lows = [0, *row["ends"][:-1]]
        self.slices = list(zip(row["buckets"], lows, row["ends"], strict=True))

    def counts(self) -> np.ndarray:
        return np.bincount(self.x[self.train], minlength=self.slices[-1][2])


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[_Chunk, dict]]:
    for batch in batches:
        for at in range(batch.num_rows):
            row = batch.slice(at, 1).to_pylist()[0]
            yield _Chunk(row), row
        trim()


# counts and the core --------------------------------------------------------------------------------------------------------

_COUNTED = "total long, different long, words array<binary>, n array<long>"


def count_words(held: DataFrame, core: int) -> DataFrame:
    """Per bucket: training tokens, distinct ones, and the bucket's most frequent words but the end, core of them at most."""
    schema = pa.schema([("bucket", pa.int64()), ("words", pa.binary()), ("n", pa.binary())])
    result = pa.schema([("total", pa.int64()), ("different", pa.int64()), ("words", pa.list_(pa.binary())), ("n", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, _ in _opened(batches):
            n = chunk.counts()
            out: dict[str, list] = {k: [] for k in schema.names}
            for bucket, a, b in chunk.slices:
                some = np.flatnonzero(n[a:b]) + a
                if len(some):
                    out["bucket"].append(bucket)
                    out["words"].append(_zip(b"\n".join([chunk.words[k] for k in some.tolist()])))
                    out["n"].append(packed(n[some]))
            yield emit(out, schema)

    def add(table: pa.Table) -> pa.Table:
        words, code = _encoded(table["words"])
        n = np.bincount(code, np.concatenate([unpacked(x) for x in table["n"].to_pylist()]), len(words)).astype(np.int64)
        most = sorted((k for k in range(len(words)) if words[k] != END), key=lambda k: (-n[k], words[k]))[:core]
        return pa.table([pa.array([int(n.sum())]), pa.array([len(words)]), pa.array([[words[k] for k in most]], pa.list_(pa.binary())), pa.array([[int(n[k]) for k in most]], pa.list_(pa.int64()))], schema=result)

    return held.mapInArrow(run, "bucket long, words binary, n binary").groupBy("bucket").applyInArrow(add, _COUNTED)


def _encoded(column: pa.ChunkedArray) -> tuple[list[bytes], np.ndarray]:
    """The distinct words of joined lists, and each listed word's number among them."""
    number: defaultdict[bytes, int] = defaultdict()
    number.default_factory = number.__len__
    parts = (_unzip(x).split(b"\n") for x in column.to_pylist())
    code = [np.fromiter(map(number.__getitem__, p), np.int64, len(p)) for p in parts]
    return list(number), np.concatenate(code)


def core_pairs(held: DataFrame, core: dict[bytes, int]) -> np.ndarray:
    """size * size sums of neighbouring core tokens (the end among them) over all training documents."""
    size = len(core)
    sent = held.sparkSession.sparkContext.broadcast(core)
    schema = pa.schema([("pair", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size * size, np.int64)
        for chunk, _ in _opened(batches):
            number = np.array([sent.value.get(w, -1) for w in chunk.words], np.int64)
            a, b = number[chunk.before], number[chunk.x]
            ok = (a >= 0) & (b >= 0) & chunk.train
            total += np.bincount(a[ok] * size + b[ok], minlength=size * size)
        some = np.flatnonzero(total)
        yield emit({"pair": some, "n": total[some]}, schema)

    found = held.mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(size * size)
    out[found["pair"].to_numpy(np.int64)] = found["n"].to_numpy(np.int64)
    return out.reshape(size, size)


def _info(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def exchange(counts: np.ndarray, classes: int, rounds: int = 4) -> np.ndarray:
    """Assign words 0..W-1 (most frequent first) to classes by exchange: each word in turn goes where the pairs' likelihood gains most.

    counts[i, j]: how often word j follows word i. Ends after rounds, or when no word moves.
    """
    n = len(counts)
    classes = max(1, min(classes, n))
    of = np.arange(n) % classes
    one = np.zeros((n, classes))
    one[np.arange(n), of] = 1
    right, left = counts @ one, counts.T @ one  # by word: pairs with a class after it, before it
    grid = one.T @ right
    before, after = grid.sum(1), grid.sum(0)
    for _ in range(rounds):
        moves = 0
        for w in range(n):
            c, own = of[w], counts[w, w]
            r, le = right[w].copy(), left[w].copy()
            rs, ls = r.sum(), le.sum()
            r[c] -= own
            le[c] -= own
            # take the word out of its class
            grid[c] -= r
            grid[:, c] -= le
            grid[c, c] -= own
            before[c] -= rs
            after[c] -= ls
            gain = (_info(grid + r) - _info(grid)).sum(1) + (_info(grid + le[:, None]) - _info(grid)).sum(0)
            diag = np.diag(grid)
            gain += _info(diag + r + le + own) - _info(diag + r) - _info(diag + le) + _info(diag)
            gain -= _info(before + rs) - _info(before) + _info(after + ls) - _info(after)
            to = int(gain.argmax())
            if gain[to] <= gain[c] + 1e-9:
                to = c
            grid[to] += r
            grid[:, to] += le
            grid[to, to] += own
            before[to] += rs
            after[to] += ls
            if to != c:
                moves += 1
                of[w] = to
                col = counts[:, w]
                right[:, c] -= col
                right[:, to] += col
                row = counts[w]
                left[:, c] -= row
                left[:, to] += row
        if not moves:
            break
    return of


# the distributed rounds -----------------------------------------------------------------------------------------------------------


def assign(size: int, word: np.ndarray, near: np.ndarray, n: np.ndarray, grid: np.ndarray, own: np.ndarray) -> np.ndarray:
    """The class of each of size words by the exchange criterion against fixed class pairs; -1 for words without neighbours.

    Entries, sorted by word: near is a class before the word, or, raised by the number of classes, one after it; n how often.
    own: the word's class so far (-1: none), out of which it is taken first. The last class is the end's and takes no words.
    """
    g = len(grid)
    out = np.full(size, -1, np.int64)
    table = np.concatenate([grid, grid.T])  # by near: pairs with each class of the word
    sums = np.stack([grid.sum(0), grid.sum(1)])  # of classes as the second of a pair (words before them), as the first
    few = [_info(table + k) - _info(table) for k in range(1, 9)]
    first = np.flatnonzero(np.append(True, word[1:] != word[:-1])) if len(word) else np.zeros(0, np.int64)
    bounds = np.append(first, len(word))
    at = 0
    while at < len(first):
        # as many words as have 50,000 entries, one at least
        to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + 50_000, "right")) - 1)
        a, b = bounds[at], bounds[to]
        k, d, x = word[first[at:to]], near[a:b], n[a:b].astype(float)
        gains = np.empty((b - a, g))
        small = x <= len(few)
        for c, steps in enumerate(few, 1):
            here = x == c
            gains[here] = steps[d[here]]
        large = np.flatnonzero(~small)
        gains[large] = _info(table[d[large]] + x[large, None]) - _info(table[d[large]])
        mine = own[word[a:b]]
        had = np.flatnonzero(mine >= 0)
        cell = table[d[had], mine[had]]
        gains[had, mine[had]] = _info(cell) - _info(np.maximum(cell - x[had], 0))
        starts = first[at:to] - a
        gain = np.add.reduceat(gains, starts, axis=0)
        for side in (0, 1):
            s = np.add.reduceat(np.where((d >= g) == bool(side), x, 0.0), starts)
            cost = _info(sums[side] + s[:, None]) - _info(sums[side])
            held = np.flatnonzero(own[k] >= 0)
            whole = sums[side][own[k[held]]]
            cost[held, own[k[held]]] = _info(whole) - _info(np.maximum(whole - s[held], 0))
            gain -= cost
        gain[:, g - 1] = -np.inf
        out[k] = gain.argmax(1)
        at = to
    return out


_STATE = "chunk long, bucket long, n binary, class binary, pairs array<long>, mass array<long>, once array<long>"
_STATE_ARROW = pa.schema(
    [("chunk", pa.int64()), ("bucket", pa.int64()), ("n", pa.binary()), ("class", pa.binary())] + [(x, pa.list_(pa.int64())) for x in ("pairs", "mass", "once")]
)


def _joined(held: DataFrame, state: DataFrame) -> DataFrame:
    own = state.filter("chunk >= 0").groupBy("chunk").agg(F.collect_list(F.struct("bucket", "n", "class")).alias("state"))
    return held.join(own, "chunk")


def _known(row: dict) -> tuple[np.ndarray, np.ndarray]:
    """A chunk's words' counts and classes, in their order."""
    parts = sorted(row["state"], key=lambda s: s["bucket"])
    return np.concatenate([unpacked(s["n"]) for s in parts]), np.concatenate([unpacked(s["class"]) for s in parts])


def exchange_round(held: DataFrame, classes: dict[bytes, int], grid: np.ndarray, last: bool) -> DataFrame:
    """One round: each chunk's words' counts and classes by bucket, and, with chunk -1, each bucket's class pairs, counts and words seen once by class.

    classes: those of the core, which stay; held: chunks, with the state of the round before unless this is the first.
    """
    g, first = len(grid), "state" not in held.columns
    sent = held.sparkSession.sparkContext.broadcast((classes, grid))
    names = ("bucket", "chunk", "words", "n", "own", "many", "near", "times")
    schema = pa.schema([("bucket", pa.int64()), ("chunk", pa.int64()), *[(x, pa.binary()) for x in names[2:]]])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        core, _ = sent.value
        for chunk, row in _opened(batches):
            own = np.array([core.get(w, -1) for w in chunk.words], np.int64) if first else _known(row)[1]
            fixed = np.array([w in core for w in chunk.words], bool)
            moving = chunk.train & ~fixed[chunk.x]
            at = np.flatnonzero(moving)  # never the last token, which is an end
            before, after = own[chunk.before[at]], own[chunk.x[np.minimum(at + 1, len(chunk.x) - 1)]]
            w = chunk.x[at].astype(np.int64) * (2 * g)
            code = np.concatenate([(w + before)[before >= 0], (w + g + after)[after >= 0]])
            code, times = np.unique(code, return_counts=True)
            word, near, n = code // (2 * g), code % (2 * g), chunk.counts()
            cuts = np.searchsorted(word, [a for _, a, _ in chunk.slices] + [len(chunk.words)])
            out: dict[str, list] = {x: [] for x in names}
            for (bucket, a, b), low, high in zip(chunk.slices, cuts, cuts[1:], strict=False):
                many = np.bincount(word[low:high] - a, minlength=b - a)
                values = (bucket, chunk.number, _zip(b"\n".join(chunk.words[a:b])), *map(packed, (n[a:b], own[a:b], many, near[low:high], times[low:high])))
                for x, v in zip(names, values, strict=True):
                    out[x].append(v)
            yield emit(out, schema)

    def settle(table: pa.Table) -> pa.Table:
        core, fixed_grid = sent.value
        words, code = _encoded(table["words"])
        counts, own_, many, near, times = ([unpacked(x) for x in table[c].to_pylist()] for c in ("n", "own", "many", "near", "times"))
        sizes = [len(x) for x in counts]
        n = np.bincount(code, np.concatenate(counts), len(words)).astype(np.int64)
        own = np.full(len(words), -1, np.int64)
        own[code] = np.concatenate(own_)
        starts = np.cumsum([0, *sizes[:-1]])
        word, near, times = np.repeat(code, np.concatenate(many)), np.concatenate(near), np.concatenate(times)
        both, back = np.unique(word * (2 * g) + near, return_inverse=True)
        times = np.bincount(back, times, len(both)).astype(np.int64)
        word, near = both // (2 * g), both % (2 * g)
        found = assign(len(words), word, near, times, fixed_grid, own)
        for k, w in enumerate(words):
            if w in core:
                found[k] = core[w]
        if last:
            found[(found < 0) & (n > 0)] = 0
        of = found[word]
        left, right = (of >= 0) & (near < g), (of >= 0) & (near >= g)
        pairs = np.bincount(near[left] * g + of[left], times[left], g * g) + np.bincount(of[right] * g + near[right] - g, times[right], g * g)
        seen = (n > 0) & (found >= 0)
        out = {"chunk": table["chunk"].to_pylist(), "bucket": table["bucket"].to_pylist(), "n": [], "class": [], "pairs": [None] * len(sizes), "mass": [None] * len(sizes), "once": [None] * len(sizes)}
        for s, size in zip(starts.tolist(), sizes, strict=True):
            out["n"].append(packed(n[code[s : s + size]]))
            out["class"].append(packed(found[code[s : s + size]]))
        totals = (-1, out["bucket"][0], None, None, pairs.astype(np.int64).tolist(), np.bincount(found[seen], n[seen], g).astype(np.int64).tolist(), np.bincount(found[seen & (n == 1)], minlength=g).tolist())
        for x, v in zip(_STATE_ARROW.names, totals, strict=True):
            out[x].append(v)
        del words, code, word, near, both, back
        trim()
        return pa.table([pa.array(out[f.name], f.type) for f in _STATE_ARROW], schema=_STATE_ARROW)

    return held.mapInArrow(send, "bucket long, chunk long, words binary, n binary, own binary, many binary, near binary, times binary").groupBy("bucket").applyInArrow(settle, _STATE)


def summed(df: DataFrame, column: str, size: int) -> np.ndarray:
    """The rows' arrays added up place by place; only size numbers reach the driver."""
    found = df.filter(F.col(column).isNotNull()).select(F.posexplode(column).alias("at", "x")).filter("x != 0").groupBy("at").agg(F.sum("x").alias("x")).collect()
    out = np.zeros(size)
    for row in found:
        out[row["at"]] = row["x"]
    return out


# the model and scores ---------------------------------------------------------------------------------------------------------------


@dataclass
class Model:
    """What scoring needs besides the words' own counts and classes: log10 of P(class before -> class) over the class's mass, and totals.

    step[p, c] + log10(count) is the log10 probability of a known word of class c after class p; the last row stands for an unknown
    word before, the last column for an unknown word.
    """

    step: np.ndarray
    total: int
    different: int


def model_of(pairs: np.ndarray, mass: np.ndarray, once: np.ndarray, total: int, different: int, prior: float = 20.0) -> Model:
    """From class pairs, the classes' counts and their words seen once. Transitions are smoothed towards the classes' shares."""
    g = len(mass)
    arrivals = pairs.sum(0)
    shares = (arrivals + 0.5) / (arrivals.sum() + 0.5 * g)
    rows_ = np.concatenate([pairs, np.zeros((1, g))])
    transition = (rows_ + prior * shares) / (rows_.sum(1, keepdims=True) + prior)
    unseen = once + 1.0
    whole = mass + unseen
    step = np.concatenate([np.log10(transition / whole), np.log10((transition * (unseen / whole)).sum(1, keepdims=True))], 1)
    return Model(step, total, different)


_READY = "ids array<long>, held array<boolean>, sizes array<long>, known array<long>, base array<double>, plain array<double>, body binary, pairs array<long>"


def resolve(held: DataFrame, g: int) -> DataFrame:
    """Chunks as sequences of classes (g: unknown), with each document's known tokens and sums of logs, and the chunk's training class pairs."""
    schema = pa.schema([(x, pa.list_(t)) for x, t in (("ids", pa.int64()), ("held", pa.bool_()), ("sizes", pa.int64()), ("known", pa.int64()), ("base", pa.float64()), ("plain", pa.float64()))] + [("body", pa.binary()), ("pairs", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, row in _opened(batches):
            n, cls = _known(row)
            cls = np.where((n > 0) & (cls >= 0), cls, g)
            seq = cls[chunk.x]
            before = np.append(cls[chunk.end], seq[:-1])
            ok = chunk.train & (before < g) & (seq < g)
            starts = chunk.ends - chunk.sizes
            logs, plain = np.log10(n + 1)[chunk.x], np.log10(np.maximum(n, 1))[chunk.x]
            out = {
                "ids": [chunk.ids], "held": [chunk.held], "sizes": [chunk.sizes.tolist()], "known": [np.add.reduceat((n > 0)[chunk.x].astype(np.int64), starts).tolist()], "base": [np.add.reduceat(logs, starts).tolist()],
                "plain": [np.add.reduceat(plain, starts).tolist()], "body": [pa.compress(seq.astype(np.uint8).tobytes(), codec="zstd", asbytes=True)], "pairs": [np.bincount(before[ok] * g + seq[ok], minlength=g * g).tolist()],
            }
            yield emit(out, schema)

    return held.mapInArrow(run, _READY)


_SCORED = "__id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def scored(ready: DataFrame, model: Model) -> DataFrame:
    sent = ready.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([("__id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        g = len(m.step) - 1
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                sizes = np.array(row["sizes"], np.int64)
                seq = np.frombuffer(pa.decompress(row["body"], int(sizes.sum()), codec="zstd", asbytes=True), np.uint8).astype(np.int64)
                # the end's class is the last one known; without training documents the end is unknown as well
                start = g - 1 if m.total else g
                steps = m.step[np.append(start, seq[:-1]), seq]
                score = np.add.reduceat(steps, np.cumsum(sizes) - sizes) + np.array(row["plain"])
                base = np.array(row["base"]) - sizes * math.log10(m.total + m.different + 1)
                yield emit({"__id": row["ids"], "held_out": row["held"], "n_tokens": sizes, "n_known": row["known"], "base_score": base, "score": score}, schema)

    return ready.select("ids", "held", "sizes", "known", "base", "plain", "body").mapInArrow(run, _SCORED)


@dataclass
class Fitted:
    """chunks: the tokens; state: counts and classes of all words, by chunk and bucket; ready: chunks as classes."""

    chunks: DataFrame
    state: DataFrame
    ready: DataFrame
    model: Model


def fit(docs: DataFrame, held_out: Column, text: str = "text", doc_id: str = "doc_id", core: int = 1000, classes: int = 48, rounds: int = 2, prior: float = 20.0) -> Fitted:
    """Learn from the rows of docs for which held_out is false; the tables kept cover all rows."""
    if not 1 <= classes <= 100 or rounds < 1:
        raise ValueError("classes must be from 1 to 100, rounds at least 1")
    check_columns(docs, text, doc_id)
    bounded_batches(docs.sparkSession)
    size = docs.agg(F.coalesce(F.sum(F.octet_length(F.col(text))), F.lit(0))).first()[0]
    held = staged(chunks(docs, held_out, max(32, -(-int(size) // BUCKET_BYTES)), text, doc_id), "chunks")
    counted = staged(count_words(held, core), "counts")
    total, different = counted.agg(F.coalesce(F.sum("total"), F.lit(0)), F.coalesce(F.sum("different"), F.lit(0))).first()
    top = counted.select(F.explode(F.arrays_zip("words", "n")).alias("x")).select("x.words", "x.n").orderBy(F.desc("n"), "words").limit(core).collect()
    number = {bytes(r["words"]): k for k, r in enumerate(top)} | {END: len(top)}
    seen = core_pairs(held, number)
    of = exchange(seen[:-1, :-1], classes) if top else np.zeros(0, np.int64)
    # classes that no word is in go; the end has the last one for itself
    used, of = np.unique(of, return_inverse=True)
    of = np.append(of, len(used))
    g = len(used) + 1
    one = np.zeros((len(of), g))
    one[np.arange(len(of)), of] = 1
    among = one.T @ seen @ one
    fixed = {w: int(of[k]) for w, k in number.items()}
    grid, state = among, None
    for turn in range(rounds):
        given = held if state is None else _joined(held, state)
        before = scratch()[-1:] if turn else []
        state = staged(exchange_round(given, fixed, grid, turn == rounds - 1), "classes")
        release(before)
        grid = among + summed(state, "pairs", g * g).reshape(g, g)
    ready = staged(resolve(_joined(held.drop("words"), state), g), "ready")
    pairs = summed(ready, "pairs", g * g).reshape(g, g)
    return Fitted(held, state, ready, model_of(pairs, summed(state, "mass", g), summed(state, "once", g), int(total), int(different), prior))


def word_classes(fitted: Fitted) -> DataFrame:
    """(word binary, n, class) of all training words."""
    schema = pa.schema([("word", pa.binary()), ("n", pa.int64()), ("class", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, row in _opened(batches):
            n, cls = _known(row)
            some = np.flatnonzero(n)
            yield emit({"word": [chunk.words[k] for k in some.tolist()], "n": n[some], "class": cls[some]}, schema)

    return _joined(fitted.chunks, fitted.state).mapInArrow(run, "word binary, n long, class int").distinct()


def train_and_score(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", folds: int = 7, held: int = 2, **how) -> DataFrame:
    """Per row: doc_id, n_tokens, n_known, train_tokens, base_score, score, held_out, perplexity.

    Rows whose crc32(doc_id as text) mod folds is held are scored only, all others are learnt from.
    """
    held_out = F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(folds)) == held, F.lit(False))
    fitted = fit(docs, held_out, text, doc_id, **how)
    return scored(fitted.ready, fitted.model).select(
        F.col("__id").alias(doc_id), "n_tokens", "n_known", F.lit(fitted.model.total).cast("long").alias("train_tokens"), "base_score", "score", "held_out",
        F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"),
    )
