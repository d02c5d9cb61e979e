"""Toxicity: a convolutional text classifier in numpy.

A word is the sum of two hashed embeddings, its own and its first letters'. Filters of several widths run over the whole
text, the largest response of each is kept, and a linear layer gives the logit; all are trained together by Adam on
mini-batches, the gradient of a maximum going to the words it came from. Hash buckets that few training texts share
stay zero, so that rare words tell nothing.

Thresholds are calibrated by language, which is guessed from the text's own function words: for each language, on rows
kept out of the fit, the logit is found that separates the classes best, and scores are shifted so that it falls on the
given threshold.

Bound: at most ``most_rows`` labelled rows of each class, those with the smallest hash of their id.

Defined cases: null and empty texts have the score of no response at all; words are runs of letters, others count as
gaps; long texts are taken in overlapping parts, none left out; with no labels or one class scores are constant (0 without ones,
0.5 without labels); repeated rows are each scored, and each learnt from; rows to learn from are
taken in an order of their own (hash, label, content), so ties don't depend on where rows come from; ids are integers; extra columns
are ignored, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import math
import os
from collections.abc import Iterator
from dataclasses import dataclass, field
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import bounded_batches, check_columns, emit, rows
from gleaner.llm.nbsvm import fold, sample

BUCKETS, SIZE, WIDTHS, FILTERS = 1 << 16, 12, (1, 2, 3), 12
#: Words of a text that are convolved at once; parts overlap by the widest filter.
PART = 8192
#: Frequent function words by which a language is told.
FUNCTION_WORDS = {
    "en": "the of and to in is that for it with was on be by are this from at or an",
    "fr": "le la les de des et en un une est que qui dans pour pas sur au du il ne",
    "de": "der die das und in zu den von ist mit sich des auf für nicht ein eine dem im als",
    "es": "el la los las de que y en un una por con del se no es para al lo su",
}
_TELL = {lang: frozenset(words.encode().split()) for lang, words in FUNCTION_WORDS.items()}
_APART = bytes(b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").lower().translate(_APART).split()


def language(words: list[bytes]) -> str:
    """The language with the most function words in the text; und for none or a tie."""
    kinds = {lang: sum(map(tell.__contains__, words)) for lang, tell in _TELL.items()}
    (best, n), (_, second) = sorted(kinds.items(), key=lambda x: -x[1])[:2]
    return best if n > second else "und"


def hashed(words: list[bytes]) -> np.ndarray:
    """Two buckets a word, shape (n, 2); bucket 0 is kept for padding."""
    out = np.empty((len(words), 2), np.int64)
    out[:, 0] = [crc32(w) for w in words]
    out[:, 1] = [crc32(w[:4], 99) for w in words]
    return out % (BUCKETS - 1) + 1


@dataclass
class Net:
    table: np.ndarray  # BUCKETS, SIZE
    filters: list[np.ndarray]  # per width: width * SIZE, FILTERS
    filter_bias: list[np.ndarray]
    out: np.ndarray
    out_bias: np.ndarray
    shifts: dict[str, float] = field(default_factory=dict)
    scale: float = 1.0
    constant: float | None = None
    threshold: float = 0.7

    @staticmethod
    def fresh(seed: int = 3) -> Net:
        rng = np.random.default_rng(seed)
        f32 = np.float32
        table = rng.normal(0, 0.1, (BUCKETS, SIZE)).astype(f32)
        filters = [rng.normal(0, 1 / math.sqrt(w * SIZE), (w * SIZE, FILTERS)).astype(f32) for w in WIDTHS]
        return Net(table, filters, [np.zeros(FILTERS, f32) for _ in WIDTHS], rng.normal(0, 0.2, len(WIDTHS) * FILTERS).astype(f32), np.zeros(1, f32))

    def pooled(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The largest response of each filter (at least 0) and the place it came from (-1: none)."""
        most, place = np.zeros(len(WIDTHS) * FILTERS, np.float32), np.full(len(WIDTHS) * FILTERS, -1)
        for at in range(0, len(ids), PART):
            e = self.table[ids[at : at + PART + max(WIDTHS) - 1]].sum(1)
            for k, w in enumerate(WIDTHS):
                n = len(e) - w + 1
                if n <= 0:
                    continue
                f = self.filters[k]
                r = e[:n] @ f[:SIZE]
                for j in range(1, w):
                    r += e[j : n + j] @ f[j * SIZE : (j + 1) * SIZE]
                top = r.argmax(0)
                value, s = r[top, np.arange(FILTERS)] + self.filter_bias[k], slice(k * FILTERS, (k + 1) * FILTERS)
                better = value > most[s]
                most[s] = np.where(better, value, most[s])
                place[s] = np.where(better, top + at, place[s])
        return most, place

    def logit(self, ids: np.ndarray) -> float:
        return float(self.pooled(ids)[0] @ self.out + self.out_bias[0])

    def score(self, logit: float, lang: str) -> float:
        if self.constant is not None:
            return self.constant
        shift = self.shifts.get(lang, self.shifts.get("und", 0.0))
        x = self.scale * (logit - shift) + math.log(self.threshold / (1 - self.threshold))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, x))))


def _adam(state: dict, name: str, value: np.ndarray, grad: np.ndarray, rate: float, rows_: np.ndarray | None = None) -> None:
    m, v, t = state.setdefault(name, [np.zeros_like(value), np.zeros_like(value), 0])
    state[name][2] = t = t + 1
    at = slice(None) if rows_ is None else rows_
    m[at] = 0.9 * m[at] + 0.1 * grad
    v[at] = 0.999 * v[at] + 0.001 * grad * grad
    value[at] -= rate * (m[at] / (1 - 0.9**t)) / (np.sqrt(v[at] / (1 - 0.999**t)) + 1e-6)


def learn(texts: list[np.ndarray], y: np.ndarray, rounds: int = 8, batch: int = 32, rate: float = 0.01, seed: int = 3, least_texts: int = 3) -> Net:
    """Train on texts' buckets and labels; classes weigh alike."""
    net, rng, state = Net.fresh(seed), np.random.default_rng(seed), {}
    seen = np.bincount(np.concatenate([np.unique(t) for t in texts if len(t)] or [np.zeros(0, np.int64)]), minlength=BUCKETS)
    live = (seen >= least_texts)[:, None].astype(np.float32)
    net.table *= live
    weight = np.where(y == 1, 0.5 / max(y.mean(), 1e-6), 0.5 / max(1 - y.mean(), 1e-6))
    for _ in range(rounds):
        for part in np.array_split(rng.permutation(len(texts)), max(1, len(texts) // batch)):
            g_out, g_bias = np.zeros_like(net.out), 0.0
            g_f, g_fb = [np.zeros_like(f) for f in net.filters], [np.zeros_like(b) for b in net.filter_bias]
            touched, grads = [], []
            for i in part:
                most, place = net.pooled(texts[i])
                p = 1 / (1 + math.exp(-max(-30.0, min(30.0, float(most @ net.out + net.out_bias[0])))))
                g = (p - y[i]) * weight[i] / len(part)
                g_out += g * most
                g_bias += g
                for k, w in enumerate(WIDTHS):
                    s = slice(k * FILTERS, (k + 1) * FILTERS)
                    for f in np.flatnonzero(place[s] >= 0).tolist():
                        gr = np.float32(g * net.out[s][f])
                        ids = texts[i][place[s][f] : place[s][f] + w]
                        g_f[k][:, f] += gr * net.table[ids].sum(1).ravel()
                        g_fb[k][f] += gr
                        back = gr * net.filters[k][:, f].reshape(w, SIZE)
                        for c in range(2):
                            touched.append(ids[:, c])
                            grads.append(back)
            _adam(state, "out", net.out, g_out + 1e-4 * net.out, rate)
            _adam(state, "out_bias", net.out_bias, np.array([g_bias], np.float32), rate)
            for k in range(len(WIDTHS)):
                _adam(state, f"f{k}", net.filters[k], g_f[k] + 1e-4 * net.filters[k], rate)
                _adam(state, f"b{k}", net.filter_bias[k], g_fb[k], rate)
            if touched:
                some, at = np.unique(np.concatenate(touched), return_inverse=True)
                total = np.zeros((len(some), SIZE), np.float32)
                np.add.at(total, at, np.concatenate(grads))
                _adam(state, "table", net.table, total, rate, some)
                net.table[some] *= live[some]
    return net


def best_threshold(logits: np.ndarray, y: np.ndarray) -> float:
    """The middle of the widest gap among the cuts with the best F1 for label 1."""
    order = np.argsort(logits)
    x, t = logits[order], y[order]
    ones = t.sum()
    tp = ones - np.concatenate([[0], np.cumsum(t)])
    called = len(t) - np.arange(len(t) + 1)
    f1 = 2 * tp / np.maximum(called + ones, 1)
    low, high = np.concatenate([[x[0] - 4], x]), np.concatenate([x, [x[-1] + 4]])
    best = np.flatnonzero(f1 >= f1.max() - 1e-12)
    cut = best[np.argmax((high - low)[best])]
    return float((low[cut] + high[cut]) / 2)


def fit(texts: list[np.ndarray], langs: list[str], y: np.ndarray, fresh: np.ndarray, threshold: float, **how) -> Net:
    """Train on the rows that aren't fresh, calibrate on those that are (on all where they lack a class)."""
    if not len(y) or y.min() == y.max():
        net = Net.fresh()
        net.constant = float(y.mean()) if len(y) else 0.5
        return net
    if any(not (~fresh & (y == c)).any() for c in (0, 1)):
        fresh = np.zeros(len(y), bool)
    used = np.flatnonzero(~fresh)
    net = learn([texts[i] for i in used], y[used], **how)
    net.threshold = threshold
    logits = np.array([net.logit(t) for t in texts])
    by = np.array(langs)

    def judged(of: np.ndarray) -> np.ndarray:
        kept = of & fresh
        return kept if min((kept & (y == 0)).sum(), (kept & (y == 1)).sum()) >= 5 else of

    whole = judged(np.ones(len(y), bool))
    net.shifts = {"und": best_threshold(logits[whole], y[whole])}
    for lang in _TELL:
        of = judged(by == lang)
        if min((of & (y == 0)).sum(), (of & (y == 1)).sum()) >= 5:
            net.shifts[lang] = best_threshold(logits[of], y[of])
    return net


def train(docs: DataFrame, labels: DataFrame, label: str, text: str, doc_id: str, folds: int, held: int, threshold: float, most_rows: int) -> Net:
    schema = pa.schema([("y", pa.int32()), ("key", pa.int64()), ("lang", pa.string()), ("buckets", pa.binary())])
    picked = F.broadcast(sample(docs, labels, label, doc_id, fold(doc_id, folds) != held, most_rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = {n: [] for n in schema.names}
            for y, i, t in rows(iter([batch]), "__y", "__lid", "__text"):
                ws = words_of(t)
                for n, v in zip(schema.names, (y, i, language(ws), hashed(ws).astype("<i4").tobytes()), strict=True):
                    out[n].append(v)
            yield emit(out, schema)

    given = docs.select(F.col(doc_id).alias("__did"), F.col(text).cast("binary").alias("__text"))
    joined = given.join(picked, F.col("__did") == F.col("__lid")).select("__y", "__lid", "__text")
    found = joined.mapInArrow(run, "y int, key long, lang string, buckets binary").toArrow().to_pydict()
    order = sorted(range(len(found["y"])), key=lambda i: (crc32(b"%d" % found["key"][i]), found["key"][i], found["y"][i], found["buckets"][i]))
    texts = [np.frombuffer(found["buckets"][i], "<i4").reshape(-1, 2).astype(np.int64) for i in order]
    y = np.array([found["y"][i] for i in order], float)
    fresh = np.array([crc32(b"fresh %d" % found["key"][i]) % 4 == 0 for i in order], bool)
    return fit(texts, [found["lang"][i] for i in order], y, fresh, threshold)


def classify(
    docs: DataFrame, labels: DataFrame, label: str = "toxic", text: str = "text", doc_id: str = "doc_id", folds: int = 3, held: int = 1, threshold: float = 0.7, most_rows: int = 1500
) -> DataFrame:
    """Per row: doc_id, held_out, score (0 to 1, higher: label 1 likelier), predicted (score >= threshold), language (as guessed)."""
    check_columns(docs, text, doc_id)
    check_columns(labels, label, doc_id)
    bounded_batches(docs.sparkSession)
    os.environ.setdefault("OMP_NUM_THREADS", "1")
    sent = docs.sparkSession.sparkContext.broadcast(train(docs, labels, label, text, doc_id, folds, held, threshold, most_rows))
    schema = pa.schema([("__id", pa.int64()), ("score", pa.float64()), ("language", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = sent.value
        for batch in batches:
            out = {n: [] for n in schema.names}
            for i, t in rows(iter([batch]), "__id", "__text"):
                ws = words_of(t)
                lang = language(ws)
                for n, v in zip(schema.names, (i, net.score(net.logit(hashed(ws)), lang), lang), strict=True):
                    out[n].append(v)
            yield emit(out, schema)

    out = docs.select(F.col(doc_id).cast("long").alias("__id"), F.col(text).cast("binary").alias("__text")).mapInArrow(run, "__id long, score double, language string")
    held_out = F.coalesce(fold("__id", folds) == held, F.lit(False))
    return out.select(F.col("__id").alias(doc_id), held_out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "language")
