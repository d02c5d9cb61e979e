"""Quality classifier: naive Bayes support vectors.

A text is the set of its n-grams: words and word pairs, and single and paired shapes of words (letters folded by case,
digits to 0, other signs kept), each hashed to a bucket, and a few indicators of how much it repeats itself. Each
indicator is scaled by its log-count ratio between the classes, and a linear hinge-loss model on them is fit by dual
coordinate descent. Margins become scores by a logistic curve fit on rows kept out of the fit.

Bound: the model is fit on at most ``most_rows`` labelled rows of each class, those with the smallest hash of their id.

Defined cases: null and empty texts have no n-grams and get the score of the bias alone; labels that are null are left
out; an id with several labels counts once for each; with no labelled rows, or one class, scores are the constant
share of ones (0.5 without labels); repeated rows are each scored, and each learnt from; rows to learn from are
taken in an order of their own (hash, label, content), so ties don't depend on where rows come from; ids are integers; extra columns
are ignored, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import bounded_batches, check_columns, emit, rows

BUCKETS = 1 << 18
_LETTERS = re.compile(rb"([aA0])\1+")
#: ASCII letters to a or A, digits to 0, bytes of longer characters to a.
_SHAPE = bytes(0x61 if 97 <= b <= 122 or b >= 128 else 0x41 if 65 <= b <= 90 else 0x30 if 48 <= b <= 57 else b for b in range(256))


def _numbers(words: list[bytes], salt: int) -> np.ndarray:
    return np.array([crc32(w, salt) for w in words], np.uint64)


def _mixed(a: np.ndarray) -> np.ndarray:
    a = (a ^ (a >> np.uint64(15))) * np.uint64(0x9E3779B97F4A7C15)
    return ((a >> np.uint64(40)) % np.uint64(BUCKETS)).astype(np.int64)


def _pairs(a: np.ndarray) -> np.ndarray:
    return a[:-1] * np.uint64(0x100000001B3) + a[1:] + np.uint64(7)


def features(text: bytes | None) -> np.ndarray:
    """The sorted distinct buckets of the text's indicators."""
    body = text or b""
    words = body.lower().split()
    if not words:
        return np.zeros(0, np.int64)
    shapes = _LETTERS.sub(rb"\1", body.translate(_SHAPE)).split()
    w, s = _numbers(words, 1), _numbers(shapes, 2)
    n = len(words)
    same = int((w[1:] == w[:-1]).sum())
    distinct = len(np.unique(w))
    marks = [f"same {_step(same / n)}", f"distinct {_step(distinct / n)} {min(n.bit_length(), 7)}", f"size {n.bit_length()}", f"mean {min(len(body) // n, 40)}"]
    return np.unique(np.concatenate([_mixed(w), _mixed(_pairs(w)), _mixed(s), _mixed(_pairs(s)), _mixed(_numbers([m.encode() for m in marks], 3))]))


def _step(share: float) -> int:
    return int(min(9, math.ceil(share * 10)))


@dataclass
class Model:
    weights: np.ndarray  # by bucket: ratio times weight
    bias: float
    slope: float
    shift: float

    def score(self, found: np.ndarray) -> float:
        margin = float(self.weights[found].sum() / math.sqrt(max(len(found), 1))) + self.bias
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.slope * margin + self.shift))))


def descend(rows_: list[np.ndarray], y: np.ndarray, scale: np.ndarray, cost: float = 1.0, rounds: int = 12, seed: int = 7) -> tuple[np.ndarray, float]:
    """Dual coordinate descent for the L2-regularised hinge loss on rows of scaled indicators, each of about unit length, with a bias."""
    rng = np.random.default_rng(seed)
    weights, bias, alpha = np.zeros(len(scale)), 0.0, np.zeros(len(y))
    values = [scale[r] / math.sqrt(max(len(r), 1)) for r in rows_]
    norms = np.array([(v * v).sum() + 1 for v in values])
    bound = cost * np.where(y > 0, 0.5 * len(y) / max((y > 0).sum(), 1), 0.5 * len(y) / max((y < 0).sum(), 1))
    for _ in range(rounds):
        most = 0.0
        for i in rng.permutation(len(y)):
            r, v = rows_[i], values[i]
            slope = y[i] * (weights[r] @ v + bias) - 1
            new = min(max(alpha[i] - slope / norms[i], 0.0), bound[i])
            step = (new - alpha[i]) * y[i]
            if step:
                weights[r] += step * v
                bias += step
                alpha[i] = new
                most = max(most, abs(step))
        if most < 1e-3:
            break
    return weights, bias


def fit(rows_: list[np.ndarray], y: np.ndarray, fresh: np.ndarray, smoothing: float = 1.0) -> Model:
    """rows_: indicators of each text; y: 1 or 0; fresh: the rows kept out of the fit, for the curve from margins to scores."""
    ones, share = y == 1, float(y.mean()) if len(y) else 0.5
    if not ones.any() or ones.all():
        return Model(np.zeros(BUCKETS), 0.0, 0.0, math.log(max(share, 1e-3) / max(1 - share, 1e-3)))
    if any((~fresh & (y == c)).sum() == 0 for c in (0, 1)):
        fresh = np.zeros(len(y), bool)
    used = np.flatnonzero(~fresh)
    p, q = (np.bincount(np.concatenate([rows_[i] for i in used if y[i] == c] or [np.zeros(0, np.int64)]), minlength=BUCKETS) + smoothing for c in (1, 0))
    ratio = np.log(p / (ones & ~fresh).sum()) - np.log(q / (~ones & ~fresh).sum())
    ratio[(p + q) <= 2 * smoothing + 1] = 0  # seen once at most: tells nothing
    weights, bias = descend([rows_[i] for i in used], np.where(y[used] == 1, 1.0, -1.0), ratio)
    model = Model(weights * ratio, bias, 1.0, 0.0)
    judged = np.flatnonzero(fresh) if all((fresh & (y == c)).any() for c in (0, 1)) else np.arange(len(y))
    margins = np.array([model.weights[rows_[i]].sum() / math.sqrt(max(len(rows_[i]), 1)) + bias for i in judged])
    model.slope, model.shift = logistic(margins, y[judged].astype(float))
    return model


def logistic(x: np.ndarray, y: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope and shift of a logistic curve by Newton's method, targets pulled in a little and slopes kept positive."""
    ones, zeros = y.sum(), (1 - y).sum()
    target = np.where(y > 0, (ones + 1) / (ones + 2), 1 / (zeros + 2))
    a, b = 1.0, 0.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        g = np.array([((p - target) * x).sum() + 1e-3 * (a - 1), (p - target).sum()])
        v = p * (1 - p) + 1e-9
        h = np.array([[(v * x * x).sum() + 1e-3, (v * x).sum()], [(v * x).sum(), v.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return (float(a), float(b)) if a > 0 and math.isfinite(a) and math.isfinite(b) else (1.0, 0.0)


def fold(doc_id: str, folds: int) -> Column:
    """crc32 of the id as text, modulo folds; null for a null id."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(folds))


def sample(docs: DataFrame, labels: DataFrame, label: str, doc_id: str, allowed: Column, most_rows: int) -> DataFrame:
    """Labelled rows that may be learnt from, at most so many of each class, by the smallest hash of their id: (id, label)."""
    given = labels.filter(F.col(label).isin(0, 1) & F.coalesce(allowed, F.lit(False))).select(F.col(doc_id).alias("__lid"), F.col(label).cast("int").alias("__y"))
    parts = [given.filter(F.col("__y") == c).orderBy(F.xxhash64("__lid"), "__lid").limit(most_rows) for c in (0, 1)]
    return parts[0].unionByName(parts[1])


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", text: str = "text", doc_id: str = "doc_id", folds: int = 5, held: int = 0, most_rows: int = 4000) -> Model:
    schema = pa.schema([("y", pa.int32()), ("fresh", pa.bool_()), ("buckets", pa.binary())])
    picked = F.broadcast(sample(docs, labels, label, doc_id, fold(doc_id, folds) != held, most_rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = {"y": [], "fresh": [], "buckets": []}
            for y, i, t in rows(iter([batch]), "__y", "__lid", "__text"):
                out["y"].append(y)
                out["fresh"].append(crc32(b"fresh %d" % i) % 5 == 0)
                out["buckets"].append(features(t).astype("<i4").tobytes())
            yield emit(out, schema)

    given = docs.select(F.col(doc_id).alias("__did"), F.col(text).cast("binary").alias("__text"))
    joined = given.join(picked, F.col("__did") == F.col("__lid")).select("__y", "__lid", "__text")
    found = joined.mapInArrow(run, "y int, fresh boolean, buckets binary").toArrow()
    held_rows = list(zip(*(found[n].to_pylist() for n in ("buckets", "y", "fresh")), strict=True))
    order = sorted(range(len(held_rows)), key=lambda i: (hash_of(held_rows[i][0]), held_rows[i][1:], held_rows[i][0]))
    sets = [np.frombuffer(b, "<i4").astype(np.int64) for b, _, _ in held_rows]
    y, fresh = (np.array([r[k] for r in held_rows]) for k in (1, 2))
    return fit([sets[i] for i in order], y[order] if len(order) else np.zeros(0), fresh[order].astype(bool) if len(order) else np.zeros(0, bool))


def hash_of(data: bytes) -> int:
    return crc32(data)


def classify(
    docs: DataFrame, labels: DataFrame, label: str = "quality", text: str = "text", doc_id: str = "doc_id", folds: int = 5, held: int = 0, threshold: float = 0.3, most_rows: int = 4000
) -> DataFrame:
    """Per row: doc_id, held_out, score (0 to 1, higher: label 1 likelier), predicted (score >= threshold)."""
    check_columns(docs, text, doc_id)
    check_columns(labels, label, doc_id)
    bounded_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(train(docs, labels, label, text, doc_id, folds, held, most_rows))
    schema = pa.schema([("__id", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            ids, scores = [], []
            for i, t in rows(iter([batch]), "__id", "__text"):
                ids.append(i)
                scores.append(model.score(features(t)))
            yield emit({"__id": ids, "score": scores}, schema)

    out = docs.select(F.col(doc_id).cast("long").alias("__id"), F.col(text).cast("binary").alias("__text")).mapInArrow(run, "__id long, score double")
    held_out = F.coalesce(fold("__id", folds) == held, F.lit(False))
    return out.select(F.col("__id").alias(doc_id), held_out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
