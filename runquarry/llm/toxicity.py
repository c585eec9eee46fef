"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from runquarry.llm.common import lists, mix64, slices

_SIZES = (3, 4, 5, 6, 7, 8)
_BITS = 20


def _code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, lower-cased, ASCII signs and white space as spaces, each text within spaces; n + 1 offsets."""
    padded = [f" {t.lower()} ".encode("utf-32-le", "replace") for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(p) // 4 for p in padded])])
    points = np.frombuffer(b"".join(padded), dtype=np.uint32).copy()
    plain = points < 128
    word = (points - 97 < 26) | (points - 48 < 10)  # unsigned: below wraps round
    points[plain & ~word] = 32
    return points, offsets


def ngram_buckets(texts: list[str]):
    """For each n-gram size: (text numbers, buckets) of all n-grams that stay within a text."""
    points, offsets = _code_points(texts)
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), np.diff(offsets))
    letters = mix64(points.astype(np.uint64), 1)
    value, factor = letters.copy(), 1
    for n in range(2, max(_SIZES) + 1):
        factor = factor * 0x100000001B3 % (1 << 64)
        if len(points) < n:
            return
        value = value[:-1] + letters[n - 1:] * np.uint64(factor)
        if n in _SIZES:
            ok = owner[n - 1:] == owner[:len(points) - n + 1]
            yield n, owner[:len(points) - n + 1], (mix64(value, n) >> np.uint64(64 - _BITS)).astype(np.int32), ok


def _distinct(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, bucket, occurrences) of every bucket a text has."""
    keys = [o[ok].astype(np.int64) << _BITS | b[ok] for _, o, b, ok in ngram_buckets(texts)]
    if not keys:
        return (np.empty(0, np.int64),) * 3
    pairs, counts = np.unique(np.concatenate(keys), return_counts=True)
    return pairs >> _BITS, pairs & ((1 << _BITS) - 1), counts


@dataclass
class ToxicityModel:
    """``columns`` maps a bucket to a feature or -1; ``weights`` hold classifier weight times log-count ratio."""

    buckets: np.ndarray
    weights: np.ndarray
    bias: float

    def score(self, texts: list[str]) -> np.ndarray:
        """Probability of label 1. A feature that a text has c times weighs log2(1 + c) times as much as one that it has once."""
        table = np.full(1 << _BITS, -1, dtype=np.int32)
        table[self.buckets] = np.arange(len(self.buckets))
        keys = []
        for _, owner, bucket, ok in ngram_buckets(texts):
            f = table[bucket]
            hit = np.flatnonzero((f >= 0) & ok)
            keys.append(owner[hit].astype(np.int64) * len(self.buckets) + f[hit])
        pairs, counts = np.unique(np.concatenate(keys) if keys else np.empty(0, np.int64), return_counts=True)
        m = max(len(self.buckets), 1)
        sums = np.bincount(pairs // m, weights=self.weights[pairs % m] * np.log2(1 + counts), minlength=len(texts)) if len(pairs) else np.zeros(len(texts))
        return 1 / (1 + np.exp(-np.clip(sums + self.bias, -500, 500)))


def _fit_logistic(x: np.ndarray, y: np.ndarray, penalty: float, steps: int) -> tuple[np.ndarray, float]:
    """Ridge logistic regression by accelerated gradient steps; the bias is not penalised."""
    n, m = x.shape
    w, b = np.zeros(m, np.float64), float(np.log((y.mean() + 1e-9) / (1 - y.mean() + 1e-9)))
    v = np.ones(m)
    for _ in range(15):
        v = x.T @ (x @ v.astype(np.float32)).astype(np.float32)
        size = np.linalg.norm(v)
        if size == 0:
            return w, b
        v = v / size
    rate = 1 / (0.25 * size / n + penalty + 0.25)
    wo, bo, t = w, b, 1.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w.astype(np.float32) + b, -50, 50)))
        g = (p - y) / n
        wn, bn = w - rate * (x.T @ g.astype(np.float32) + penalty * w), b - rate * g.sum()
        tn = (1 + (1 + 4 * t * t) ** 0.5) / 2
        w, b = wn + (t - 1) / tn * (wn - wo), bn + (t - 1) / tn * (bn - bo)
        wo, bo, t = wn, bn, tn
    return wo, bo


def fit_toxicity(rows: DataFrame, key: str, text: str, label: str, max_rows: int = 20_000, features: int = 2048, least: int = 4,
                 penalty: float = 1e-3, steps: int = 400) -> ToxicityModel:
    """Train on a bounded sample of labelled rows: at most about ``max_rows`` of them, chosen by a hash of the key.

    The texts that have an n-gram (3 to 8 characters, hashed to 2**20 buckets) are counted per class on the
    cluster. The log-count ratio of a bucket is log((p + 1) / (|p| + 2)) - log((q + 1) / (|q| + 2)) of these counts.
    The ``features`` buckets that part the classes most surely (difference of the shares over its standard error)
    are kept; the driver gets these and, for every sampled row, how often it has which of them. The logistic regression
    runs on log2(1 + occurrences) times ratio: damped, so that neither one word nor the length of a text decides.

    Null labels, and keys that are null, are left out; a null text is empty. Without rows of both classes every score is
    the smoothed share of label 1.
    """
    rows = rows.where(F.col(label).isNotNull() & F.col(key).isNotNull()).select(
        F.col(key).cast("string").alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"), (F.col(label) > 0).cast("int").alias("y"))
    total = rows.count()
    if total > max_rows:
        rows = rows.where(F.pmod(F.xxhash64("k"), F.lit(1 << 30)) < int((1 << 30) * max_rows / total))

    def count(batches):
        sums: dict[int, np.ndarray] = {y: np.zeros(1 << _BITS, np.int32) for y in (0, 1)}
        docs = [0, 0]
        for batch in batches:
            for some in slices(batch, "t", 400_000):
                y = some.column("y").to_numpy()
                owner, bucket, _ = _distinct(some.column("t").to_pylist())
                for c in (0, 1):
                    docs[c] += int((y == c).sum())
                    sums[c] += np.bincount(bucket[y[owner] == c], minlength=1 << _BITS).astype(np.int32)
        found = np.flatnonzero(sums[0] + sums[1])
        yield pa.RecordBatch.from_arrays([pa.array(np.append(found, -1), pa.int32()), pa.array(np.append(sums[0][found], docs[0]), pa.int64()),
                                          pa.array(np.append(sums[1][found], docs[1]), pa.int64())], names=["b", "n", "p"])

    counts = rows.mapInArrow(count, "b int, n bigint, p bigint").groupBy("b").agg(F.sum("n").alias("n"), F.sum("p").alias("p"))
    counts = counts.where((F.col("n") + F.col("p") >= least) | (F.col("b") < 0)).toArrow()
    b, n, p = (counts.column(c).to_numpy().astype(np.float64) for c in "bnp")
    docs_n, docs_p = (float(x[b < 0].sum()) for x in (n, p))
    if docs_n < 1 or docs_p < 1:
        return ToxicityModel(np.empty(0, np.int64), np.empty(0), float(np.log((docs_p + 1) / (docs_n + 1))))
    n, p, b = n[b >= 0], p[b >= 0], b[b >= 0].astype(np.int64)
    share = (n + p + 1) / (docs_n + docs_p + 2)
    z = np.abs(p / docs_p - n / docs_n) / np.sqrt(share * (1 - share) * (1 / docs_p + 1 / docs_n))
    top = np.sort(np.lexsort((b, -z))[:features])
    buckets = b[top]
    # the share of an n-gram's texts, by class, smoothed by one text
    ratio = np.log((p[top] + 1) / (docs_p + 2)) - np.log((n[top] + 1) / (docs_n + 2))

    def present(batches):
        table = np.full(1 << _BITS, -1, dtype=np.int32)
        table[buckets] = np.arange(len(buckets))
        for batch in batches:
            for some in slices(batch, "t", 400_000):
                owner, bucket, times = _distinct(some.column("t").to_pylist())
                f = table[bucket]
                owner, times, f = owner[f >= 0], times[f >= 0], f[f >= 0]
                ends = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=some.num_rows))])
                yield pa.RecordBatch.from_arrays([some.column("y"), lists(f, ends, pa.int32()), lists(times, ends, pa.int64())], names=["y", "f", "c"])

    data = rows.mapInArrow(present, "y int, f array<int>, c array<bigint>").toArrow().combine_chunks()
    y = data.column("y").to_numpy().astype(np.float32)
    x = np.zeros((len(y), len(buckets)), dtype=np.float32)
    f, c = data.column("f").combine_chunks(), data.column("c").combine_chunks()
    x[np.repeat(np.arange(len(y)), np.diff(f.offsets.to_numpy())), f.values.to_numpy()] = np.log2(1 + c.values.to_numpy())
    x *= ratio.astype(np.float32)
    w, bias = _fit_logistic(x, y, penalty, steps)
    return ToxicityModel(buckets, w * ratio, bias)


def score_toxicity(docs: DataFrame, model: ToxicityModel, text: str = "text", score: str = "score") -> DataFrame:
    """``docs`` with ``score`` (0 to 1) of every whole text; null counts as empty. Nothing is shuffled.

    All columns of ``docs`` are kept, one called like ``score`` is replaced.
    """
    kept = [c for c in docs.columns if c != score]
    schema = docs.select(*kept).schema.add(score, "double")

    def run(batches):
        for batch in batches:
            for some in slices(batch, "_rq_text", 400_000):
                scores = model.score([t or "" for t in some.column("_rq_text").to_pylist()])
                yield pa.RecordBatch.from_arrays([*[some.column(i) for i in range(len(kept))], pa.array(scores, pa.float64())], names=[*kept, score])

    return docs.select(*[docs[c] for c in kept], F.col(text).cast("string").alias("_rq_text")).mapInArrow(run, schema)


def fold(key: Column) -> Column:
    """crc32 of the key as text, mod 3: fold 1 is held out. A null key is in no fold."""
    return F.crc32(key.cast("string")) % 3
