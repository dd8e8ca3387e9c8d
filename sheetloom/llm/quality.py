"""Quality scores by Bradley-Terry ranking (operator 5).

A document has a worth w . x, where x are features of its text alone. Of a pair with labels 1 and
0, the first is preferred with probability sigmoid(w . (x1 - x0)); w is fitted to many such pairs
by the logistic loss on feature differences. The cut between the labels is the quantile of the
training scores that the share of label 0 gives; a logistic curve through it (CUT at the cut, its
slope fitted on the training labels) turns worth into a score from 0 to 1.

Fitting uses a bounded sample: at most SAMPLE labels outside the held-out fold, picked by a hash of
their ids, at most as many documents that have them (where ids repeat, picked by a hash of id and
text), and PAIRS pairs of them. Scoring runs over every document.

Defined cases: null text is empty and gets a score like any other; labels that are null, or whose
document is missing, are not used; with labels of one kind only, every score is that kind's; without
any usable label nothing is known against a document, so every score is over the cut; other columns are ignored or, in ``with_score``, passed through; repeated rows come back once each; an
empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, id_and_text, texts_of

SAMPLE, PAIRS, RIDGE = 20_000, 200_000, 1e-3
#: Scores from here on are label 1.
CUT = 0.3
FOLDS = 5
_UPPER, _LOWER, _DIGIT, _SPACE, _SYMBOL, _STOP = (np.isin(np.arange(256), list(c)) for c in (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b" \t\r\n", b"#$%&*+/<=>@[]^_`{|}~\\", b".!?"))
N_BASE = 20


def features(text: bytes) -> list[float]:
    """Shares and averages that do not depend on the language; all are finite for any text."""
    data = np.frombuffer(text, np.uint8)
    counts = np.bincount(data, minlength=256)
    n = max(1, len(data))
    letters = max(1, int(counts[_UPPER | _LOWER].sum() + counts[128:].sum()))
    words = text.split()
    m = max(1, len(words))
    lines = [line for line in text.split(b"\n") if line.strip()]
    k = max(1, len(lines))
    seen = Counter(words)
    most = seen.most_common(1)[0][1] if words else 0
    doubled = sum(map(bytes.__eq__, words, words[1:]))
    shouted = sum(w.isupper() and len(w) > 1 for w in words)
    bare = sum(not w.isalnum() and len(w) == 1 for w in words)
    marked = sum(w[-1:] in b"#$%&*+~=" for w in words)
    loud = sum(w.endswith(b"!!") for w in words)
    trigrams = len(set(zip(words, words[1:], words[2:], strict=False)))
    return [
        np.log1p(len(words)),
        n / m,
        counts[_UPPER].sum() / letters,
        counts[_DIGIT].sum() / n,
        counts[_SPACE].sum() / n,
        counts[_SYMBOL].sum() / n,
        counts[_STOP].sum() / m,
        counts[ord(",")] / m,
        counts[ord("!")] / m,
        counts[ord("|")] / m,
        len(seen) / m,
        most / m,
        doubled / m,
        shouted / m,
        bare / m,
        marked / m,
        loud / m,
        trigrams / max(1, len(words) - 2),
        len(set(lines)) / k,
        np.log1p(len(words) / k),
    ]


def matrix(texts: Iterator[bytes]) -> np.ndarray:
    """One row of features per text: each, its square root and its square."""
    base = np.array([features(t) for t in texts], np.float64).reshape(-1, N_BASE)
    return np.concatenate([base, np.sqrt(np.abs(base)), base**2], axis=1)


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    cut: float
    slope: float

    def worth(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -10, 10) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.clip(self.slope * (self.worth(x) - self.cut), -30, 30)
        return 1 / (1 + np.exp(-z) * (1 - CUT) / CUT)


def _newton(d: np.ndarray, y: np.ndarray, ridge: float, rounds: int = 25) -> np.ndarray:
    """Weights of a logistic regression without intercept."""
    w = np.zeros(d.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(d @ w, -30, 30)))
        gradient = d.T @ (p - y) / len(y) + ridge * w
        hessian = (d * (p * (1 - p))[:, None]).T @ d / len(y) + ridge * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit(x: np.ndarray, label: np.ndarray, pairs: int = PAIRS, seed: int = 5) -> Model:
    mean = x.mean(0) if len(x) else np.zeros(3 * N_BASE)
    scale = (x.std(0) if len(x) else np.ones(3 * N_BASE)) + 1e-9
    good, bad = np.flatnonzero(label == 1), np.flatnonzero(label == 0)
    if not len(good) or not len(bad):
        return Model(mean, scale, np.zeros(x.shape[1]), 1.0 if len(bad) else -1.0, 5.0)
    z = np.clip((x - mean) / scale, -10, 10)
    rng = np.random.default_rng(seed)
    d = z[rng.choice(good, pairs)] - z[rng.choice(bad, pairs)]
    w = _newton(d, np.ones(pairs), RIDGE)
    worth = z @ w
    share = len(bad) / len(label)
    cut = float(np.quantile(worth, share, method="midpoint"))
    slope = float(_newton((worth - cut)[:, None], label.astype(np.float64), 1e-3)[0])
    return Model(mean, scale, w, cut, max(slope, 1e-3))


def held_out(doc_id: Column) -> Column:
    """Is the document in the fold that is not learned from?"""
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> Model:
    """Fit on at most ``sample`` labelled documents outside the held-out fold."""
    bound_batches(docs.sparkSession)
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("_label")).where(f"doc_id IS NOT NULL AND _label IN (0, 1)")
    picked = known.where(~held_out(F.col("doc_id"))).orderBy(F.xxhash64("doc_id"), "doc_id", "_label").limit(sample)

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(iter(texts_of(batch.column("text"))))
            yield pa.record_batch([batch.column("_label"), batch.column("_order"), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))], names=["_label", "_order", "x"])

    # the picked labels are at most ``sample`` rows of two numbers, so they can be broadcast; where ids
    # repeat, they can have more documents, of which the first ones by hash are learned from
    held = id_and_text(docs).join(F.broadcast(picked), "doc_id").withColumn("_order", F.xxhash64("doc_id", "text"))
    found = held.mapInArrow(compute, "_label int, _order long, x array<double>")
    rows = found.orderBy("_order", "_label").limit(sample).select("_label", "x").toArrow()
    x = np.array(rows.column("x").to_pylist(), np.float64).reshape(-1, 3 * N_BASE)
    order = np.lexsort(x.T)  # the same fit in whatever order rows come
    return fit(x[order], rows.column("_label").to_numpy()[order])


def with_score(docs: DataFrame, model: Model, name: str) -> DataFrame:
    """docs, all columns, with a score column of that name."""
    bound_batches(docs.sparkSession)
    whole = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.struct(*docs.columns).alias("row"))

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(iter(texts_of(batch.column("text"))))
            yield pa.record_batch([batch.column("row"), pa.array(model.score(x))], names=["row", "score"])

    found = whole.mapInArrow(compute, f"row {whole.schema['row'].dataType.simpleString()}, score double")
    return found.select("row.*", F.col("score").alias(name))


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted."""
    scored = with_score(id_and_text(docs), train(docs, labels), "score")
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
