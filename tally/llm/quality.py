"""Quality classifier: regularised quadratic discriminant over document statistics.

Each text becomes ``FEATURES`` (logs and square roots of counts and shares, so
that they are closer to normal). Each class has a mean and a covariance, shrunk
towards the pooled covariance and its diagonal; the Cholesky factors are made
once and kept with the model. A score is the posterior of label 1 from the
difference of the two log densities.

Training reads at most ``LABEL_BOUND`` labelled rows (the smallest hashes), only
those that ``train`` allows; everything else covers all documents. Null texts
count as empty. Without labels of both classes every score is the share of label
1 (0.5 without any). Null ids and repeated rows are scored like any other row;
labels of an id that is repeated or contradictory count once, the larger label
wins. Extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tally.llm.common import bounded_labels, map_arrow, one_row_an_id, text_or_empty

LABEL_BOUND = 30_000
POOL, RIDGE = 0.2, 0.05   # shrinkage to the pooled covariance, and to the diagonal
TEMPERATURE = 4.0         # statistics are dependent: the difference of log densities is divided by this
CUT = 0.3
FEATURES = ("log_words", "log_mean_word", "distinct", "repeats_next", "upper", "digits", "marks", "mark_runs",
            "mark_words", "capital_words", "bars", "distinct_lines", "log_line", "short_words", "stops", "entropy")

_KIND = np.zeros(256, dtype=np.int64)  # of a byte: 0 other, 1 upper, 2 digit, 3 mark
_KIND[65:91], _KIND[48:58] = 1, 2
_KIND[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = 3


def statistics(text: str) -> list[float]:
    """The features of one text, in the order of FEATURES."""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    counts = np.bincount(raw, minlength=256)
    kinds = np.bincount(_KIND, weights=counts, minlength=4)
    size = len(raw)
    is_mark = _KIND[raw] == 3
    runs = int(np.count_nonzero(is_mark[1:] & (raw[1:] == raw[:-1])))
    same = sum(map(eq, words, words[1:]))
    capital = sum(map(str.isupper, words))
    marks = sum(1 for w in words if not w[-1].isalnum())
    lines = [x for x in text.split("\n") if x]
    share = counts[counts > 0] / size
    root = lambda x: float(np.sqrt(max(0.0, x)))
    return [float(np.log1p(n)), float(np.log(size / n)), len(set(words)) / n ** 0.8, root(same / n),
            root(kinds[1] / size), root(kinds[2] / size), root(kinds[3] / size), root(runs / size),
            root(marks / n), root(capital / n), root(counts[124] / n), len(set(lines)) / len(lines),
            float(np.log1p(n / len(lines))), root(sum(1 for w in words if len(w) < 4) / n),
            root((counts[46] + counts[63]) / n), float(-(share * np.log(share)).sum())]


@dataclass
class Model:
    """Per class: mean, inverse Cholesky factor, log determinant; standardisation and the prior's log odds."""
    centre: np.ndarray
    scale: np.ndarray
    means: list[np.ndarray]
    factors: list[np.ndarray]
    log_dets: list[float]
    prior: float
    flat: float | None = None

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.flat is not None:
            return np.full(len(x), self.flat)
        z = np.clip((x - self.centre) / self.scale, -12, 12)
        logs = []
        for k in (0, 1):
            y = (z - self.means[k]) @ self.factors[k].T
            logs.append(-0.5 * (np.einsum("ij,ij->i", y, y) + self.log_dets[k]))
        odds = np.clip(self.prior + (logs[1] - logs[0]) / TEMPERATURE, -50, 50)
        return 1 / (1 + np.exp(-odds))


def fit(x: np.ndarray, label: np.ndarray) -> Model:
    label = label.astype(bool)
    n = len(label)
    if not n or label.all() or not label.any():
        empty = np.zeros(0)
        return Model(empty, empty, [], [], [], 0.0, float(label.mean()) if n else 0.5)
    centre, scale = x.mean(0), x.std(0) + 1e-6
    z = np.clip((x - centre) / scale, -12, 12)
    parts = [z[~label], z[label]]
    means = [p.mean(0) for p in parts]
    covs = [(p - m).T @ (p - m) / max(1, len(p)) for p, m in zip(parts, means)]
    pooled = (covs[0] * len(parts[0]) + covs[1] * len(parts[1])) / n
    factors, log_dets = [], []
    for c in covs:
        s = (1 - POOL) * c + POOL * pooled
        s = (1 - RIDGE) * s + RIDGE * (np.trace(s) / len(s) + 1e-3) * np.eye(len(s))
        root = np.linalg.cholesky(s)
        factors.append(np.linalg.inv(root))
        log_dets.append(float(2 * np.log(np.diag(root)).sum()))
    return Model(centre, scale, means, factors, log_dets, float(np.log(len(parts[1]) / len(parts[0]))))


def features(docs: DataFrame, keep: str = "") -> DataFrame:
    """doc_id, the columns named in ``keep`` ("name type, ..."), x array<double>."""
    kept = [k.split()[0] for k in keep.split(", ") if k]

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = pa.array([statistics(t) for t in batch.column("text").to_pylist()], pa.list_(pa.float64()))
        return pa.RecordBatch.from_arrays([batch.column(c) for c in ("doc_id", *kept)] + [x], names=["doc_id", *kept, "x"])

    return map_arrow(docs.select("doc_id", *kept, text_or_empty().alias("text")), one,
                     "doc_id long, " + (keep + ", " if keep else "") + "x array<double>")


def train_model(docs: DataFrame, labels: DataFrame, train: Column, bound: int = LABEL_BOUND) -> Model:
    """Fitted on the labelled documents that ``train`` (over ``doc_id``) allows."""
    chosen = bounded_labels(labels, "quality", train, bound)
    labelled = one_row_an_id(docs, chosen)
    got = features(labelled, "label int").select("label", "x").toArrow()
    x = np.array(got.column("x").to_pylist(), dtype=float).reshape(-1, len(FEATURES))
    return fit(x, np.array(got.column("label").to_pylist(), dtype=int))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score of every document."""
    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column("text").to_pylist()
        x = np.array([statistics(t) for t in texts], dtype=float).reshape(len(texts), len(FEATURES))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.score(x), pa.float64())],
                                          names=["doc_id", "score"])

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")), one,
                     "doc_id long, score double")
