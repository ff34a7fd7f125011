"""Toxicity by a classifier chain of linear models.

Categories are predicted one after the other; each model sees which words a text has and the log odds that the chain
gave for the earlier categories. In training these come from out-of-fold predictions: a model that has not seen the row
made them, as will be so for new rows. The tables at hand label two categories, low quality and toxic, in that order.

The chain is fitted on at most `sample` labelled rows, those with the least hashes of their ids (a documented bound; all
rows are scored). Words are lower-cased runs of letters and digits; those that tell most about a category in the sample
(log-likelihood ratio of presence) become features, `features` for each category. Fitting is Newton's method with an L2
penalty, without randomness. A text counts as toxic at a probability of one half.

Null and empty texts have no features and get the models' intercepts. Rows with a null label or a null id are not used
for fitting. Without any usable rows of both kinds, a category's probability is its share (0.5 without rows).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import buffers, find_words, lean, slices, word_hashes
from .tiling import plain

CATEGORIES = ("low_quality", "toxic")


@dataclass
class Chain:
    """Words (sorted hashes) and, for each category, an intercept, weights of words and weights of earlier log odds."""

    words: np.ndarray
    models: list[tuple[float, np.ndarray, np.ndarray]] = field(default_factory=list)

    def log_odds(self, counts: list[np.ndarray]) -> np.ndarray:
        """counts: for each category the summed word weights of every row."""
        out: list[np.ndarray] = []
        for (start, _, earlier), words in zip(self.models, counts):
            out.append(start + words + sum((w * o for w, o in zip(earlier, out)), np.zeros(len(words))))
        return np.array(out)


def _present(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and word hashes, each pair once, of the texts in data[off[i]:off[i+1]]."""
    texts = [plain(data[a:b].tobytes()) for a, b in zip(off[:-1].tolist(), off[1:].tolist())]
    edges = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    piece = np.frombuffer(b"".join(texts), np.uint8)
    starts, ends, row = find_words(piece, edges)
    return row, word_hashes(piece, starts, ends)


def _words_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, off = buffers(batch.column("text"))
        out = []
        for i, j in slices(off):
            row, words = _present(data, off[i : j + 1])
            where = np.searchsorted(row, np.arange(j - i + 1))
            out += [np.unique(words[a:b]).tobytes() for a, b in zip(where[:-1].tolist(), where[1:].tolist())]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), pa.array(out, pa.binary())], names=["doc_id", "y", "words"])


def _fit(x: np.ndarray, y: np.ndarray, penalty: float = 1.0, steps: int = 30) -> np.ndarray:
    """Intercept and weights of a penalised logistic regression."""
    x = np.concatenate([np.ones((len(x), 1)), x], axis=1)
    w, ridge = np.zeros(x.shape[1]), np.full(x.shape[1], penalty)
    ridge[0] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(ridge), x.T @ (y - p) - ridge * w)
        size = np.abs(step).max()
        w += step * min(1.0, 4.0 / max(size, 1e-12))
        if size < 1e-6:
            break
    return w


def _telling(y: np.ndarray, rows: np.ndarray, words: np.ndarray, n: int, least: int = 5) -> np.ndarray:
    """The n words whose presence tells most about y, by log-likelihood ratio."""
    names, at = np.unique(words, return_inverse=True)
    have = np.bincount(at, minlength=len(names)).astype(float)
    pos = np.bincount(at, weights=y[rows], minlength=len(names))
    total, yes = float(len(y)), float(y.sum())
    score = np.zeros(len(names))
    for seen, whole in ((pos, have * yes / total), (have - pos, have * (1 - yes / total)), (yes - pos, (total - have) * yes / total), (total - yes - have + pos, (total - have) * (1 - yes / total))):
        score += 2 * seen * np.log(np.maximum(seen, 1e-12) / np.maximum(whole, 1e-12))
    score[have < least] = -1
    best = np.argsort(-score, kind="stable")[:n]
    return names[best[score[best] > 0]]


def fit_chain(y: np.ndarray, words: list[np.ndarray], folds: np.ndarray, features: int = 300) -> Chain:
    """A chain for labels y (rows x categories) and the word hashes of each row."""
    n = len(words)
    rows = np.repeat(np.arange(n), [len(w) for w in words])
    flat = np.concatenate(words) if n else np.zeros(0, np.uint64)
    mixed = [0 < y[:, c].sum() < n for c in range(y.shape[1])]
    chosen = [_telling(y[:, c], rows, flat, features) for c in range(y.shape[1]) if mixed[c]]
    names = np.unique(np.concatenate(chosen)) if chosen else np.zeros(0, np.uint64)
    x = np.zeros((n, len(names)))
    if len(names):
        at = np.minimum(np.searchsorted(names, flat), len(names) - 1)
        hit = names[at] == flat
        x[rows[hit], at[hit]] = 1
    chain, earlier = Chain(names), np.zeros((n, 0))
    for c in range(y.shape[1]):
        if not mixed[c]:
            share = min(max(float(y[:, c].mean()) if n else 0.5, 1e-6), 1 - 1e-6)
            chain.models.append((float(np.log(share / (1 - share))), np.zeros(len(names)), np.zeros(c)))
            earlier = np.concatenate([earlier, np.full((n, 1), chain.models[-1][0])], axis=1)
            continue
        whole = np.concatenate([x, earlier], axis=1)
        out = np.zeros(n)
        for f in np.unique(folds):
            train = folds != f
            w = _fit(whole[train], y[train, c]) if 0 < y[train, c].sum() < train.sum() else np.zeros(whole.shape[1] + 1)
            out[~train] = w[0] + whole[~train] @ w[1:]
        w = _fit(whole, y[:, c])
        chain.models.append((float(w[0]), w[1 : 1 + len(names)], w[1 + len(names) :]))
        earlier = np.concatenate([earlier, out[:, None]], axis=1)
    return chain


def train_toxicity(docs: DataFrame, labels: DataFrame, sample: int = 8000, folds: int = 5, features: int = 300) -> Chain:
    """A chain learnt from at most `sample` rows of labels(doc_id, quality, toxic) and their texts."""
    usable = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("quality").alias("q"), F.max("toxic").alias("t"))
    picked = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).selectExpr("doc_id", "CAST((1 - q) + 2 * t AS INT) AS y")
    # At most `sample` rows of two numbers; of documents with the same id one text is used, so no more rows than that are gathered.
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(picked), "doc_id")
    rows = rows.groupBy("doc_id", "y").agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("doc_id", "y", "text")
    found = sorted(((r[0], r[1], bytes(r[2])) for r in rows.mapInArrow(_words_of, "doc_id long, y int, words binary").collect()), key=lambda r: (r[0], r[2]))
    y = np.array([[r[1] & 1, r[1] >> 1] for r in found], float).reshape(-1, 2)
    return fit_chain(y, [np.frombuffer(r[2], np.uint64) for r in found], np.arange(len(found)) % folds, features)


def _score(chain: Chain):
    bits = 1 << max(12, len(chain.words).bit_length() + 6)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maybe = np.zeros(bits, bool)
        maybe[(chain.words & np.uint64(bits - 1)).astype(np.int64)] = True
        for batch in batches:
            data, off = buffers(batch.column("text"))
            out = []
            for i, j in slices(off):
                row, words = _present(data, off[i : j + 1])
                at = np.flatnonzero(maybe[(words & np.uint64(bits - 1)).astype(np.int64)])
                where = np.minimum(np.searchsorted(chain.words, words[at]), max(len(chain.words) - 1, 0))
                hit = chain.words[where] == words[at] if len(chain.words) else np.zeros(0, bool)
                pair = np.unique(row[at][hit] * (len(chain.words) + 1) + where[hit])
                r, w = pair // (len(chain.words) + 1), pair % (len(chain.words) + 1)
                out.append(chain.log_odds([np.bincount(r, weights=m[1][w], minlength=j - i) for m in chain.models]))
            odds = np.concatenate(out, axis=1) if out else np.zeros((len(chain.models), 0))
            p = 1 / (1 + np.exp(-np.clip(odds, -500, 500)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(x) for x in p)], names=["doc_id", *(f"p_{c}" for c in CATEGORIES)])

    return lean(run)


def score_toxicity(docs: DataFrame, chain: Chain, threshold: float = 0.5) -> DataFrame:
    """doc_id, p_low_quality, p_toxic and toxic for every row of docs(doc_id, text)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(_score(chain), "doc_id long, p_low_quality double, p_toxic double").withColumn("toxic", F.col("p_toxic") >= threshold)
