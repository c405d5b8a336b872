"""Toxicity: a chain of linear classifiers, later ones fed the earlier categories' probabilities."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, lower_table, mix64, pieces, text_column

#: Labelled rows that the chain is fitted on at most: those with the smallest hashes of their ids.
SAMPLE = 6_000
#: Words that a category's model uses at most, and the least rows of the sample a word must occur in.
FEATURES, LEAST_ROWS = 200, 3
#: Parts of the sample for out-of-fold predictions.
FOLDS = 5
#: The categories in the order of the chain; the first are false where the label column is 1.
CATEGORIES = (("junk", "quality", 0), ("toxic", "toxic", 1))
N_DENSE = 5


def word_table() -> np.ndarray:
    return lower_table(lambda c: c >= 0x80 or 0x61 <= c <= 0x7A)


SYMBOL = np.zeros(256, bool)
SYMBOL[[ord(c) for c in "#*$%&|<>!"]] = True
UPPER = np.zeros(256, bool)
UPPER[65:91] = True


def extract(data: np.ndarray, off: np.ndarray, table: np.ndarray) -> tuple[Words, np.ndarray]:
    """Words of a batch and its dense features: length, share of symbols and of capitals, word length, variety."""
    w = Words(data, off, table)
    n = len(off) - 1
    size = np.maximum(np.diff(off), 1).astype(float)
    count = np.diff(w.first).astype(float)

    def share(flag):
        upto = np.concatenate(([0], np.cumsum(flag[data])))
        return (upto[off[1:]] - upto[off[:-1]]) / size

    letters = np.bincount(w.doc, weights=w.end - w.start, minlength=n)
    order = np.lexsort((w.hash, w.doc))
    h, d = w.hash[order], w.doc[order]
    first = np.ones(len(h), bool)
    first[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    distinct = np.bincount(d[first], minlength=n)
    dense = np.column_stack([np.log1p(count), share(SYMBOL), share(UPPER), letters / np.maximum(count, 1), distinct / np.maximum(count, 1)])
    return w, dense


@dataclass
class Model:
    """One linear model: hashes of its words (sorted), their weights, and the weights of standardized dense features."""

    words: np.ndarray
    weight: np.ndarray
    dense: np.ndarray
    bias: float
    centre: np.ndarray
    spread: np.ndarray

    def logits(self, w_hash, w_doc, dense: np.ndarray) -> np.ndarray:
        z = np.clip((dense - self.centre) / self.spread, -6, 6) @ self.dense + self.bias
        if len(self.words) and len(w_hash):
            at = np.minimum(np.searchsorted(self.words, w_hash), len(self.words) - 1)
            hit = np.flatnonzero(self.words[at] == w_hash)
            pair = np.unique(w_doc[hit] * np.int64(len(self.words)) + at[hit])
            z += np.bincount(pair // len(self.words), weights=self.weight[pair % len(self.words)], minlength=len(dense))
        return z


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def fit(w_hash: np.ndarray, w_doc: np.ndarray, dense: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> Model:
    """Ridge-penalized logistic regression by Newton's method on the words that tell the classes apart best.
    (w_hash, w_doc) are distinct."""
    n = len(y)
    words, inverse = np.unique(w_hash, return_inverse=True)
    total = np.bincount(inverse, minlength=len(words)).astype(float)
    positive = np.bincount(inverse, weights=y[w_doc], minlength=len(words))
    rate = y.mean()
    z = (positive - total * rate) / np.sqrt(np.maximum(total * rate * (1 - rate), 1e-9))
    z[total < LEAST_ROWS] = 0
    best = np.argsort(-np.abs(z), kind="stable")[:FEATURES]
    best = np.sort(best[np.abs(z[best]) > 3.0])
    column = np.full(len(words), -1)
    column[best] = np.arange(len(best))
    keep = column[inverse] >= 0
    centre, spread = dense.mean(0), dense.std(0) + 1e-6
    x = np.zeros((n, len(best) + dense.shape[1] + 1))
    x[w_doc[keep], column[inverse][keep]] = 1
    x[:, len(best) : -1] = np.clip((dense - centre) / spread, -6, 6)
    x[:, -1] = 1
    beta = np.zeros(x.shape[1])
    beta[-1] = np.log((rate + 1e-6) / (1 - rate + 1e-6))
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    if 0 < rate < 1:
        for _ in range(12):
            p = sigmoid(x @ beta)
            s = np.maximum(p * (1 - p), 1e-6)
            step = np.linalg.solve((x * s[:, None]).T @ x + np.diag(penalty), x.T @ (y - p) - penalty * beta)
            beta += step / max(1.0, np.abs(step).max() / 4)
            if np.abs(step).max() < 1e-4:
                break
    k = len(best)
    return Model(words[best], beta[:k], beta[k:-1], float(beta[-1]), centre, spread)


@dataclass
class Chain:
    """Models in the chain's order, and the probability from which each category is said to hold."""

    models: list[Model]
    cuts: list[float]

    def probabilities(self, w_hash, w_doc, dense: np.ndarray) -> np.ndarray:
        out = []
        for model in self.models:
            out.append(sigmoid(model.logits(w_hash, w_doc, dense)))
            dense = np.column_stack([dense, out[-1]])
        return np.column_stack(out)


def best_cut(p: np.ndarray, y: np.ndarray) -> float:
    """The probability, in the middle of its gap, at which out-of-fold predictions have the best F1."""
    if not 0 < y.mean() < 1:
        return 0.5 if y.mean() == 0 else 0.0
    order = np.argsort(-p, kind="stable")
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + y.sum())
    k = int(f1.argmax())
    after = p[order[k + 1]] if k + 1 < len(p) else 0.0
    return float(np.clip((p[order[k]] + after) / 2, 0.05, 0.95))


def fit_chain(w_hash, w_doc, dense: np.ndarray, targets: list[np.ndarray], fold: np.ndarray) -> Chain:
    """A model per category on all rows; what a later one learns about an earlier one are out-of-fold probabilities."""
    models, cuts = [], []
    for y in targets:
        oof = np.zeros(len(y))
        for f in np.unique(fold):
            rows, held = np.flatnonzero(fold != f), np.flatnonzero(fold == f)
            if not len(rows):
                rows = held
            place = np.full(len(y), -1)
            place[rows] = np.arange(len(rows))
            use = place[w_doc] >= 0
            model = fit(w_hash[use], place[w_doc[use]], dense[rows], y[rows])
            place[:] = -1
            place[held] = np.arange(len(held))
            use = place[w_doc] >= 0
            oof[held] = sigmoid(model.logits(w_hash[use], place[w_doc[use]], dense[held]))
        models.append(fit(w_hash, w_doc, dense, y))
        cuts.append(best_cut(oof, y))
        dense = np.column_stack([dense, oof])
    return Chain(models, cuts)


def labelled_sample(docs: DataFrame, labels: DataFrame, size: int = SAMPLE):
    """Distinct word hashes, dense features, labels and folds (by the ids' hashes) of at most ``size`` labelled documents.
    Of rows with the same id that with the least text counts; of an id's labels the greatest ones."""
    columns = [c for _, c, _ in CATEGORIES]
    known = labels.where(" AND ".join(f"{c} IS NOT NULL" for c in ["doc_id", *columns])).groupBy("doc_id").agg(*[F.max(c).cast("int").alias(c) for c in columns])
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(size)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most ``size`` rows are broadcast
    rows = rows.groupBy("doc_id", *columns).agg(F.min("text").alias("text"))  # an id that several rows have counts once

    def features(batches):
        table = word_table()
        for batch in batches:
            for part in pieces(batch):
                w, dense = extract(*text_column(part), table)
                words = [np.unique(w.hash[w.first[i] : w.first[i + 1]]).tobytes() for i in range(part.num_rows)]
                yield pa.record_batch([part.column("doc_id"), pa.array(words, pa.binary()), pa.array([d.tobytes() for d in dense], pa.binary()), *[part.column(c) for c in columns]], names=["doc_id", "words", "dense", *columns])

    got = rows.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *columns).mapInArrow(features, "doc_id long, words binary, dense binary, " + ", ".join(f"{c} int" for c in columns)).toPandas()
    got = got.sort_values("doc_id").reset_index(drop=True)
    words = [np.frombuffer(b, np.uint64) for b in got["words"]]
    w_hash = np.concatenate([np.zeros(0, np.uint64), *words])
    w_doc = np.repeat(np.arange(len(words)), [len(x) for x in words]).astype(np.int64)
    dense = np.array([np.frombuffer(b) for b in got["dense"]]).reshape(len(got), N_DENSE)
    targets = [(got[c].to_numpy() == hit).astype(float) for _, c, hit in CATEGORIES]
    fold = (mix64(got["doc_id"].to_numpy().astype(np.int64).view(np.uint64)) % np.uint64(FOLDS)).astype(np.int64)
    return w_hash, w_doc, dense, targets, fold


def train(docs: DataFrame, labels: DataFrame, size: int = SAMPLE) -> Chain | None:
    w_hash, w_doc, dense, targets, fold = labelled_sample(docs, labels, size)
    if not len(dense):
        return None
    return fit_chain(w_hash, w_doc, dense, targets, fold)


def score(docs: DataFrame, chain: Chain | None) -> DataFrame:
    """doc_id and, per category of the chain, its probability ``p_<category>`` and verdict over the whole text.

    Null or empty text: no words. Without any labelled document (chain None) probabilities are null and verdicts false.
    Repeated rows are scored alike; an empty table gives an empty table; further columns are ignored."""
    names = [c for c, _, _ in CATEGORIES]
    schema = "doc_id long, " + ", ".join(f"p_{c} double, {c} boolean" for c in names)
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if chain is None:
        return ids.select("doc_id", *[x for c in names for x in (F.lit(None).cast("double").alias(f"p_{c}"), F.lit(False).alias(c))])

    def run(batches):
        table = word_table()
        for batch in batches:
            for part in pieces(batch):
                w, dense = extract(*text_column(part), table)
                p = chain.probabilities(w.hash, w.doc, dense)
                cols = {"doc_id": part.column("doc_id")}
                for k, c in enumerate(names):
                    cols |= {f"p_{c}": pa.array(p[:, k]), c: pa.array(p[:, k] >= chain.cuts[k])}
                yield pa.record_batch(cols)

    return ids.mapInArrow(run, schema)


def toxicity(docs: DataFrame, labels: DataFrame, size: int = SAMPLE) -> DataFrame:
    """score() by a chain fitted on at most ``size`` labelled rows: those with the least hashes of their ids, so that the
    sample does not depend on the order of rows. Labels with a null in doc_id, quality or toxic, or without a document,
    are not used. Texts of any length are scored whole."""
    return score(docs, train(docs, labels, size))
