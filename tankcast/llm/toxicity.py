"""Toxicity (operator 5): a classifier chain of linear models.

Categories are predicted one after another.  The model of a category sees the
text's features and the probabilities of all earlier categories; in training
those probabilities are out-of-fold, so a later model learns from predictions
as noisy as the ones it will meet.

Features are hashed words and word beginnings, counted once a document.
Training takes a bounded sample: the ``max_train`` labelled documents with the
smallest hash of their id (documented parameter).  Only their feature numbers
reach the driver, where each logistic model is fitted over the ``max_features``
features that differ most between the classes.  Scoring covers every document,
without a shuffle; the models are a few thousand numbers.

Defined cases: null, empty and unlabelled texts are scored like any other (no
words: the intercept).  Repeated labels of an id: the largest value of each
category holds.  A null label leaves the row out of training.  No labelled rows
at all give probability 0 for every category.  Same-named columns are replaced.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tankcast.llm.common import add_columns, without, words

MAX_TRAIN = 5000
MAX_FEATURES = 2048
MIN_Z = 3.0
FOLDS = 5
BITS = 22
PREFIXES = (4, 5, 6)


def word_features(w: bytes) -> list[int]:
    mask = (1 << BITS) - 1
    return [zlib.crc32(w) & mask] + [zlib.crc32(w[:n], n) & mask for n in PREFIXES if len(w) > n]


def features(text: str | None) -> list[int]:
    """Sorted feature numbers of a text."""
    return sorted({f for w in set(words(text)) for f in word_features(w)})


class Linear:
    """Logistic model over a few chosen features and the earlier probabilities."""

    def __init__(self, ids: np.ndarray, weights: np.ndarray, chain: np.ndarray, bias: float):
        self.weight = dict(zip(ids.tolist(), weights.tolist()))
        self.chain, self.bias = chain.tolist(), bias

    def score(self, found: list[int], earlier: list[float]) -> float:
        get = self.weight.get
        z = self.bias + sum(get(f, 0.0) for f in found) + sum(c * p for c, p in zip(self.chain, earlier))
        return 1.0 / (1.0 + np.exp(-min(50.0, max(-50.0, z))))

    def scores(self, counts: "Counts", earlier: np.ndarray) -> np.ndarray:
        """Of all rows of the sample."""
        weights = np.array([self.weight.get(f, 0.0) for f in counts.ids.tolist()])
        z = np.bincount(counts.row, weights=weights[counts.col], minlength=counts.n)
        return 1 / (1 + np.exp(-np.clip(z + earlier @ np.array(self.chain) + self.bias, -50, 50)))


class Counts:
    """Feature occurrences of the sample as (row, column) pairs."""

    def __init__(self, docs: list[np.ndarray]):
        self.n = len(docs)
        sizes = np.array([len(d) for d in docs], np.int64)
        flat = np.concatenate(docs) if sizes.sum() else np.zeros(0, np.int64)
        row = np.repeat(np.arange(self.n), sizes)
        ids, col, seen = np.unique(flat, return_inverse=True, return_counts=True)
        often = seen > 2  # rarer ones can't pass the test below
        self.ids, keep = ids[often], often[col]
        self.row, self.col = row[keep], (np.cumsum(often) - 1)[col[keep]]


def fit(counts: Counts, use: np.ndarray, earlier: np.ndarray, y: np.ndarray,
        max_features: int = MAX_FEATURES, steps: int = 200, l2: float = 1e-3) -> Linear:
    """Logistic model over the rows marked in ``use``, by Adam on the mean loss.

    Features are those whose share of positives lies ``MIN_Z`` standard errors
    or more from the share expected, the strongest first."""
    new = np.cumsum(use) - 1
    keep = use[counts.row]
    row, col = new[counts.row[keep]], counts.col[keep]
    y, earlier = y[use], earlier[use]
    n, pos = max(len(y), 1), float(y.sum())
    with_pos = np.bincount(col, weights=y[row], minlength=len(counts.ids))
    with_all = np.bincount(col, minlength=len(counts.ids)).astype(float)
    want = with_all * (pos / n)
    gain = np.abs(with_pos - want) / (np.sqrt(want * (1 - pos / n)) + 0.5)
    order = np.lexsort((counts.ids, -gain))[:max_features]
    order = order[gain[order] >= MIN_Z]
    place = np.full(len(counts.ids), -1, np.int64)
    place[order] = np.arange(len(order))
    keep = place[col] >= 0
    row, col = row[keep], place[col[keep]]
    m, k = len(order), earlier.shape[1]
    prior = min(max(pos / n, 1e-4), 1 - 1e-4)
    theta = np.zeros(m + k + 1)
    theta[-1] = np.log(prior / (1 - prior))
    momentum, scale = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        z = np.bincount(row, weights=theta[col], minlength=len(y)) + earlier @ theta[m:m + k] + theta[-1]
        miss = (1 / (1 + np.exp(-np.clip(z, -50, 50))) - y) / n
        grad = np.concatenate([np.bincount(col, weights=miss[row], minlength=m), earlier.T @ miss, [miss.sum()]])
        grad[:-1] += l2 * theta[:-1] / n
        momentum = 0.9 * momentum + 0.1 * grad
        scale = 0.99 * scale + 0.01 * grad * grad
        theta -= 0.1 * (momentum / (1 - 0.9 ** step)) / (np.sqrt(scale / (1 - 0.99 ** step)) + 1e-9)
    return Linear(counts.ids[order], theta[:m], theta[m:m + k], float(theta[-1]))


class Chain:
    """Fitted models in order, with a decision threshold for each category."""

    def __init__(self, names: list[str], models: list[Linear], thresholds: list[float]):
        self.names, self.models, self.thresholds = names, models, thresholds
        self.chosen = {f for m in models for f in m.weight}
        self.known: dict[bytes, list[int]] = {}

    def found(self, text: str | None) -> list[int]:
        """Numbers of the text's features that some model uses."""
        known, out = self.known, set()
        if len(known) > 200_000:
            known.clear()
        for w in set(words(text)):
            f = known.get(w)
            if f is None:
                f = known[w] = [x for x in word_features(w) if x in self.chosen]
            if f:
                out.update(f)
        return sorted(out)

    def probabilities(self, found: list[int]) -> list[float]:
        out: list[float] = []
        for m in self.models:
            out.append(float(m.score(found, out)))
        return out or [0.0] * len(self.names)


def best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    """Between the two probabilities where F1 is best, among cuts that are right
    more often than wrong (0.5 if there are none)."""
    if not y.sum():
        return 0.5
    order = np.argsort(-p, kind="stable")
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + y.sum())
    f1[:-1][p[order][:-1] == p[order][1:]] = -1  # no cut between equal scores
    f1[2 * hits < np.arange(1, len(y) + 1)] = -1
    k = int(f1.argmax())
    if f1[k] < 0:
        return 0.5
    low = p[order][k + 1] if k + 1 < len(y) else 0.0
    return float((p[order][k] + low) / 2)


def fit_chain(docs: list[np.ndarray], labels: np.ndarray, fold: np.ndarray, names: list[str],
              max_features: int = MAX_FEATURES) -> Chain:
    """labels: one column a category.  Later models see out-of-fold probabilities."""
    n = len(docs)
    if not n:
        return Chain(names, [], [0.5] * len(names))
    counts = Counts(docs)
    earlier, models, thresholds = np.zeros((n, 0)), [], []
    for c in range(len(names)):
        y = labels[:, c].astype(float)
        out = np.zeros(n)
        for k in np.unique(fold):
            inside, outside = fold != k, np.flatnonzero(fold == k)
            m = fit(counts, inside if inside.any() else ~inside, earlier, y, max_features)
            out[outside] = m.scores(counts, earlier)[outside]
        models.append(fit(counts, np.ones(n, bool), earlier, y, max_features))
        thresholds.append(best_threshold(out, y))
        earlier = np.hstack([earlier, out[:, None]])
    return Chain(names, models, thresholds)


def train(docs: DataFrame, labels: DataFrame, categories: dict[str, Column], id_col: str = "doc_id",
          text_col: str = "text", max_train: int = MAX_TRAIN, folds: int = FOLDS) -> Chain:
    """``categories``: name -> 0/1 column over ``labels``, in chain order."""
    names = list(categories)
    marks = labels.select(F.col(f"`{id_col}`").alias("id"),
                          *[c.cast("int").alias(f"y{k}") for k, c in enumerate(categories.values())])
    marks = marks.dropna().groupBy("id").agg(*[F.max(f"y{k}").alias(f"y{k}") for k in range(len(names))])
    # ids first: only the chosen documents' texts are read further
    chosen = (marks.join(docs.select(F.col(f"`{id_col}`").alias("id")).distinct(), "id", "left_semi")
              .orderBy(F.xxhash64("id"), "id").limit(max_train))
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("t"))
    # one row per id, by its text's hash: a repeated id neither fills the driver nor outweighs others
    one = (texts.join(F.broadcast(chosen), "id").groupBy("id", *[f"y{k}" for k in range(len(names))])
           .agg(F.min_by("t", F.struct(F.xxhash64("t"), "t")).alias("t")))
    sample = add_columns(one, ["t"],
                         [T.StructField("found", T.ArrayType(T.IntegerType()))],
                         lambda t: [[features(x) for x in t]])
    got = (sample.select("id", "found", *[f"y{k}" for k in range(len(names))])
           .withColumn("fold", F.pmod(F.xxhash64(F.lit("fold"), "id"), F.lit(folds)))
           .toArrow())
    order = np.argsort(got["id"].to_numpy(), kind="stable")
    found = got["found"].combine_chunks()
    at = found.offsets.to_numpy() if len(found) else np.zeros(1, np.int64)
    flat = found.values.to_numpy() if len(found) else np.zeros(0, np.int32)
    docs_found = [flat[at[i]:at[i + 1]] for i in order]
    y = np.stack([got[f"y{k}"].to_numpy() for k in range(len(names))], axis=1)[order]
    return fit_chain(docs_found, y, got["fold"].to_numpy()[order], names)


def score(docs: DataFrame, chain: Chain, text_col: str = "text") -> DataFrame:
    """``docs`` with ``p_<category>`` and ``is_<category>`` for each category."""
    held = docs.sparkSession.sparkContext.broadcast(chain)
    names = chain.names

    def run(texts):
        c = held.value
        p = [c.probabilities(c.found(t)) for t in texts]
        return [[row[k] for row in p] for k in range(len(names))]

    docs = without(docs, [f"is_{n}" for n in names])
    out = add_columns(docs, [text_col], [T.StructField(f"p_{n}", T.DoubleType()) for n in names], run)
    return out.withColumns({f"is_{n}": F.col(f"p_{n}") >= t for n, t in zip(names, chain.thresholds)})


#: Chain order over the ``labels`` table.
def table_categories() -> dict[str, Column]:
    return {"low_quality": 1 - F.col("quality"), "toxic": F.col("toxic")}


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents that the chain doesn't call toxic; columns as they were."""
    chain = train(docs, labels, table_categories())
    return score(docs, chain).filter(~F.col("is_toxic")).select([F.col(f"`{c}`") for c in docs.columns])


def op5_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    chain = train(docs, labels, table_categories())
    return score(docs.select("doc_id", "text"), chain).drop("text")
