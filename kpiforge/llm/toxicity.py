"""Toxicity by a classifier chain, trained on a bounded sample of the labelled documents.

Categories are predicted one after the other: ``severe`` (toxic, dense in marker words), ``mild``
(toxic, sparse in them), then ``toxic``, the label itself and the verdict. Each link is a logistic
regression on the words and word beginnings of the whole text and on the earlier links'
probabilities. In training these are out-of-fold predictions, so that a later link sees
probabilities as they are for unseen texts.

Fit: ``max_train`` labelled documents (smallest id hashes) bound the sample. Features are counted
in Spark; the ``n_features`` with the highest chi-squared against the label, and which of them
each sampled document has, are all that comes to the driver.

The verdict's threshold comes from the out-of-fold predictions of the last link: the one with the
highest F1, in the middle of the gap between the scores around it. It always lies above the score of
a text without any selected feature: where there is no evidence, a text is clean.

Defined cases: null and empty texts, and texts of unknown words only, have no features and are clean;
texts of any length count whole; repeated labels of an id count as toxic if one says so; without
labels of both kinds nothing is toxic; repeated documents are all judged. Only the id and text columns
are read, under names of this module's own, so other columns may have any name.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kpiforge.llm.common import per_batch, release, ship_package, staged, words

CHAIN = ("severe", "mild", "toxic")
MAX_TRAIN = 10_000
N_FEATURES = 4_096
LEAST_DOCUMENTS = 3
BEGINNINGS = tuple(range(3, 9))
MARKER_SHARE = 0.9
FOLDS = 3


def features_of(word: str) -> list[str]:
    """The word, and its first letters if it is longer than they are."""
    return [word, *(f"{word[:n]}~" for n in BEGINNINGS if len(word) > n)]


class Places(dict):
    """Word -> places of its selected features; forgotten as a whole past ``MOST`` words."""

    MOST = 150_000

    def __init__(self, selected: dict[str, int]):
        self.selected = selected

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) > self.MOST:
            self.clear()
        self[word] = found = tuple(self.selected[f] for f in features_of(word) if f in self.selected)
        return found

    def of(self, text: str | None) -> list[int]:
        out: set[int] = set()
        for w in set(words(text)):
            if found := self[w]:
                out.update(found)
        return sorted(out)


# ---------------------------------------------------------------- one logistic regression

def logistic_fit(rows: np.ndarray, cols: np.ndarray, dense: np.ndarray, y: np.ndarray, n_features: int,
                 l2: float = 1e-4, steps: int = 600) -> np.ndarray:
    """Weights (sparse binary features, dense columns, intercept) by accelerated gradient descent, each at its own step."""
    n, d = len(y), n_features + dense.shape[1] + 1
    weight = np.where(y == 1, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1))  # both kinds count alike
    per_row = np.bincount(rows, minlength=n) + np.abs(dense).sum(axis=1) + 1
    bound = np.concatenate([np.bincount(cols, weights=(weight * per_row)[rows], minlength=n_features),  # of each weight's curvature
                            np.abs(dense).T @ (weight * per_row), [(weight * per_row).sum()]])
    step = 1 / (0.25 * bound + l2)
    w, v = np.zeros(d), np.zeros(d)
    for t in range(steps):
        z = np.bincount(rows, weights=v[cols], minlength=n) + dense @ v[n_features:-1] + v[-1]
        g = weight * (1 / (1 + np.exp(-np.clip(z, -35, 35))) - y)
        grad = np.concatenate([np.bincount(cols, weights=g[rows], minlength=n_features), dense.T @ g, [g.sum()]]) + l2 * v
        grad[-1] -= l2 * v[-1]
        new = v - step * grad
        v = new + t / (t + 3) * (new - w)
        w = new
    return w


def logistic_apply(w: np.ndarray, rows: np.ndarray, cols: np.ndarray, dense: np.ndarray, n: int, n_features: int) -> np.ndarray:
    z = np.bincount(rows, weights=w[cols], minlength=n) + dense @ w[n_features:-1] + w[-1]
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


# ---------------------------------------------------------------- the chain

@dataclass
class ChainModel:
    """Selected features, one weight vector per link, and the least p_toxic of a toxic text."""

    selected: dict[str, int] = field(default_factory=dict)
    weights: list[np.ndarray] = field(default_factory=list)
    threshold: float = float("inf")

    def probabilities(self, texts, places: Places) -> np.ndarray:
        """One row per text, one column per link of the chain."""
        own = [places.of(t) for t in texts]
        n = len(own)
        rows = np.repeat(np.arange(n), [len(x) for x in own])
        cols = np.fromiter((c for x in own for c in x), dtype=np.int64, count=len(rows))
        out = np.zeros((n, len(CHAIN)))
        for k, w in enumerate(self.weights):
            out[:, k] = logistic_apply(w, rows, cols, out[:, :k], n, len(self.selected))
        return out


def categories(toxic: np.ndarray, density: np.ndarray) -> np.ndarray:
    """Labels of the chain's links; severe: a toxic document's marker density is the toxic median or more."""
    middle = np.median(density[toxic == 1]) if toxic.any() else 0.0
    severe = (toxic == 1) & (density >= middle)
    return np.stack([severe, (toxic == 1) & ~severe, toxic == 1], axis=1).astype(np.float64)


def fit_links(rows, cols, y: np.ndarray, fold: np.ndarray, n_features: int) -> list[np.ndarray]:
    """Weights of every link; each link's inputs from earlier links are out-of-fold predictions."""
    return links_and_held(rows, cols, y, fold, n_features)[0]


def links_and_held(rows, cols, y: np.ndarray, fold: np.ndarray, n_features: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Weights of every link, and every link's out-of-fold predictions."""
    n, earlier, weights = len(y), np.zeros((len(y), 0)), []
    for k in range(y.shape[1]):
        weights.append(logistic_fit(rows, cols, earlier, y[:, k], n_features))
        held = np.zeros(n)
        for f in np.unique(fold):
            out = fold == f
            keep = ~out[rows]
            renumber = np.cumsum(~out) - 1
            w = logistic_fit(renumber[rows[keep]], cols[keep], earlier[~out], y[~out, k], n_features)
            held[out] = logistic_apply(w, rows, cols, earlier, n, n_features)[out]
        earlier = np.c_[earlier, held]
    return weights, earlier


def best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    """The cut of highest F1, in the middle (of log-odds) of the gap around it; of equal cuts that with the widest gap."""
    odds = np.log(np.clip(p, 1e-12, 1 - 1e-12) / np.clip(1 - p, 1e-12, 1))
    order = np.argsort(-odds, kind="stable")
    odds, found = odds[order], np.cumsum(y[order])
    f1 = 2 * found / (np.arange(1, len(y) + 1) + y.sum())
    below = np.r_[odds[1:], odds[-1] - 2]
    cuts = np.flatnonzero(odds > below)   # a cut lies between unequal scores
    best = max(cuts, key=lambda c: (round(f1[c], 12), odds[c] - below[c]))
    return float(1 / (1 + np.exp(-(odds[best] + below[best]) / 2)))


def fit_chain(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, n_features: int = N_FEATURES,
              id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> ChainModel:
    """Train on at most ``max_train`` labelled documents."""
    known = labels.select(F.col(f"`{id_col}`").alias("l_id"), F.col(f"`{label_col}`").cast("int").alias("toxic")).where(
        "l_id IS NOT NULL AND toxic IS NOT NULL").groupBy("l_id").agg(F.max("toxic").alias("toxic"))
    known = staged(known.orderBy(F.xxhash64("l_id"), "l_id").limit(max_train), "tox-labels")

    def run(batches):
        for batch in batches:
            feats = [sorted({f for w in set(words(t.as_py())) for f in features_of(w)}) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(feats, pa.list_(pa.string()))],
                                             ["id", "toxic", "feats"])

    texts = docs.select(F.col(f"`{id_col}`").alias("l_id"), F.col(f"`{text_col}`").alias("text"))
    sample = texts.join(F.broadcast(known), "l_id").select(  # at most max_train rows
        F.col("l_id").alias("id"), "toxic", "text").dropDuplicates(["id"])
    sample = staged(per_batch(sample, run, "id long, toxic int, feats array<string>"), "tox-sample")
    total = sample.agg(F.count("*"), F.sum("toxic")).first()
    n, pos = total[0] or 0, total[1] or 0
    if not 0 < pos < n:
        return ChainModel()
    counts = (sample.select("toxic", F.explode("feats").alias("f")).groupBy("f")
              .agg(F.count("*").alias("n"), F.sum("toxic").alias("p")).where(F.col("n") >= LEAST_DOCUMENTS))
    gap = F.col("p") - F.col("n") * (pos / n)
    chi = gap * gap / (F.col("n") * (pos / n)) + gap * gap / (F.col("n") * (1 - pos / n))
    best = counts.orderBy(F.desc(chi), "f").limit(n_features).toPandas()
    selected = {f: i for i, f in enumerate(best["f"])}
    marker = (best["p"] >= MARKER_SHARE * best["n"]).to_numpy()

    chosen = F.array(*(F.lit(f) for f in best["f"]))
    hits = sample.select("id", "toxic", F.size("feats").alias("size"), F.array_intersect("feats", chosen).alias("hits"))
    data = hits.toPandas().sort_values("id", ignore_index=True)
    cols = [[selected[f] for f in h] for h in data["hits"]]
    rows = np.repeat(np.arange(len(data)), [len(c) for c in cols])
    cols = np.fromiter((c for x in cols for c in x), dtype=np.int64, count=len(rows))
    toxic = data["toxic"].to_numpy(dtype=np.int64)
    density = np.bincount(rows, weights=marker[cols], minlength=len(data)) / np.maximum(data["size"].to_numpy(), 1)
    fold = pd.util.hash_array(data["id"].to_numpy()) % FOLDS
    weights, held = links_and_held(rows, cols, categories(toxic, density), fold, len(selected))
    model = ChainModel(selected, weights)
    nothing = model.probabilities([""], Places(selected))[0, -1]
    model.threshold = max(best_threshold(held[:, -1], toxic), float(np.nextafter(nothing, 1)))
    return model


def chain_scores(docs: DataFrame, model: ChainModel, text_col: str = "text") -> Column:
    """Column of the chain's probabilities (array, one per link) for ``docs``'s texts."""
    ship_package(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # n_features words and weights
    places = Places(model.selected)

    @F.pandas_udf("array<double>")
    def scores(texts: pd.Series) -> pd.Series:
        release()
        return pd.Series(list(shared.value.probabilities(texts, places)))

    return scores(F.col(f"`{text_col}`"))


def toxic_documents(docs: DataFrame, model: ChainModel, threshold: float | None = None, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """doc_id and probabilities (p_severe, p_mild, p_toxic) of the documents judged toxic (at the model's threshold, if none is given)."""
    threshold = model.threshold if threshold is None else threshold
    scored = docs.select(F.col(f"`{id_col}`").alias("doc_id"), chain_scores(docs, model, text_col).alias("p"))
    return scored.where(F.col("p")[len(CHAIN) - 1] >= threshold).select(
        "doc_id", *(F.col("p")[k].alias(f"p_{c}") for k, c in enumerate(CHAIN)))


def clean_documents(docs: DataFrame, model: ChainModel, threshold: float | None = None, text_col: str = "text") -> DataFrame:
    """``docs`` without those judged toxic, all columns kept."""
    threshold = model.threshold if threshold is None else threshold
    return docs.where(chain_scores(docs, model, text_col)[len(CHAIN) - 1] < threshold)
