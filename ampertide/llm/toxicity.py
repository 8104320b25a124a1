"""Toxicity by a classifier chain.

The chain predicts categories one after another; each is a logistic model over hashed word
features (the word and its first four and five letters, scaled by their log ratio between the
classes) and the log-odds that the chain gave the earlier categories. While training, those log-odds are out-of-fold predictions, so a
later model never learns from what an earlier one has memorised.

Labelled rows: at most `per_class` rows of each label combination, those with the smallest
hashes of their ids, so training is bounded (a parameter) and the same wherever it runs.
Rows are weighted back to the combination's share of all labels, so probabilities are those of
the whole corpus. Models of one category, one per fold and one over all folds, train side by
side as groups of one Spark job. Every document is then scored over its whole text.

Categories over the given labels: `low_quality` (quality 0), `toxic`, and `toxic_low_quality`
(both). A document is rejected if the chain's probability of `toxic` is over the threshold
with the best F1 measure on the out-of-fold predictions (one half if they hold one class only).

Defined results: null and empty texts have no features, get the models' base rates and are never
rejected; labels
with nulls do not train; repeated labels of a document count each, contradictory ones too; a
category without positive or negative labels gets its constant base rate; no labels at all
reject nothing; repeated rows get a row each; further columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ampertide.session import cut

from .common import packed_row, text_of, unpacked

DIM = 1 << 17
FOLDS = 3
PER_CLASS = 3000
MIN_DOCS = 3
PREFIXES = (4, 5)
L2 = 0.1
STEPS = 60
CACHE = 300_000
EDGES = ".,;:!?\"'()[]|*#"
CATEGORIES = ("low_quality", "toxic", "toxic_low_quality")


def _word_features(word: str) -> tuple[int, ...]:
    word = word.strip(EDGES)
    if not word:
        return ()
    names = [f"w {word}", *[f"p{n} {word[:n]}" for n in PREFIXES if len(word) >= n]]
    return tuple(xxhash.xxh32_intdigest(x.encode("utf-8", "surrogatepass"), 11) % DIM for x in names)


def features(text: str, cache: dict[str, tuple[int, ...]]) -> np.ndarray:
    """Sorted distinct feature numbers of a whole text."""
    if len(cache) > CACHE:
        cache.clear()
    out: list[int] = []
    for word in set(text.lower().split()):
        got = cache.get(word)
        if got is None:
            got = cache[word] = _word_features(word)
        out += got
    return np.unique(np.fromiter(out, np.int32, len(out)))


def _sigmoid(z):
    return 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))


def _logit(p):
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


@dataclass
class Linear:
    """Log-odds: bias + hashed weights over sqrt(number of features) + chain weights."""

    bias: float
    weights: np.ndarray
    chain: np.ndarray

    def raw(self, sums: np.ndarray, sizes: np.ndarray, earlier: np.ndarray) -> np.ndarray:
        return self.bias + sums / np.sqrt(np.maximum(sizes, 1)) + earlier @ self.chain


def fit_linear(idx: list[np.ndarray], earlier: np.ndarray, y: np.ndarray, weight: np.ndarray) -> Linear:
    """Weighted logistic regression by accelerated full-batch gradient steps with per-feature scaling."""
    k = earlier.shape[1]
    total = weight.sum()
    base = float((weight * y).sum() / total) if total else 0.0
    model = Linear(float(_logit(base)), np.zeros(DIM), np.zeros(k))
    if not 0 < base < 1:
        return model
    sizes = np.array([len(i) for i in idx])
    flat, row = np.concatenate(idx), np.repeat(np.arange(len(idx)), sizes)
    # A feature of one or two training documents only helps to memorise them.
    common = np.bincount(flat, minlength=DIM) >= MIN_DOCS
    row, flat = row[common[flat]], flat[common[flat]]
    used, flat = np.unique(flat, return_inverse=True)
    scale = 1 / np.sqrt(np.maximum(sizes, 1))
    # Both classes carry equal weight while fitting; the bias is put right below.
    w = weight * np.where(y == 1, 0.5 / base, 0.5 / (1 - base)) / total
    # A feature counts by its log ratio between the classes, so that what sets them apart is cheap
    # for the penalty and what occurs in both alike is dear.
    has, lacks = (np.bincount(flat, (y == c)[row], len(used)) for c in (1, 0))
    ratio = np.log((has + 1) / ((y == 1).sum() + 2)) - np.log((lacks + 1) / ((y == 0).sum() + 2))
    theta = np.zeros(len(used) + k + 1)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for t in range(1, STEPS + 1):
        z = theta[-1] + np.bincount(row, (theta[: len(used)] * ratio)[flat], len(idx)) * scale + earlier @ theta[len(used) : -1]
        r = w * (_sigmoid(z) - y)
        grad = np.concatenate([np.bincount(flat, (r * scale)[row], len(used)) * ratio, earlier.T @ r, [r.sum()]])
        grad[:-1] += L2 * theta[:-1] / len(idx)
        m = 0.9 * m + 0.1 * grad
        v = 0.99 * v + 0.01 * grad**2
        theta -= 0.3 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-7)
    model.weights[used], model.chain = theta[: len(used)] * ratio, theta[len(used) : -1]
    model.bias = float(theta[-1] + _logit(base))
    return model


def labelled_sample(docs: DataFrame, labels: DataFrame, categories: dict, per_class: int, id_col: str, text_col: str) -> DataFrame:
    """(key, fold, weight, y array<int>, idx array<int>) of at most per_class rows per combination."""
    y = F.array(*[c.cast("int") for c in categories.values()])
    rows = labels.select(F.col("doc_id").alias("label_id"), y.alias("y")).filter("label_id IS NOT NULL AND NOT exists(y, v -> v IS NULL)")
    counts = cut(rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")))
    picks = None
    for combo in counts.collect():  # at most 2 ** categories rows
        part = rows.filter(F.col("y") == F.array(*[F.lit(v) for v in combo["y"]]))
        part = part.orderBy(F.xxhash64("label_id"), "label_id").limit(per_class).withColumn("weight", F.lit(combo["n"] / min(per_class, combo["n"])))
        picks = part if picks is None else picks.unionByName(part)
    if picks is None:
        picks = rows.withColumn("weight", F.lit(1.0))
    # Bounded by per_class per combination, so every executor may hold it.
    text = docs.select(F.col(f"`{id_col}`").alias("label_id"), text_of(text_col).alias("text"))
    joined = text.join(F.broadcast(cut(picks)), "label_id").select("label_id", "y", "weight", "text")

    def run(batches):
        cache: dict = {}
        for batch in batches:
            idx = [features(t, cache) for t in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), batch.column(1), batch.column(2), pa.array([i.tolist() for i in idx], pa.list_(pa.int32()))],
                names=["label_id", "y", "weight", "idx"],
            )

    out = joined.mapInArrow(run, "label_id long, y array<int>, weight double, idx array<int>")
    return out.select(F.monotonically_increasing_id().alias("key"), F.pmod(F.xxhash64("label_id", F.lit(3)), F.lit(FOLDS)).cast("int").alias("fold"), "y", "weight", "idx")


def _trainer(k: int):
    """Fits category k for one model: a fold's predictions for its held-out rows, or the weights
    of the model over all folds."""

    def train(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("key", ignore_index=True)
        held = int(pdf["model"].iloc[0])
        idx = [np.asarray(i, dtype=np.int32) for i in pdf["idx"]]
        y = np.array([v[k] for v in pdf["y"]], dtype=float)
        earlier = _logit(np.array([list(p) for p in pdf["oof"]], dtype=float).reshape(len(pdf), k))
        weight, fold = pdf["weight"].to_numpy(), pdf["fold"].to_numpy()
        fit = np.flatnonzero(fold != held)
        model = fit_linear([idx[i] for i in fit], earlier[fit], y[fit], weight[fit])
        if held == FOLDS:
            packed = np.concatenate([[model.bias], model.chain, model.weights]).astype("<f8").tobytes()
            return pd.DataFrame({"key": pd.array([None], "Int64"), "p": [None], "packed": [packed]})
        out = np.flatnonzero(fold == held)
        sums = np.array([model.weights[idx[i]].sum() for i in out])
        p = _sigmoid(model.raw(sums, np.array([len(idx[i]) for i in out]), earlier[out]))
        return pd.DataFrame({"key": pdf["key"].to_numpy()[out], "p": p, "packed": None})

    return train


def train_chain(docs: DataFrame, labels: DataFrame, categories: dict, per_class: int = PER_CLASS, id_col: str = "doc_id", text_col: str = "text"):
    """Models of the chain in order, and the sample's out-of-fold probabilities
    (key, y, weight, oof array<double>)."""
    sample = cut(labelled_sample(docs, labels, categories, per_class, id_col, text_col).withColumn("oof", F.array().cast("array<double>")))
    models: list[Linear] = []
    for k in range(len(categories)):
        copies = sample.withColumn("model", F.explode(F.array(*[F.lit(f) for f in range(FOLDS + 1)])))
        got = cut(copies.repartition(FOLDS + 1, "model").groupBy("model").applyInPandas(_trainer(k), "key long, p double, packed binary"))
        packed = got.filter("packed IS NOT NULL").select("packed").collect()  # one row of fixed size
        if packed:
            v = np.frombuffer(packed[0][0], "<f8")
            models.append(Linear(float(v[0]), v[1 + k :].astype(np.float32), v[1 : 1 + k]))
        else:
            models.append(Linear(float(_logit(0.0)), np.zeros(DIM, np.float32), np.zeros(k)))
        probs = got.filter("packed IS NULL").select("key", "p")
        sample = cut(sample.join(probs, "key").withColumn("oof", F.concat("oof", F.array("p"))).drop("p"))
    return models, sample.select("key", "y", "weight", "oof")


def chain_probabilities(idx: list[np.ndarray], models: list[Linear]) -> np.ndarray:
    sizes = np.array([len(i) for i in idx])
    probs = np.zeros((len(idx), 0))
    for model in models:
        sums = np.array([model.weights[i].sum(dtype=np.float64) for i in idx])
        probs = np.column_stack([probs, _sigmoid(model.raw(sums, sizes, _logit(probs)))])
    return probs


def score_chain(rows: DataFrame, models: list[Linear], names: list[str], text_field: str | None = None) -> DataFrame:
    """Adds a probability per category to (row, text); with text_field the text is that field of
    the struct `row`, so that it travels once."""
    shared = rows.sparkSession.sparkContext.broadcast(models)  # fixed size: DIM weights a category

    def run(batches):
        chain, cache = shared.value, {}
        for batch in batches:
            texts = batch.column(1) if text_field is None else batch.column(0).field(text_field).cast(pa.string())
            probs = chain_probabilities([features(t or "", cache) for t in texts.to_pylist()], chain)
            cols = [pa.array(probs[:, k]) for k in range(len(chain))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], names=["row", *[f"p{k}" for k in range(len(chain))]])

    out = T.StructType([rows.schema["row"], *[T.StructField(f"p{k}", T.DoubleType()) for k in range(len(models))]])
    return rows.mapInArrow(run, out).withColumnsRenamed({f"p{k}": n for k, n in enumerate(names)})


def best_threshold(p: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    """The probability above which calling positive gives the best weighted F1; midway between
    the two predictions it separates."""
    if not 0 < (weight * y).sum() < weight.sum():
        return 0.5
    order = np.argsort(-p, kind="stable")
    p, y, weight = p[order], y[order], weight[order]
    hit, called = np.cumsum(weight * y), np.cumsum(weight)
    f1 = np.where(np.append(p[1:] < p[:-1], True), 2 * hit / (called + (weight * y).sum()), 0.0)
    k = int(f1.argmax())
    return float((p[k] + p[k + 1]) / 2) if k + 1 < len(p) else -1.0


def decision_threshold(sample: DataFrame, category: int) -> float:
    """From the out-of-fold predictions of the sample, whose size is bounded."""
    rows = sample.select(F.col("oof")[category].alias("p"), F.col("y")[category].alias("y"), "weight").toPandas()
    return best_threshold(rows["p"].to_numpy(float), rows["y"].to_numpy(float), rows["weight"].to_numpy(float))


def label_categories() -> dict:
    low, toxic = F.col("quality") == 0, F.col("toxic") == 1
    return dict(zip(CATEGORIES, [low, toxic, low & toxic]))


def _rejecting(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, per_class: int) -> tuple[list[Linear], float]:
    models, sample = train_chain(docs, labels, label_categories(), per_class, id_col, text_col)
    at = CATEGORIES.index("toxic")
    # A text must say more than a text without words does.
    return models, max(decision_threshold(sample, at), chain_probabilities([np.empty(0, np.int32)], models)[0, at])


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", per_class: int = PER_CLASS) -> DataFrame:
    """One row per document: identifier, a probability per category, toxic (rejected or not)."""
    models, threshold = _rejecting(docs, labels, id_col, text_col, per_class)
    rows = docs.select(F.struct(F.col(f"`{id_col}`").alias("id")).alias("row"), text_of(text_col).alias("text"))
    scored = score_chain(rows, models, [f"p_{c}" for c in CATEGORIES])
    return scored.select(F.col("row.id").alias(id_col), *[f"p_{c}" for c in CATEGORIES], (F.col("p_toxic") > threshold).alias("toxic"))


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", per_class: int = PER_CLASS) -> DataFrame:
    """The table without the documents that the chain rejects."""
    models, threshold = _rejecting(docs, labels, id_col, text_col, per_class)
    scored = score_chain(docs.select(packed_row(docs).alias("row")), models, [f"p_{c}" for c in CATEGORIES], text_col)
    return unpacked(scored.filter(F.col("p_toxic") <= threshold), docs.schema)
