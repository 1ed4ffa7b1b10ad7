"""Toxicity scores by non-negative positive-unlabelled learning.

Confirmed toxic documents (positives) and documents taken without their labels train a
logistic classifier on the presence of words and word parts. Unlabelled text holds toxic
documents too, so their share of the risk is taken out with the class prior:

    risk = prior * mean_P loss(z) + max(0, mean_U loss(-z) - prior * mean_P loss(-z))

and where the second part falls below zero, a step back replaces the descent.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelore.llm.files import whole_texts
from sitelore.llm.runs import small_batches
from sitelore.session import materialize

WORD = re.compile(r"[^\W\d_]+")
PARTS = (4, 5, 6)  # lengths of word beginnings
CACHE_WORDS = 100_000


@dataclass(frozen=True)
class Fit:
    """Bounds of the training sample and settings of the training."""

    positives: int = 8000
    unlabelled: int = 16000
    features: int = 4096
    least_documents: int = 5
    least_share: float = 0.002  # of the positives that must hold a feature
    least_lift: float = 3.0
    least_deviations: float = 5.0  # of a feature's positives above what unlabelled text makes likely
    steps: int = 600
    rate: float = 0.05
    decay: float = 3e-5
    step_back: float = 1.0
    seed: int = 3


@dataclass
class Model:
    """Weights of features; `bias` alone is the score of a text without any."""

    weights: dict[str, float]
    bias: float


def features_of(word: str) -> list[str]:
    """A lower-case word, its beginnings and its last letters."""
    longer = [k for k in PARTS if len(word) > k]
    return [word, *(word[:k] + "*" for k in longer), *("*" + word[-k:] for k in longer)]


def words_of(text: str | None) -> set[str]:
    return set(WORD.findall((text or "").lower()))


def held_out(doc_id: Column) -> Column:
    """Documents whose labels are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def nn_pu(
    rows: np.ndarray, cols: np.ndarray, positive: np.ndarray, width: int, prior: float, fit: Fit
) -> tuple[np.ndarray, float]:
    """Weights and bias for a sparse presence matrix given as (row, column) pairs."""
    n = len(positive)
    n_pos, n_unl = max(1, positive.sum()), max(1, (~positive).sum())
    theta = np.zeros(width + 1)
    theta[-1] = np.log(prior / (1 - prior))
    first, second = np.zeros_like(theta), np.zeros_like(theta)

    def gradient(per_row):
        flat = np.bincount(cols, weights=per_row[rows], minlength=width) if width else np.empty(0)
        return np.append(flat, per_row.sum())

    for step in range(1, fit.steps + 1):
        z = np.bincount(rows, weights=theta[cols], minlength=n) + theta[-1]
        p = 1 / (1 + np.exp(-np.clip(z, -50, 50)))
        as_negative = np.logaddexp(0, z)  # loss(-z); its slope is p
        rest = as_negative[~positive].sum() / n_unl - prior * as_negative[positive].sum() / n_pos
        slope_rest = np.where(positive, -prior * p / n_pos, p / n_unl)
        if rest < 0:
            g = -fit.step_back * gradient(slope_rest)
        else:
            g = gradient(slope_rest + np.where(positive, prior * (p - 1) / n_pos, 0))
        g[:-1] += fit.decay * theta[:-1]
        first = 0.9 * first + 0.1 * g
        second = 0.999 * second + 0.001 * g * g
        rate = fit.rate * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
        theta = theta - rate * first / (np.sqrt(second) + 1e-8)
    return theta[:-1], float(theta[-1])


def train(docs: DataFrame, labels: DataFrame, fit: Fit = Fit()) -> Model:
    """Model from documents (`doc_id`, `text`) and labels (`doc_id`, `toxic`).

    Only rows outside the held-out third are used. A document is positive if any of its
    labels is 1. Positives and unlabelled documents are seeded samples of at most
    `fit.positives` and `fit.unlabelled` rows (equal texts once), drawn by doc_id and text. The prior is the share of
    toxic documents among the labelled ones. Without a positive document every score is 0.
    """
    open_labels = (
        labels.where(~held_out(F.col("doc_id")) & F.col("toxic").isNotNull())
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    )
    n, n_toxic = open_labels.agg(F.count(F.lit(1)), F.sum("toxic")).first()
    if not n_toxic:
        return Model({}, -50.0)
    prior = min(0.9, n_toxic / n)
    draw = F.xxhash64("doc_id", "text_hash", F.lit(fit.seed))
    texts = whole_texts(docs).where(~held_out(F.col("doc_id"))).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
        F.xxhash64(F.col("text").cast("string")).alias("text_hash"),
    )
    ids = texts.select("doc_id", "text_hash").where("doc_id is not null").distinct()
    positives = ids.join(open_labels.where("toxic = 1"), "doc_id", "left_semi")
    positives = positives.orderBy(draw).limit(fit.positives).withColumn("positive", F.lit(True))
    unlabelled = ids.orderBy(draw).limit(fit.unlabelled).withColumn("positive", F.lit(False))
    drawn = positives.unionByName(unlabelled)  # at most `fit.positives + fit.unlabelled` keys
    sample = texts.join(F.broadcast(drawn), ["doc_id", "text_hash"]).dropDuplicates(["positive", "text"])

    def extract(batches):
        for batch in small_batches(batches, 128):
            found = [
                sorted({f for w in words_of(t) for f in features_of(w)}) for t in batch.column(1).to_pylist()
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(found, pa.list_(pa.string()))],
                ["doc_id", "positive", "features"],
            )

    held = materialize(
        sample.select("doc_id", "text", "positive").mapInArrow(
            extract, "doc_id long, positive boolean, features array<string>"
        ),
        "toxic-sample",
    )
    n_pos, n_unl = held.agg(F.sum(F.col("positive").cast("int")), F.sum((~F.col("positive")).cast("int"))).first()
    if not n_pos:
        return Model({}, -50.0)
    rows = held.select("doc_id", "positive", F.explode("features").alias("feature"))
    least = max(min(fit.least_documents, n_pos), int(fit.least_share * n_pos))
    share_pos = (F.col("pos") + 0.5) / (n_pos + 1)
    share_unl = (F.col("unl") + 0.5) / (n_unl + 1)
    lift = share_pos / share_unl
    deviations = (F.col("pos") - n_pos * share_unl) / F.sqrt(n_pos * share_unl)
    counts = rows.groupBy("feature").agg(
        F.sum(F.col("positive").cast("int")).alias("pos"), F.sum((~F.col("positive")).cast("int")).alias("unl")
    )
    chosen = (
        counts.where((F.col("pos") >= least) & (lift >= fit.least_lift) & (deviations >= fit.least_deviations))
        .orderBy((share_pos * F.log(lift)).desc(), "feature").limit(fit.features)
        .select("feature").toArrow()["feature"].to_pylist()
    )
    index = {f: i for i, f in enumerate(chosen)}

    def numbers(batches):
        for batch in batches:
            found = [[index[f] for f in row if f in index] for row in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(found, pa.list_(pa.int32()))], ["positive", "columns"]
            )

    # at most `fit.positives + fit.unlabelled` rows of at most `fit.features` small numbers
    matrix = held.select("positive", "features").mapInArrow(numbers, "positive boolean, columns array<int>").toArrow()
    columns = matrix["columns"].combine_chunks()
    sizes = np.diff(columns.offsets.to_numpy())
    weights, bias = nn_pu(
        np.repeat(np.arange(len(columns)), sizes), columns.flatten().to_numpy(),
        matrix["positive"].to_numpy().astype(bool), len(chosen), prior, fit,
    )
    return Model(dict(zip(chosen, weights.tolist())), bias)


class Scorer:
    """Scores whole texts; the features of a word are looked up once per worker."""

    def __init__(self, model: Model):
        self.names = list(model.weights)
        self.index = {f: i for i, f in enumerate(self.names)}
        self.weights = np.array([model.weights[f] for f in self.names])
        self.bias = model.bias
        self.known: dict[str, tuple[int, ...]] = {}

    def _of(self, word: str) -> tuple[int, ...]:
        found = tuple(self.index[f] for f in features_of(word) if f in self.index)
        if len(self.known) < CACHE_WORDS:
            self.known[word] = found
        return found

    def score(self, text: str | None) -> float:
        present: set[int] = set()
        known = self.known
        for word in words_of(text):
            found = known.get(word)
            if found is None:
                found = self._of(word)
            if found:
                present.update(found)
        z = self.bias + float(self.weights[sorted(present)].sum()) if present else self.bias
        return float(1 / (1 + np.exp(-np.clip(z, -50, 50))))


def scored(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """All columns of `docs` with `score` and `predicted`; null texts count as empty.

    Columns of `docs` that are called `score` or `predicted` are replaced.
    """
    held: list[Scorer] = []

    def add(batches):
        if not held:
            held.append(Scorer(model))
        for batch in small_batches(batches, 512):
            at = batch.schema.get_field_index("text")
            scores = [held[0].score(t) for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(scores, pa.float64())], [*batch.schema.names, "score"]
            )

    from pyspark.sql.types import DoubleType, StructType

    rows = whole_texts(docs).drop("score", "predicted").withColumn("text", F.col("text").cast("string"))
    schema = StructType([*rows.schema.fields]).add("score", DoubleType())
    return rows.mapInArrow(add, schema).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def toxicity_scores(docs: DataFrame, labels: DataFrame, fit: Fit = Fit()) -> DataFrame:
    """doc_id, held_out, score, predicted per row of `docs`.

    Null and empty texts have the bias as their score, whole texts of any length are read, repeated
    rows are scored each, a null doc_id stays null and is never held out; other columns are not read. An
    empty table gives no rows.
    """
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return scored(narrow, train(docs, labels, fit)).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted"
    )


def keep_clean(docs: DataFrame, labels: DataFrame, fit: Fit = Fit()) -> DataFrame:
    """Rows of `docs`, all columns whatever their names, without those predicted toxic.

    Null and empty texts are scored like any other, repeated rows and null ids stay each. An empty
    table gives no rows.
    """
    names = docs.columns
    # numbered on the way, so that no column is taken for a score
    held = [c if c == "text" else f"c{i}" for i, c in enumerate(names)]
    kept = scored(docs.toDF(*held), train(docs, labels, fit)).where("predicted = 0")
    return kept.select(*(F.col(h).alias(c) for h, c in zip(held, names)))
