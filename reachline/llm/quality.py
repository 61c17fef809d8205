"""Quality classifier: random-indexing word vectors and a small calibrated network."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TERMS, WIDTH = 8192, 32
"""Rows of the hashed vocabulary and components of a vector: the model has a fixed size."""

FEATURES = 3 * WIDTH + 4

MOST_LABELLED = 20_000
"""Labelled rows that the network is fitted on, those with the smallest hash of their id."""

HIDDEN, EPOCHS, RATE, DECAY = 32, 60, 0.003, 1e-4
THRESHOLD = 0.3
PIECE = 50_000  # words that are worked on at once
KEPT_WORDS = 300_000  # distinct words a task remembers the terms of

_RUN = re.compile(r"(.)\1+", re.DOTALL)


class _Marks(dict):
    """Character to A, a or 0 for letters and digits, else to itself."""

    def __missing__(self, code: int) -> str:
        character = chr(code)
        if character.isalpha():
            self[code] = "a" if character == character.lower() else "A"
        else:
            self[code] = "0" if character.isdigit() else character
        return self[code]


def shape(word: str, marks: dict) -> str:
    """Letters as A or a, digits as 0, runs shortened to two."""
    return _RUN.sub(r"\1\1", word.translate(marks))


class _Terms(dict):
    """Word to its two terms, the hashed lower-case form and the hashed shape, in one number."""

    def __init__(self) -> None:
        super().__init__()
        self.marks, self.shapes = _Marks(), {}

    def __missing__(self, word: str) -> int:
        if len(self) > KEPT_WORDS:
            self.clear()
        form = xxhash.xxh3_64_intdigest(word.lower()) % TERMS
        form_of = shape(word, self.marks)
        marks = self.shapes.get(form_of)
        if marks is None:
            if len(self.shapes) > KEPT_WORDS:
                self.shapes.clear()
            marks = self.shapes[form_of] = xxhash.xxh3_64_intdigest("\0" + form_of) % TERMS
        self[word] = form << 16 | marks
        return self[word]


def index_vectors() -> np.ndarray:
    """A sparse random vector per term: four components are 1 or -1, the others 0."""
    rng = np.random.default_rng(6)
    vectors = np.zeros((TERMS, WIDTH), np.float32)
    for _ in range(4):
        vectors[np.arange(TERMS), rng.integers(0, WIDTH, TERMS)] += rng.choice([-1, 1], TERMS)
    return vectors


def _codes(words: list[str], terms: _Terms) -> np.ndarray:
    return np.fromiter(map(terms.__getitem__, words), np.int64, len(words))


def _split(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forms and shapes."""
    return (codes >> 16).astype(np.uint16), (codes & 0xFFFF).astype(np.uint16)


def _add_by_term(sums: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
    order = np.argsort(ids, kind="stable")
    kept = ids[order]
    starts = np.flatnonzero(np.r_[True, kept[1:] != kept[:-1]])
    sums[kept[starts]] += np.add.reduceat(rows[order], starts, axis=0)


def _contexts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One task's sums of the neighbours' index vectors, per term, in parts of 512 terms.

    The words of all texts form one stream with a term without vector between texts. It is
    added up in pieces of about ``PIECE`` words that share their last and first word, so
    every pair of neighbours is in one piece.
    """
    index, terms = np.vstack([index_vectors(), np.zeros((1, WIDTH), np.float32)]), _Terms()
    sums = np.zeros((TERMS + 1, WIDTH))
    gap = np.array([TERMS << 16 | TERMS])
    held, waiting = [gap], 0

    def add() -> np.ndarray:
        codes = np.concatenate(held)
        forms, shapes = _split(codes)
        both = index[forms] + index[shapes]
        near = np.zeros_like(both)
        near[1:] += both[:-1]
        near[:-1] += both[1:]
        _add_by_term(sums, forms, near)
        _add_by_term(sums, shapes, near)
        return codes[-1:]

    for batch in batches:
        for text in batch["text"].dropna():
            words = text.split()
            for at in range(0, len(words), PIECE):
                held.append(_codes(words[at:at + PIECE], terms))
                waiting += len(held[-1])
                if waiting >= PIECE:
                    held, waiting = [add()], 0
            held.append(gap)
    add()
    yield pd.DataFrame({"part": range(TERMS // 512),
                        "sums": [p.astype(np.float32).tobytes()
                                 for p in np.split(sums[:TERMS], TERMS // 512)]})


def _added(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    totals: dict[int, np.ndarray] = {}
    for batch in batches:
        for part, data in zip(batch["part"], batch["sums"]):
            totals[part] = totals.get(part, 0.0) + np.frombuffer(data, np.float32).astype(float)
    yield pd.DataFrame({"part": list(totals), "sums": [
        t.astype(np.float32).tobytes() for t in totals.values()]})


def context_vectors(docs: DataFrame) -> np.ndarray:
    """The vector of every term: the sum of the index vectors of all its neighbours.

    All texts are read. Each task sends one table of ``TERMS`` x ``WIDTH`` numbers, whatever it
    read; they are added up by part in a stream, and the sum, 1 MB, goes to the driver.
    """
    sums = (docs.select("text").mapInPandas(_contexts, "part int, sums binary")
            .repartition(TERMS // 512, "part").mapInPandas(_added, "part int, sums binary"))
    # In double precision: little is left of a frequent term's sums once the mean is taken off.
    table = np.zeros((TERMS, WIDTH))
    for part, data in sums.collect():
        table[part * 512:(part + 1) * 512] = np.frombuffer(data, np.float32).reshape(512, WIDTH)
    table -= table.sum(0) / max(np.abs(table).sum(), 1) * np.abs(table).sum(1, keepdims=True)
    table /= np.maximum(np.linalg.norm(table, axis=1, keepdims=True), 1e-6)
    return table.astype(np.float32)


def pooled(text: str | None, contexts: np.ndarray, index: np.ndarray,
           terms: _Terms) -> np.ndarray:
    """Means of the context vectors of a text's words and of their shapes, and of the shapes'
    index vectors; length, share of repeated neighbours, of distinct words and lines."""
    words = (text or "").split()
    out = np.zeros(FEATURES, np.float32)
    if not words:
        return out
    repeated = 0
    for at in range(0, len(words), PIECE):
        forms, shapes = _split(_codes(words[at:at + PIECE], terms))
        out[:WIDTH] += contexts[forms].sum(0)
        out[WIDTH:2 * WIDTH] += contexts[shapes].sum(0)
        out[2 * WIDTH:3 * WIDTH] += index[shapes].sum(0)
        repeated += int((forms[1:] == forms[:-1]).sum())
    out[:3 * WIDTH] /= len(words)
    lines = text.split("\n")
    out[-4:] = (np.log(len(words)) / 10, repeated / len(words),
                len(set(words)) / len(words), len(set(lines)) / len(lines))
    return out


@dataclass
class Network:
    """Standardised inputs, one hidden layer of tanh, a logit divided by the temperature."""

    centre: np.ndarray
    spread: np.ndarray
    weights: list[np.ndarray]
    temperature: float = 1.0

    def logits(self, rows: np.ndarray) -> np.ndarray:
        first, bias, second, last = self.weights
        return np.tanh((rows - self.centre) / self.spread @ first + bias) @ second + last

    def probabilities(self, rows: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(rows) / self.temperature, -30, 30)))


def fit_network(rows: np.ndarray, labels: np.ndarray, seed: int = 0) -> Network:
    """Fit on four fifths of the rows, and the temperature on the other fifth.

    With labels of one kind only the network stays near their rate.
    """
    rng = np.random.default_rng(seed)
    if not len(rows):
        rows, labels = np.zeros((1, FEATURES)), np.ones(1)
    order = rng.permutation(len(rows))
    held = order[:len(rows) // 5]
    used = order[len(rows) // 5:]
    rows, labels = rows.astype(float), labels.astype(float)
    rate = np.clip(labels[used].mean(), 0.01, 0.99)
    weights = [rng.normal(0, rows.shape[1] ** -0.5, (rows.shape[1], HIDDEN)), np.zeros(HIDDEN),
               rng.normal(0, HIDDEN ** -0.5, HIDDEN), np.array(np.log(rate / (1 - rate)))]
    spread = rows[used].std(0)
    network = Network(rows[used].mean(0), np.where(spread > 1e-6, spread, 1.0), weights)
    inputs = (rows - network.centre) / network.spread
    moments = [[np.zeros_like(w), np.zeros_like(w)] for w in weights]
    step = 0
    for _ in range(EPOCHS):
        for batch in np.array_split(rng.permutation(used), max(1, len(used) // 128)):
            first, bias, second, last = weights
            x, y = inputs[batch], labels[batch]
            hidden = np.tanh(x @ first + bias)
            error = (1 / (1 + np.exp(-np.clip(hidden @ second + last, -30, 30))) - y) / len(batch)
            back = np.outer(error, second) * (1 - hidden**2)
            slopes = [x.T @ back + DECAY * first, back.sum(0), hidden.T @ error + DECAY * second,
                      np.array(error.sum())]
            step += 1
            for weight, slope, moment in zip(weights, slopes, moments):
                moment[0] = 0.9 * moment[0] + 0.1 * slope
                moment[1] = 0.999 * moment[1] + 0.001 * slope**2
                weight -= (RATE * moment[0] / (1 - 0.9**step)
                           / (np.sqrt(moment[1] / (1 - 0.999**step)) + 1e-8))
    if len(held):
        logits, truth = network.logits(rows[held]), labels[held]
        loss = lambda t: np.logaddexp(0, np.where(truth == 1, -1, 1) * logits / t).mean()
        network.temperature = float(min(np.geomspace(0.25, 8, 81), key=loss))
    return network


@dataclass
class QualityModel:
    contexts: np.ndarray
    network: Network

    def score(self, text: Column) -> Column:
        """Probability of label 1 of a text; null counts as empty."""
        contexts, network = self.contexts, self.network

        @F.pandas_udf("double")
        def scores(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            index, terms = index_vectors(), _Terms()
            for texts in batches:
                rows = [pooled(t, contexts, index, terms) for t in texts]
                yield pd.Series(network.probabilities(np.stack(rows)) if rows else [],
                                dtype="float64")
        return scores(text)


def held_out(doc_id: Column) -> Column:
    """Whether labels of this document are never learned: crc32 of the id as text, modulo 5,
    is 0, or there is no id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def fit_quality(docs: DataFrame, labels: DataFrame,
                most_labelled: int = MOST_LABELLED) -> QualityModel:
    """A model from all texts (word vectors) and at most ``most_labelled`` labels (network).

    Labels of held-out documents, null labels and ids with both labels are left out. Of rows
    that repeat a labelled doc_id one counts, that with the smallest features. Inputs are texts
    alone. Without labels the scores stay near a constant.
    """
    contexts = context_vectors(docs)
    index = index_vectors()
    chosen = (labels.where("quality is not null and doc_id is not null")
              .where(~held_out(F.col("doc_id")))
              .groupBy(F.col("doc_id").alias("__id"))
              .agg(F.min("quality").alias("__y"), F.max("quality").alias("__z"))
              .where("__y = __z").orderBy(F.xxhash64("__id"), "__id").limit(most_labelled))

    def pool(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        terms = _Terms()
        for batch in batches:
            yield pd.DataFrame({"id": batch["__id"], "label": batch["__y"], "row": [
                pooled(t, contexts, index, terms).tobytes() for t in batch["text"]]})

    # At most most_labelled rows of two numbers are sent to every task, and as many come back:
    # one row for each chosen id, however often documents repeat it.
    rows = (docs.select("doc_id", "text")
            .join(F.broadcast(chosen.select("__id", "__y")), F.col("doc_id") == F.col("__id"))
            .select(F.col("__id").cast("string").alias("__id"), "__y", "text")
            .mapInPandas(pool, "id string, label int, row binary")
            .groupBy("id").agg(F.min("label").alias("label"), F.min("row").alias("row"))
            .orderBy("id").collect())
    inputs = np.array([np.frombuffer(r["row"], np.float32) for r in rows]).reshape(
        len(rows), FEATURES)
    return QualityModel(contexts, fit_network(inputs, np.array([r["label"] for r in rows])))


def score_documents(docs: DataFrame, model: QualityModel,
                    threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with score, the probability of quality 1, and predicted, 1 from ``threshold``.

    Every whole text is scored, empty and null ones as empty; repeated rows alike. Columns
    score and predicted of ``docs`` are replaced.
    """
    return (docs.withColumn("score", model.score(F.col("text")))
            .withColumn("predicted", (F.col("score") >= threshold).cast("int")))


def op6_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "quality")
    scored = score_documents(docs, fit_quality(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                         "predicted")
