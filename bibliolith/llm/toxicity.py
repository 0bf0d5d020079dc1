"""Toxicity scores by FTRL-proximal logistic regression over hashed n-grams and skip-grams.

Features of a text are its distinct lower-cased words, word pairs, and pairs with one or
two words skipped, hashed to ``2**bits`` coordinates.  FTRL-proximal keeps a rate for each
coordinate and zeroes weights whose evidence stays under ``l1``, so the model that goes to
the executors is a list of a few thousand coordinates, bounded by ``2**bits``.

Training is on Spark: a seeded sample of at most about ``max_train_rows`` labelled rows is
dealt to shards; each round, every shard runs FTRL over its rows from the common state, and
the states are averaged.  Scoring covers every whole text.

Defined cases: null, empty and word-less texts get the score of the intercept alone; rows
without a label, or whose label is null, are not learned from; several labels of one id
count as their maximum; with no labels at all, or one class only, the score is the smoothed
share of class 1; repeated rows are each scored; a very long text is scored whole, in one
piece of memory; equal texts tie, and a score at the threshold counts as toxic; an empty table
gives no rows; other columns stay, and one that has the score's name is replaced.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .store import Scratch
from .textkit import LOWER, byte_rolling, mix, row_slices, text_buffers

TOKEN = np.zeros(256, bool)
TOKEN[48:58] = TOKEN[65:91] = TOKEN[97:123] = TOKEN[128:] = True
SKIPS = (1, 2, 3)


def feature_pairs(data: np.ndarray, offsets: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, coordinate) of every feature occurrence in the rows of a slice."""
    low = LOWER[data]
    inside = TOKEN[low]
    edge = np.empty(len(low) + 1, bool)
    edge[1:-1] = inside[1:] != inside[:-1]
    edge[0] = edge[-1] = True
    edge[offsets] = True
    at = np.flatnonzero(edge)
    held = inside[at[:-1]] if len(at) > 1 else np.zeros(0, bool)
    start, end = at[:-1][held], at[1:][held]
    word = byte_rolling(low).span(start, end)
    row = np.searchsorted(offsets, start, "right") - 1
    shift = np.uint64(64 - bits)
    rows, coords = [row], [mix(word) >> shift]
    for k in SKIPS:
        same = row[:-k] == row[k:] if len(row) > k else np.zeros(0, bool)
        pair = mix(word[:-k] * np.uint64(2 * k + 1) + mix(word[k:]))[same] if len(row) > k else word[:0]
        rows.append(row[:-k][same] if len(row) > k else row[:0])
        coords.append(pair >> shift)
    return np.concatenate(rows), np.concatenate(coords).astype(np.int64)


def distinct_by_row(row: np.ndarray, coord: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    both = np.unique((row.astype(np.int64) << bits) | coord)
    return both >> bits, both & ((1 << bits) - 1)


class Ftrl:
    """FTRL-proximal state for binary features; coordinate ``2**bits`` is the intercept, free of L1."""

    def __init__(self, bits: int, alpha: float, beta: float, l1: float, l2: float, state: np.ndarray | None = None):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros((2, (1 << bits) + 1)) if state is None else state.astype(np.float64)

    def weights(self, at) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        shrunk = np.sign(z) * np.maximum(np.abs(z) - np.where(np.asarray(at) == len(self.z) - 1, 0.0, self.l1), 0.0)
        return -shrunk / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)

    def learn(self, coords: np.ndarray, label: int) -> None:
        at = np.append(coords, len(self.z) - 1)
        w = self.weights(at)
        g = _sigmoid(w.sum()) - label
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g


def _sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35.0, 35.0)))


def _shard_trainer(bits: int, params: dict, state):
    """One pass of FTRL over the rows of a shard; returns the state it reaches."""

    def train(table: pa.Table) -> pa.Table:
        model = Ftrl(bits, state=state.value, **params)
        table = table.sort_by([("_order", "ascending"), ("_text", "ascending")])
        data, offsets = text_buffers(table["_text"])
        labels = table["_label"].to_numpy()
        for i, j in row_slices(offsets):
            part = offsets[i : j + 1] - offsets[i]
            row, coord = distinct_by_row(*feature_pairs(data[offsets[i] : offsets[j]], part, bits), bits)
            cut = np.searchsorted(row, np.arange(j - i + 1))
            for k in range(j - i):
                model.learn(coord[cut[k] : cut[k + 1]], int(labels[i + k]))
        packed = np.stack([model.z, model.n]).astype(np.float32)
        return pa.table({"rows": pa.array([len(labels)], pa.int64()), "state": pa.array([packed.tobytes()], pa.binary())})

    return train


def fit_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    learn_from: Column | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    bits: int = 18,
    max_train_rows: int = 20_000,
    shard_rows: int = 5_000,
    rounds: int = 4,
    alpha: float = 0.5,
    beta: float = 1.0,
    l1: float = 10.0,
    l2: float = 0.0,
    seed: int = 11,
) -> dict:
    """Weights as ``{"bits", "coords", "weights", "intercept"}``, at most ``2**bits`` of them.

    ``learn_from`` is a condition on ``_id`` that a labelled row must meet.
    """
    spark = docs.sparkSession
    known = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_label"))
    known = known.where(F.col("_id").isNotNull() & F.col("_label").isNotNull())
    if learn_from is not None:
        known = known.where(learn_from)
    known = known.groupBy("_id").agg(F.max("_label").alias("_label"))
    n, positive = known.agg(F.count(F.lit(1)), F.sum("_label")).first()
    base = math.log(((positive or 0) + 1) / (n - (positive or 0) + 1))
    empty = {"bits": bits, "coords": np.zeros(0, np.int64), "weights": np.zeros(0), "intercept": base}
    if not n or not positive or positive == n:
        return empty
    order = F.xxhash64(F.lit(seed), F.col("_id"))
    known = known.withColumn("_order", order)
    if n > max_train_rows:
        # A share of the hash range, so that the sample is about max_train_rows whatever n is.
        known = known.where(F.pmod(F.col("_order"), F.lit(1 << 30)) < F.lit(int((1 << 30) * max_train_rows / n)))
    rows = min(n, max_train_rows)
    shards = max(1, min(8, math.ceil(rows / shard_rows)))
    text = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    # The sample's ids and labels are bounded by max_train_rows, so their broadcast is too.
    sample = text.join(F.broadcast(known), "_id").withColumn(
        "_shard", F.pmod(F.xxhash64(F.lit(seed + 1), F.col("_id")), F.lit(shards)).cast("int")
    )
    scratch = Scratch(spark)
    sample = scratch.write(sample)
    params = {"alpha": alpha, "beta": beta, "l1": l1, "l2": l2}
    state = np.zeros((2, (1 << bits) + 1), np.float32)
    state[0, -1] = -base * (beta / alpha + l2)  # the intercept starts at the prior odds
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(state)
        states = sample.groupBy("_shard").applyInArrow(_shard_trainer(bits, params, shared), "rows long, state binary")
        state, seen = np.zeros_like(state), 0
        for row in states.collect():  # as many as there are shards, of 2**bits numbers each
            state += row["rows"] * np.frombuffer(row["state"], np.float32).reshape(state.shape)
            seen += row["rows"]
        shared.unpersist()
        if not seen:
            scratch.drop(sample)
            return empty
        state /= seen
    scratch.drop(sample)
    model = Ftrl(bits, state=state, **params)
    weights = model.weights(np.arange(len(model.z)))
    coords = np.flatnonzero(weights[:-1])
    return {"bits": bits, "coords": coords, "weights": weights[coords], "intercept": float(weights[-1])}


def score_texts(model: dict, column: pa.Array) -> np.ndarray:
    bits = model["bits"]
    dense = np.zeros(1 << bits)
    dense[model["coords"]] = model["weights"]
    data, offsets = text_buffers(column)
    total = np.full(len(offsets) - 1, model["intercept"])
    for i, j in row_slices(offsets):
        row, coord = feature_pairs(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], bits)
        useful = dense[coord] != 0
        row, coord = distinct_by_row(row[useful], coord[useful], bits)
        total[i:j] += np.bincount(row, dense[coord], j - i)
    return _sigmoid(total)


def score_toxicity(docs: DataFrame, model: dict, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` with one more column, the score; the weights are broadcast, and no row moves.

    A column that has the score's name already is replaced.
    """
    docs = docs.drop(score_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(score_texts(shared.value, batch.column(batch.schema.get_field_index(text_col))))],
                names=[*batch.schema.names, score_col],
            )

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(score_col, DoubleType(), False)]))
