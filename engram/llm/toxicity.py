"""Toxicity: a linear classifier over hashed character n-grams scaled by naive Bayes log-count ratios."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engram.llm import _text as T
from engram.llm._spark import Workspace, maybe_broadcast, small_batches

#: n-gram lengths in bytes (A-Z lower-cased), and bits of the feature index. These lengths and LEAST_RATIO are the best of a cross-validation over the four folds that labels are learned from.
LENGTHS, BITS = (4, 6), 20
#: Labelled rows of each class that the weights are fitted on, at most; the ratios count all labelled rows.
FIT_ROWS = 3000
#: Documents that a feature has to be in, and the least absolute log-count ratio, for it to get a weight.
LEAST_DOCS, LEAST_RATIO = 5, 1.75


def again(index: np.ndarray) -> np.ndarray:
    """The feature that an n-gram's being there twice or more is."""
    return (index.astype(np.int64) * 2654435761 + 12345 & (1 << BITS) - 1).astype(np.int32)


def _features(data: np.ndarray, bounds: np.ndarray, seen: np.ndarray) -> Iterator[np.ndarray]:
    """The distinct feature indexes of each document: its n-grams, and those that it has twice or more. seen: scratch of 2**BITS int32."""
    low = T.LOWER[data].astype(np.uint64)
    n = len(low)
    grams, code = {}, low
    for size in range(2, max(LENGTHS) + 1):
        code = code[: n - size + 1] | (low[size - 1 :] << np.uint64(8 * (size - 1))) if n >= size else np.zeros(0, np.uint64)
        if size in LENGTHS:
            grams[size] = ((code + np.uint64(size)) * T.BASE >> np.uint64(64 - BITS)).astype(np.int32)

    def distinct(own: np.ndarray) -> np.ndarray:
        """Where the last one of each value stands."""
        number = np.arange(len(own), dtype=np.int32)
        seen[own] = number
        return seen[own] == number

    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        own = np.concatenate([grams[s][a : max(a, b - s + 1)] for s in LENGTHS])
        last = distinct(own)
        twice = own[~last]
        found = np.concatenate((own[last], again(twice[distinct(twice)])))
        yield found[distinct(found)]


@dataclass
class Model:
    """score = sigmoid(bias + sum of the weights of a text's distinct features)."""

    weights: np.ndarray
    bias: float

    def scores(self, column: pa.Array) -> np.ndarray:
        seen = np.zeros(1 << BITS, dtype=np.int32)
        out = [self.bias + self.weights[f].sum(dtype=np.float64) for c in T.chunks(column) for f in _features(c.data, c.bounds, seen)]
        return 1 / (1 + np.exp(-np.clip(np.array(out, dtype=np.float64), -40, 40)))


def fit_weights(
    rows: list[np.ndarray],
    labels: np.ndarray,
    ratios: np.ndarray,
    base_rate: float,
    steps: int = 300,
    rate: float = 0.5,
    decay: float = 1e-5,
) -> Model:
    """Logistic regression on ratio-scaled presence features; rows of a class weigh as that class does at base_rate."""
    used = np.flatnonzero(ratios)
    place = np.full(len(ratios), -1, dtype=np.int64)
    place[used] = np.arange(len(used))
    kept = [p[p >= 0] for p in (place[r] for r in rows)]
    sizes = np.array([len(k) for k in kept])
    flat = np.concatenate(kept) if kept else np.zeros(0, np.int64)
    starts = np.cumsum(sizes) - sizes
    full = sizes > 0
    scale = ratios[used] / max(1.0, np.sqrt(np.mean(sizes) if len(sizes) else 1.0))
    share = np.where(labels == 1, base_rate / max(1, (labels == 1).sum()), (1 - base_rate) / max(1, (labels == 0).sum()))
    v, bias = np.zeros(len(used)), float(np.log(base_rate / (1 - base_rate)))
    # Adam: few steps, no tuning by feature scale.
    m1, m2 = np.zeros(len(used) + 1), np.zeros(len(used) + 1)
    for step in range(1, steps + 1):
        z = np.full(len(kept), bias)
        if len(flat):
            z[full] += np.add.reduceat((v * scale)[flat], starts[full])
        error = share * (1 / (1 + np.exp(-np.clip(z, -40, 40))) - labels)
        g = np.append(np.bincount(flat, weights=np.repeat(error, sizes), minlength=len(used)) * scale + decay * v, error.sum())
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.99 * m2 + 0.01 * g * g
        move = rate * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-8)
        v, bias = v - move[:-1], bias - float(move[-1]) * 0.1
    weights = np.zeros(len(ratios))
    weights[used] = v * scale
    return Model(weights, bias)


def count_ratios(rows: DataFrame) -> tuple[np.ndarray, int, int]:
    """rows: text, label (0 or 1). The log-count ratio of each feature, and the rows of label 0 and of label 1.

    log((p + 1) / (P + 2)) - log((q + 1) / (Q + 2)), p of P rows of label 1 and q of Q rows of label 0 having the feature: counted
    over all rows, per task, then summed. 0 for features in fewer than LEAST_DOCS rows or under LEAST_RATIO.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(1 << BITS, dtype=np.int32)
        has, total = np.zeros((2, 1 << BITS), dtype=np.int64), [0, 0]
        for batch in batches:
            labels = batch.column("label").to_pylist()
            at = 0
            for c in T.chunks(batch.column("text")):
                for f in _features(c.data, c.bounds, seen):
                    has[labels[at], f] += 1
                    total[labels[at]] += 1
                    at += 1
        used = np.flatnonzero(has.any(axis=0))
        index = np.append(used, -1)  # -1: the rows themselves
        yield pa.RecordBatch.from_arrays([pa.array(index), *(pa.array(np.append(has[k][used], total[k])) for k in (0, 1))], ["feature", "n0", "n1"])

    counts = rows.mapInArrow(count, "feature long, n0 long, n1 long").groupBy("feature").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    # Features in too few rows get no weight, so they needn't be brought; at most 2**BITS + 1 rows are, whatever the input.
    table = counts.filter(f"feature < 0 or n0 + n1 >= {LEAST_DOCS}").toArrow()
    feature = table.column("feature").to_numpy()
    n0, n1 = np.zeros(1 << BITS), np.zeros(1 << BITS)
    own = feature >= 0
    n0[feature[own]], n1[feature[own]] = table.column("n0").to_numpy()[own], table.column("n1").to_numpy()[own]
    all0, all1 = (int(table.column(c).to_numpy()[~own].sum()) for c in ("n0", "n1"))
    ratios = np.log((n1 + 1) / (all1 + 2)) - np.log((n0 + 1) / (all0 + 2))
    ratios[(n0 + n1 < LEAST_DOCS) | (np.abs(ratios) < LEAST_RATIO)] = 0
    return ratios, all0, all1


def train_toxicity(labelled: DataFrame, fit_rows: int = FIT_ROWS) -> Model:
    """labelled: doc_id, text, label (0/1; others and nulls are ignored). Ratios: see count_ratios. Weights are fitted on the driver
    on at most fit_rows rows of each class, those with the smallest hashes of doc_id. Without rows of both classes the
    score is the base rate (0.5 without any row).
    """
    small_batches(labelled.sparkSession)
    work = Workspace(labelled.sparkSession, "toxicity")
    rows = labelled.filter("label in (0, 1)").select("doc_id", F.col("text").cast("string").alias("text"), F.col("label").cast("int").alias("label"))
    ratios, all0, all1 = count_ratios(rows)
    if not all0 or not all1:
        rate = min(max(all1 / (all0 + all1), 1e-6), 1 - 1e-6) if all0 + all1 else 0.5
        return Model(np.zeros(1 << BITS), float(np.log(rate / (1 - rate))))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(1 << BITS, dtype=np.int32)
        for batch in batches:
            found = [f[ratios[f] != 0].astype(np.int32) for c in T.chunks(batch.column("text")) for f in _features(c.data, c.bounds, seen)]
            offsets = pa.array(np.concatenate(([0], np.cumsum([len(f) for f in found]))).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("label"),
                    pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(found) if found else np.zeros(0, np.int32))),
                ],
                ["label", "features"],
            )

    ids = rows.select("doc_id", "label")
    chosen = [ids.filter(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows).select("doc_id") for k in (0, 1)]
    chosen = work.write(chosen[0].union(chosen[1]).distinct(), "fit_ids")
    sample = rows.join(F.broadcast(chosen), "doc_id", "left_semi").select("label", "text").mapInArrow(extract, "label int, features array<int>").toArrow()
    lists = sample.column("features").combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    offsets, values = lists.offsets.to_numpy(), lists.values.to_numpy()
    fit = [values[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
    return fit_weights(fit, sample.column("label").to_numpy(), ratios, all1 / (all0 + all1))


def score_toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of each row of docs (doc_id, text); null and empty texts score as a text without features."""
    small_batches(docs.sparkSession)
    weights, bias = model.weights.astype(np.float32), model.bias

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(weights, bias)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.scores(batch.column("text")), pa.float64())], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")


def held_out(doc_id: Column) -> Column:
    """The fold that labels are never learned from: crc32 of doc_id as text, modulo 5, is 0."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5 == 0


def toxicity(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """docs (doc_id, text), labels (doc_id, toxic): doc_id, held_out, score (0 to 1), predicted (score >= 0.5).

    Learns from labelled documents outside the held-out fold. Several labels of one doc_id: the largest counts; null
    labels and ids are ignored. Rows are scored one by one; an empty table gives no rows.
    """
    seen = labels.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("toxic").cast("int").alias("label"),
    ).filter(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull())
    seen = seen.groupBy("doc_id").agg(F.max("label").alias("label"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    seen = maybe_broadcast(Workspace(docs.sparkSession, "toxicity_labels").write(seen, "seen"))
    model = train_toxicity(texts.join(seen, "doc_id"), fit_rows)
    scored = score_toxicity(docs, model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
