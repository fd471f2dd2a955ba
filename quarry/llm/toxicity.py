"""Toxicity scores: FTRL-proximal logistic regression over hashed word features.

Features of a text are the distinct hashed words, word stems (the first
``STEMS`` bytes), word pairs and skip-grams (words one apart) of its
lower-cased words, as indicators in ``2**BITS`` slots.  FTRL-proximal keeps a learning rate for each coordinate and an L1 term
that leaves most weights at exactly zero; the non-zero ones (a bounded, small
table) are shipped to the scoring tasks.

Fitting uses at most ``train_rows`` labelled rows of the training fold, those
with the smallest hash of their id - a documented bound of the fit.  The fold
test, the labels and the other columns never reach the scoring function.
Scoring is one map over all whole texts, without a shuffle.

Null or empty texts get the bias alone.  Labels that are null are not used; a
document labelled more than once counts as toxic if any label says so.  With
no usable label every score is 0.5 exactly.  Repeated rows get equal scores; clashing extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.common import SMALL_PIECE, Hasher, U64, mix, pieces, read, utf8_column

BITS = 20
TRAIN_ROWS = 20_000
EPOCHS = 3
STEMS = (4, 5, 6)
ALPHA, BETA, L1, L2 = 0.3, 1.0, 8.0, 1e-3
HASH = Hasher(4104)
BIAS = 0  # slot of the constant feature


def fold(id_column: str, parts: int):
    """crc32 of the id as text, modulo ``parts``."""
    return F.pmod(F.crc32(F.col(id_column).cast("string").cast("binary")), F.lit(parts))


def feature_slots(piece) -> tuple[np.ndarray, np.ndarray]:
    """(text number, slot) of every word, pair and skip-gram occurrence."""
    words = HASH.words(piece.buf, piece.starts, piece.ends)
    doc = np.repeat(np.arange(len(piece.counts)), piece.counts)
    docs, hashes = [doc], [words]
    for size in STEMS:
        longer = piece.ends - piece.starts > size
        a = piece.starts[longer]
        docs.append(doc[longer])
        hashes.append(mix(HASH.words(piece.buf, a, a + size) + U64(size)))
    for gap, salt in ((1, 0x9E3779B97F4A7C15), (2, 0xD1B54A32D192ED03)):
        if len(words) > gap:
            same = doc[:-gap] == doc[gap:]
            docs.append(doc[:-gap][same])
            hashes.append(mix(words[:-gap][same] * U64(salt) + words[gap:][same]))
    slot = (np.concatenate(hashes) >> U64(64 - BITS)).astype(np.int64)
    return np.concatenate(docs), np.maximum(slot, BIAS + 1)


class Ftrl:
    """FTRL-proximal state over ``2**BITS`` indicator features."""

    def __init__(self):
        self.z, self.n = np.zeros(1 << BITS), np.zeros(1 << BITS)

    def weights(self, at: np.ndarray) -> np.ndarray:
        z = self.z[at]
        w = -(z - np.sign(z) * L1) / ((BETA + np.sqrt(self.n[at])) / ALPHA + L2)
        return np.where((np.abs(z) <= L1) & (at != BIAS), 0.0, w)

    def learn(self, at: np.ndarray, label: int) -> None:
        w = self.weights(at)
        g = 1.0 / (1.0 + np.exp(-np.clip(w.sum(), -30, 30))) - label
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[at] = n + g * g


def fit(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, folds: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Slots and weights of a model learned from rows outside fold 0."""
    usable = (labels.select("doc_id", "toxic").where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
              .where(fold("doc_id", folds) != 0)
              .groupBy("doc_id").agg(F.max("toxic").alias("toxic")))
    sample = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows)  # bounded by train_rows
    rows = (docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
            .select(F.xxhash64("doc_id").alias("h"), "doc_id", "text", F.col("toxic").cast("int"))
            .repartition(1).sortWithinPartitions("h", "doc_id").select("text", "toxic"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, kept = Ftrl(), []  # kept: slots of a piece's texts in one array, their bounds and labels
        for batch in batches:
            label = batch.column(1).to_numpy(zero_copy_only=False)
            for a, b, piece in pieces(*utf8_column(batch.column(0)), lower=True, limit=SMALL_PIECE):
                doc, slot = feature_slots(piece)
                pairs = np.unique(np.concatenate([doc << BITS | slot, np.arange(b - a) << BITS | BIAS]))
                ends = np.searchsorted(pairs, np.arange(b - a + 1) << BITS)
                kept.append(((pairs & ((1 << BITS) - 1)).astype(np.int32), ends, label[a:b].astype(int)))
        for _ in range(EPOCHS):
            for slots, ends, labels_here in kept:
                for k, y in enumerate(labels_here):
                    model.learn(slots[ends[k]: ends[k + 1]], int(y))
        w = model.weights(np.arange(1 << BITS))
        at = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(w[at])], ["slot", "weight"])

    got = rows.mapInArrow(run, "slot int, weight double").toPandas()  # at most 2**BITS, in practice some thousand
    return got["slot"].to_numpy(np.int64), got["weight"].to_numpy(np.float64)


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], id_column: str = "doc_id",
          text_column: str = "text", folds: int = 5, keep: bool = False) -> DataFrame:
    """doc_id, held_out, score, predicted for each row; ``keep`` returns all input columns and ``_score`` (replaced if it exists)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = [c for c in docs.columns if c.lower() != "_score"] if keep else [id_column, text_column]
    d = docs.select(*[F.col(f"`{c}`") for c in names])
    text_at = names.index(text_column)
    score_name = "_score" if keep else "score"
    schema = T.StructType([*d.schema.fields, T.StructField(score_name, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots, values = shared.value
        weight = np.zeros(1 << BITS)
        weight[slots] = values
        live = weight != 0
        for batch in batches:
            out = np.full(batch.num_rows, weight[BIAS])
            for a, _, piece in pieces(*utf8_column(batch.column(text_at)), lower=True, limit=SMALL_PIECE):
                doc, slot = feature_slots(piece)
                used = live[slot]
                pairs = np.unique(doc[used] << BITS | slot[used])
                np.add.at(out, a + (pairs >> BITS), weight[pairs & ((1 << BITS) - 1)])
            p = 1.0 / (1.0 + np.exp(-np.clip(out, -60, 60)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p)], [*batch.schema.names, score_name])

    scored = d.mapInArrow(run, schema)
    if keep:
        return scored
    return scored.select(F.col(id_column), F.coalesce(fold(id_column, folds) == 0, F.lit(False)).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return score(docs, fit(docs, read(spark, sf_dir, "labels")))
