"""Quality classifier: similarity-weighted votes of the nearest labelled texts in a latent space.

A text becomes counts of hashed terms: its words, the shapes of its words (letters,
digits and marks, runs shortened), and whether word pairs are new or repeated. Square
roots of the shares, weighted by inverse document frequency over the whole corpus, are
projected on the leading singular directions of the labelled texts. The labelled vectors,
at most ``MAX_LABELLED`` of them, are broadcast, and every text is compared with all of
them in exact blocked cosine products.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.words import _LOWER, byte_rows, hash_words, mix, row_chunks

#: Bound on the labelled rows that are learnt from and broadcast; they are chosen by a hash of the key.
MAX_LABELLED = 8192
NEIGHBOURS = 16
#: Power of the similarity that weighs a vote.
SHARPNESS = 8
THRESHOLD = 0.3
DIMENSIONS = 48
_WORDS, _SHAPES, _MARKS = 512, 384, 8
TERMS = _WORDS + _SHAPES + _MARKS
_BLOCK = 256

_CLASS = np.arange(256)
_CLASS[65:91], _CLASS[97:123], _CLASS[128:], _CLASS[48:58] = 88, 120, 120, 57
_EXACT = np.arange(256)


def _shape_bytes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes mapped to their class, runs of one class shortened to one."""
    kinds = _CLASS[data].astype(np.uint8)
    keep = np.ones(len(kinds), bool)
    keep[1:] = kinds[1:] != kinds[:-1]
    keep[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
    return kinds[keep], np.concatenate([[0], np.cumsum(keep)])[offsets]


def term_counts(column: pa.Array) -> Iterator[np.ndarray]:
    """Blocks of rows of term counts, in the order of ``column``; whole texts are read."""
    data, offsets = byte_rows(column)
    for first, last in row_chunks(offsets):
        own = offsets[first : last + 1] - offsets[first]
        text = data[offsets[first] : offsets[last]]
        words, bounds = hash_words(text, own)
        shapes, shape_bounds = hash_words(*_shape_bytes(text, own), fold=_EXACT)
        rows = last - first
        row = np.repeat(np.arange(rows), np.diff(bounds))
        counts = np.bincount(row * TERMS + (words % np.uint64(_WORDS)).astype(np.int64), minlength=rows * TERMS)
        shape_row = np.repeat(np.arange(rows), np.diff(shape_bounds))
        counts += np.bincount(shape_row * TERMS + _WORDS + (shapes % np.uint64(_SHAPES)).astype(np.int64), minlength=rows * TERMS)
        if len(words) > 1:
            same_row = row[1:] == row[:-1]
            pairs = mix(words[:-1] * np.uint64(3) + words[1:] + mix(row[1:].astype(np.uint64)))[same_row]
            pair_row = row[1:][same_row]
            fresh = np.zeros(len(pairs), bool)
            fresh[np.unique(pairs, return_index=True)[1]] = True
            twice = (words[1:] == words[:-1])[same_row]
            counts += np.bincount(pair_row * TERMS + _WORDS + _SHAPES + np.where(twice, 2, np.where(fresh, 0, 1)), minlength=rows * TERMS)
        yield counts.reshape(rows, TERMS)


@dataclass(frozen=True)
class Model:
    """Weights and projection of terms; vectors and labels of the labelled texts."""

    weights: np.ndarray
    axes: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    prior: float

    def weighted(self, counts: np.ndarray) -> np.ndarray:
        share = np.empty(counts.shape)
        for a, b in ((0, _WORDS), (_WORDS, _WORDS + _SHAPES), (_WORDS + _SHAPES, TERMS)):
            share[:, a:b] = np.sqrt(counts[:, a:b] / np.maximum(counts[:, a:b].sum(1, keepdims=True), 1))
        return share * self.weights

    def embed(self, counts: np.ndarray) -> np.ndarray:
        out = self.weighted(counts) @ self.axes
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)

    def scores(self, counts: np.ndarray) -> np.ndarray:
        """Votes in 0 to 1 for rows of counts; the share of good labels for rows without terms.

        All neighbours as near as the last one vote, so ties don't depend on the order of the labelled rows. Cosines
        are rounded to nine places, so equal texts have equal neighbours whatever block they come in.
        """
        out = np.full(len(counts), self.prior)
        if not len(self.labels):
            return out
        k = min(NEIGHBOURS, len(self.labels))
        for a in range(0, len(counts), _BLOCK):
            block = counts[a : a + _BLOCK]
            near = np.round(self.embed(block) @ self.vectors.T, 9)
            least = np.partition(near, near.shape[1] - k, axis=1)[:, near.shape[1] - k, None]
            votes = np.where(near >= least, np.maximum(near, 0), 0) ** SHARPNESS
            total = votes.sum(1)
            good = votes @ self.labels
            some = (total > 0) & (block.sum(1) > 0)
            out[a : a + _BLOCK][some] = good[some] / total[some]
        return np.clip(out, 0.0, 1.0)


def model_of(counts: Sequence[np.ndarray], labels: np.ndarray, frequency: np.ndarray, documents: int) -> Model:
    """Fit on term counts of labelled texts, with document frequencies of the corpus; a block of rows is laid out at a time."""
    weights = np.log1p(max(documents, 1) / np.maximum(frequency, 1))
    weights[_WORDS : _WORDS + _SHAPES] *= 2
    weights[_WORDS + _SHAPES :] = 3.0
    raw = Model(weights, np.eye(TERMS), np.zeros((0, TERMS)), labels, 0.5)
    gram = np.zeros((TERMS, TERMS))
    for a in range(0, len(counts), _BLOCK):
        rows = raw.weighted(np.stack(counts[a : a + _BLOCK]))
        gram += rows.T @ rows
    values, vectors = np.linalg.eigh(gram)
    axes = vectors[:, np.argsort(-values)[:DIMENSIONS]]
    prior = float(labels.mean()) if len(labels) else 0.5
    model = Model(weights, axes, np.zeros((0, DIMENSIONS)), labels, prior)
    vectors = [model.embed(np.stack(counts[a : a + _BLOCK])) for a in range(0, len(counts), _BLOCK)]
    return Model(weights, axes, np.concatenate(vectors) if vectors else np.zeros((0, DIMENSIONS)), labels.astype(np.float64), prior)


def _packed(row: np.ndarray) -> bytes:
    """A row of counts in the least number of bytes for each."""
    return row.astype(np.uint8 if row.max(initial=0) < 1 << 8 else np.uint16 if row.max() < 1 << 16 else np.uint32).tobytes()


def _unpacked(row: bytes) -> np.ndarray:
    return np.frombuffer(row, f"u{len(row) // TERMS}")


def document_frequency(documents: DataFrame, text: str = "text") -> tuple[np.ndarray, int]:
    """For each term the number of texts with it, and the number of texts, over all rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = np.zeros(TERMS, np.int64), 0
        for batch in batches:
            rows += batch.num_rows
            for block in term_counts(batch.column(0)):
                total += (block > 0).sum(0)
        yield pa.record_batch({"term": np.arange(-1, TERMS), "n": np.concatenate([[rows], total])})

    found = documents.select(text).mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(TERMS + 1, np.int64)
    out[found["term"].to_numpy(np.int64) + 1] = found["n"].to_numpy(np.int64)
    return out[1:], int(out[0])


def held_out(key: Column) -> Column:
    """Whether a row is kept from learning: CRC-32 of its key as text is divisible by 5."""
    return F.coalesce(F.crc32(F.encode(key.cast("string"), "UTF-8")) % 5 == 0, F.lit(False))


def fit(documents: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", max_labelled: int = MAX_LABELLED) -> Model:
    """Learn from at most ``max_labelled`` labelled rows that aren't held out.

    The bound takes the rows that are first by a hash of the key. Rows with a null key or
    label are not learnt from; a key with several labels has their mean, and of rows that
    repeat a key no more than the bound are taken, by key and terms. Without labels every text scores 0.5.
    """
    chosen = labels.select(F.col(key).alias("_k"), F.col(label).cast("double").alias("_y")).dropna()
    chosen = chosen.where(~held_out(F.col("_k"))).groupBy("_k").agg(F.avg("_y").alias("_y"))
    chosen = chosen.orderBy(F.xxhash64("_k"), "_k").limit(max_labelled)
    rows = documents.select(F.col(key).alias("_k"), F.col(text).alias("_t")).join(F.broadcast(chosen), "_k").select("_k", "_y", "_t")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_packed(r) for block in term_counts(batch.column(2)) for r in block]
            yield pa.record_batch({"k": batch.column(0).cast(pa.string()), "y": batch.column(1), "x": pa.array(found, pa.binary())})

    found = rows.mapInArrow(count, "k string, y double, x binary").orderBy("k", "x").limit(max_labelled).toPandas()
    frequency, documents_n = document_frequency(documents, text)
    return model_of([_unpacked(x) for x in found["x"]], found["y"].to_numpy(float), frequency, documents_n)


def with_score(documents: DataFrame, model: Model, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Add score (double, 0 to 1) and predicted (1 if score >= threshold, else 0) to every row.

    Null and empty texts get the model's share of good labels. Texts are read whole;
    equal ones get equal scores. All other columns pass through; columns of these two names are replaced.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)
    rest = documents.drop("score", "predicted")

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        column = pa.array(texts, pa.large_string(), from_pandas=True)
        parts = [shared.value.scores(block) for block in term_counts(column)]
        return pd.Series(np.concatenate(parts) if parts else np.zeros(0))

    out = rest.withColumn("score", score(F.col(text)))
    return out.withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))
