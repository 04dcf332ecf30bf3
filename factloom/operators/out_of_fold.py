"""Honest scores of training rows: each fold is scored by a logistic regression fitted on the folds before it.

All models are fitted together by iteratively reweighted least squares. In each round one pass over the rows adds up,
for each model, the normal equations of the rows of its folds; the sums are matrices of a few features, so only those come
to the driver. Sums of folds are merged, so a row is read once a round whatever the number of models.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.functions.lineage import cut


def _design(batch: pa.RecordBatch, width: int) -> np.ndarray:
    columns = [np.nan_to_num(batch.column(k).to_numpy(zero_copy_only=False).astype(float)) for k in range(width)]
    return np.column_stack([*columns, np.ones(len(batch))])


def _chance(x: np.ndarray, weights: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ weights, -500, 500)))


def fitted(rows: DataFrame, features: list[str], folds: int, label: str = "label", fold: str = "fold", c: float = 1.0, balanced: bool = True, rounds: int = 50, close: float = 1e-9) -> np.ndarray:
    """Weights (and an intercept at the end) of ``folds`` - 1 models; row k - 1 is fitted on the folds before k.

    The penalty is half the squared weights, without the intercept, over ``c``; ``balanced`` weighs both labels alike. Null features
    count 0, rows without a label or fold aren't learnt from. Where the folds have one label only, or none, all weights are 0 and
    the intercept tells it (0 for none).
    """
    width, size = len(features), len(features) + 1
    known = rows.where(F.col(label).isNotNull() & F.col(fold).isNotNull()).select(*(F.col(f).cast("double") for f in features), F.col(label).cast("double"), F.col(fold).cast("int"))
    counts = {r[0]: (r[1], r[2]) for r in known.groupBy(fold).agg(F.count("*"), F.sum(label)).collect()}
    weights, ready = np.zeros((folds - 1, size)), np.zeros(folds - 1, bool)
    shares = np.ones((folds - 1, 2))
    for k in range(1, folds):
        n = sum(counts.get(j, (0, 0))[0] for j in range(k))
        p = sum(counts.get(j, (0, 0))[1] for j in range(k))
        if not 0 < p < n:
            ready[k - 1] = True
            weights[k - 1, -1] = 0 if not n else (500 if p else -500)
        elif balanced:
            shares[k - 1] = n / (2 * (n - p)), n / (2 * p)
    penalty = np.append(np.full(width, 1 / c), 0)
    for _ in range(rounds):
        if ready.all():
            break
        now, open_ = weights.copy(), [k for k in range(folds - 1) if not ready[k]]

        def sums(batches: Iterator[pa.RecordBatch], now=now, open_=open_) -> Iterator[pa.RecordBatch]:
            total = np.zeros((len(open_), size * size + size))
            for batch in batches:
                x, y, own = _design(batch, width), batch.column(width).to_numpy(zero_copy_only=False), batch.column(width + 1).to_numpy(zero_copy_only=False)
                for i, k in enumerate(open_):
                    some = own <= k
                    a, s = x[some], shares[k][y[some].astype(int)]
                    p = _chance(a, now[k])
                    total[i, :-size] += ((a * (s * p * (1 - p))[:, None]).T @ a).ravel()
                    total[i, -size:] += a.T @ (s * (y[some] - p))
            yield pa.record_batch({"model": np.repeat(open_, total.shape[1]), "place": np.tile(np.arange(total.shape[1]), len(open_)), "v": total.ravel()})

        found = known.mapInArrow(sums, "model long, place long, v double").groupBy("model", "place").agg(F.sum("v").alias("v")).collect()
        total = np.zeros((folds - 1, size * size + size))
        for r in found:
            total[r.model, r.place] = r.v
        for k in open_:
            hessian = total[k, :-size].reshape(size, size) + np.diag(penalty)
            step = np.linalg.lstsq(hessian, total[k, -size:] - penalty * now[k], rcond=None)[0]
            weights[k] = now[k] + step
            ready[k] = np.abs(step).max() <= close * max(1, np.abs(weights[k]).max())
    return weights


def out_of_fold_scores(rows: DataFrame, features: list[str], folds: int, label: str = "label", fold: str = "fold", **options) -> DataFrame:
    """``rows`` of all folds but the first, with ``score``: the chance of label 1 by the model of the folds before."""
    rows = cut(rows)
    weights = fitted(rows, features, folds, label, fold, **options)
    own = F.element_at(F.array(*(F.array(*map(F.lit, map(float, w))) for w in weights)), F.col(fold).cast("int"))
    sum_ = F.element_at(own, -1)
    for k, f in enumerate(features):
        sum_ = sum_ + F.element_at(own, k + 1) * F.coalesce(F.nanvl(F.col(f).cast("double"), F.lit(0.0)), F.lit(0.0))
    return rows.where(F.col(fold).between(1, folds - 1)).withColumn("score", 1 / (1 + F.exp(-sum_)))
