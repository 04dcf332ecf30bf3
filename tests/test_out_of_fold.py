"""Out-of-fold scores against plain fits of each fold; the audit log through a stream that is stopped within a batch."""

import json

import numpy as np
import pytest
from pyspark.errors import StreamingQueryException

from factloom.operators import out_of_fold
from factloom.streaming import audit


def plain_fit(x, y, c=1.0):
    """Gradient steps with a falling rate until the gradient is gone."""
    n, p = len(y), y.sum()
    s = np.where(y == 1, n / (2 * p), n / (2 * (n - p)))
    a, w = np.column_stack([x, np.ones(n)]), np.zeros(x.shape[1] + 1)
    penalty = np.append(np.full(x.shape[1], 1 / c), 0)
    rate = 1 / (0.25 * np.linalg.norm(a * np.sqrt(s)[:, None], 2) ** 2 + 1 / c)
    for _ in range(60_000):
        g = a.T @ (s * (y - 1 / (1 + np.exp(-a @ w)))) - penalty * w
        w = w + rate * g
        if np.abs(g).max() < 1e-9:
            break
    return w


def test_scores_equal_a_plain_fit_of_each_fold(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 3)).round(3)
    y = (x @ [1.0, -2.0, 0.0] + rng.normal(size=400) > 0.3).astype(int)
    fold = np.repeat(np.arange(4), 100)
    rows = [(k, float(a), float(b), float(c), int(t), int(f)) for k, ((a, b, c), t, f) in enumerate(zip(x, y, fold, strict=True))]
    rows += [(900, 1.0, 1.0, 1.0, None, 0), (901, None, float("nan"), 0.5, None, 2), (902, 1.0, 1.0, 1.0, 1, None)]
    table = spark.createDataFrame(rows, "id long, a double, b double, c double, label int, fold int").repartition(5)
    got = {r.id: r.score for r in out_of_fold.out_of_fold_scores(table, ["a", "b", "c"], 4).collect()}
    assert set(got) == {*range(100, 400), 901}
    for k in (1, 2, 3):
        w = plain_fit(x[fold < k], y[fold < k])
        want = 1 / (1 + np.exp(-np.column_stack([x, np.ones(400)])[fold == k] @ w))
        assert np.allclose([got[i] for i in np.flatnonzero(fold == k)], want, atol=1e-6)
    w = plain_fit(x[fold < 2], y[fold < 2])
    assert got[901] == pytest.approx(1 / (1 + np.exp(-(0.5 * w[2] + w[3]))), abs=1e-6)


def test_folds_with_one_label_or_none(spark):
    rows = spark.createDataFrame([(0, 1.0, 1, 0), (1, 2.0, 1, 1), (2, 3.0, 0, 2)], "id long, a double, label int, fold int")
    assert {r.id: round(r.score, 6) for r in out_of_fold.out_of_fold_scores(rows, ["a"], 3).collect()} == {1: 1.0, 2: 1.0}
    empty = out_of_fold.out_of_fold_scores(rows.where("false"), ["a"], 3)
    assert empty.count() == 0
    later = out_of_fold.out_of_fold_scores(rows.where("fold = 2"), ["a"], 3)
    assert [r.score for r in later.collect()] == [0.5]


def answers(k):
    return [{"timestamp": f"t{k}-{i}", "question": "q", "entity": " e ", "relation_hint": None, "support_kind": "s", "decision": "audit" if i % 2 else "answer", "answer": ["", "snapshot missing as_of", None][i % 3], "flags": ["temporal_mismatch"] if i == 5 else None} for i in range(6)]


SCHEMA = "timestamp string, question string, entity string, relation_hint string, support_kind string, decision string, answer string, flags array<string>"


def test_audit_log_survives_a_stop_within_a_batch(spark, tmp_path, monkeypatch):
    (tmp_path / "in").mkdir()
    log, state = str(tmp_path / "log"), str(tmp_path / "state")

    def run():
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
        audit.append_stream(audit.audit_events(stream), log, state).awaitTermination()

    for k in range(3):
        (tmp_path / "in" / f"{k}.json").write_text("\n".join(json.dumps(a) for a in answers(k)))
    append = audit._append
    tried = []

    def stopped(batch, number, path):
        append(batch, number, path)
        tried.append(number)
        if number == 1 and tried.count(1) == 1:
            raise RuntimeError("stopped after the write, before the commit")

    monkeypatch.setattr(audit, "_append", stopped)
    with pytest.raises(StreamingQueryException):
        run()
    assert audit.read_log(spark, log).count() == 6  # the batch that wasn't committed is there
    run()
    run()
    got = sorted((r.timestamp, r.entity, r.reason, r.temporal_mismatch) for r in audit.read_log(spark, log).collect())
    assert tried == [0, 1, 1, 2]
    assert got == sorted((f"t{k}-{i}", "e", ["", "snapshot missing as_of", audit.NO_REASON][i % 3] or audit.NO_REASON, i in (1, 5)) for k in range(3) for i in (1, 3, 5))


def test_log_skips_malformed_lines(spark, tmp_path):
    (tmp_path / "batch=0").mkdir()
    (tmp_path / "batch=0" / "a.json").write_text('{"timestamp": "t", "question": "q"}\n\nbroken\n{"question": "no time"}\n')
    assert [r.timestamp for r in audit.read_log(spark, str(tmp_path)).collect()] == ["t"]
