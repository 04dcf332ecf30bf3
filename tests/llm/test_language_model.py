"""The language model against plain counting; hot words and pairs, nulls, empty and long texts, repeats, empty tables, clashing names."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.llm import language_model as lm

ROWS = "doc_id long, text string"


def tokens(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")), None]


def brute(rows, train):
    one, two, three = Counter(), Counter(), Counter()
    after1, after2, all1, all2 = defaultdict(set), defaultdict(set), Counter(), Counter()

    def contexts(own):
        before = [0, 0, *own]
        return zip(before, before[1:], own, strict=False)

    for k, text in rows:
        if train(k):
            for a, b, c in contexts(tokens(text)):
                one[c] += 1
                two[b, c] += 1
                three[a, b, c] += 1
                after1[b].add(c)
                after2[a, b].add(c)
                all1[b] += 1
                all2[a, b] += 1
    total, scale = sum(one.values()), sum(one.values()) + 0.5 * (len(one) + 1)
    q = lambda p: 2 ** (-round(-math.log2(p) * lm.STEPS) / lm.STEPS)
    out = []
    for k, text in rows:
        own, base, score = tokens(text), 0.0, 0.0
        for a, b, c in contexts(own):
            p = (one[c] + 0.5) / scale
            base += math.log10(p)
            for n, many, kinds in ((two[b, c], all1[b], len(after1[b])), (three[a, b, c], all2[a, b], len(after2[a, b]))):
                if many:
                    p = q(lm.DISCOUNT * kinds / many) * p + (q((n - lm.DISCOUNT) / many) if n else 0)
            score += math.log10(min(p, 1))
        out.append((k, bool(train(k)), len(own), sum(one[c] > 0 for c in own), total, round(base, 6), round(score, 3)))
    return sorted(out, key=repr)


def corpus(seed, n=160):
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        own = []
        for _ in range(rng.choice([0, 1, 2, 8, 60])):
            own += rng.choice([["the", f"n{rng.randrange(20)}"], ["of", "the"], [f"W{rng.randrange(60)}"], ["é", "the", "end"]])
        rows.append((k, rng.choice([" ", "\n", "\t "]).join(own)))
    return [*rows, (500, None), (501, ""), (502, " \r\n"), (503, "the " * 3000 + "end"), (503, "of the the"), (503, "of the the"), (None, "of the night")]


def collected(df):
    return sorted(((*r[:5], round(r[5], 6), round(r[6], 3)) for r in df.collect()), key=repr)


def split(k):
    return k is None or k % 5 != 1


@pytest.mark.parametrize(("limit", "part"), [(1 << 20, 1 << 21), (40, 200)])
def test_scores_against_plain_counting(spark, limit, part):
    rows = corpus(limit)
    table = spark.createDataFrame(rows, ROWS).repartition(3).selectExpr("*", "1 AS part", "'x' AS words", "2 AS train", "3 AS score")
    got = collected(lm.scored(table, F.expr("doc_id IS NULL OR doc_id % 5 != 1"), limit=limit, part=part))
    want = brute(rows, split)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert np.allclose([r[5:] for r in got], [r[5:] for r in want], atol=2e-3)
    held = [r for r in got if not r[1] and r[2] > 20]
    assert held and all(r[6] > r[5] for r in held)


def test_without_training_texts_and_empty(spark):
    table = spark.createDataFrame([(1, "a b"), (2, None)], ROWS)
    assert collected(lm.scored(table, F.lit(False))) == [(1, False, 3, 0, 0, 0.0, 0.0), (2, False, 1, 0, 0, 0.0, 0.0)]
    out = lm.scored(spark.createDataFrame([], ROWS), F.lit(True))
    assert out.columns == ["doc_id", "train", "n_tokens", "n_known", "train_tokens", "base_score", "score"] and out.count() == 0


@pytest.mark.parametrize(("n", "universe"), [(0, 10), (1, 1 << 64), (5, 7), (1000, 1 << 64), (70_000, 1 << 40), (3000, 3001), (100, 100)])
def test_elias_fano_round_trip(n, universe):
    rng = np.random.default_rng(n)
    high = universe - 1
    values = np.arange(n, dtype=np.uint64) if n == universe else np.unique(rng.integers(0, high, n, np.uint64, endpoint=True))
    own = lm.EliasFano(values, universe)
    assert (own.find(values) == np.arange(len(values))).all()
    asked = rng.integers(0, high, 5000, np.uint64, endpoint=True)
    at = np.searchsorted(values, asked)
    hit = at < len(values)
    hit[hit] = values[at[hit]] == asked[hit]
    assert (own.find(asked) == np.where(hit, at, -1)).all()
    assert (own.at(np.arange(len(values))).view(np.uint64) == values).all()
    if n >= 1000:
        assert 8 * (own.low.nbytes + own.high.nbytes) < len(values) * (math.log2(universe / len(values)) + 4) + 300


def test_probabilities_of_a_context_sum_to_one():
    rng = np.random.default_rng(3)
    own = rng.integers(0, 6, (3, 400))
    nothing = np.zeros((3, 0), np.int64)
    trie = lm.Trie(np.arange(6) * 7, *own, nothing, np.zeros((4, 0), np.int64))
    every = np.arange(6)
    for a, b in ((0, 0), (3, 5), (-1, 2), (2, -1)):
        p = trie.probabilities(np.full(6, a), np.full(6, b), every, np.full(6, 1 / 6))
        assert abs(p.sum() - 1) < 2e-3 and (p > 0).all()
