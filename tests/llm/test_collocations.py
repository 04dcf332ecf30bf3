"""Collocations against brute force and SQL: growth in several rounds, ties, copies, nulls, empty and long texts, clashing names."""

import random
import re
from collections import Counter

import duckdb
import pytest

from factloom.llm import collocations

ROWS = "doc_id long, text string, lang string"


def brute(rows, top, least, share=80):
    counts, sizes = Counter(), Counter()
    for _, text, lang in rows:
        lang, text = "und" if lang is None else lang, re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            w = re.findall(r"[^\x20\x09]+", piece)
            sizes[lang] += len(w)
            counts.update((lang, *w[i : i + k]) for k in range(1, 5) for i in range(len(w) - k + 1))
    found = {}
    for (lang, *p), a in counts.items():
        if len(p) > 1 and a >= least:
            cuts = [(counts[lang, *p[:k]], counts[lang, *p[k:]]) for k in range(1, len(p))]
            found[lang, *p] = min((2_000_000 * a // (x + y), k, x, y) for k, (x, y) in enumerate(cuts))
    gone = {(lang, *q[i : i + k]) for lang, *q in found for k in range(2, len(q)) for i in range(len(q) - k + 1) if 100 * counts[lang, *q] >= share * counts[lang, *q[i : i + k]]}
    out = []
    for lang in sizes:
        own = [(-s, -counts[key], " ".join(key[1:]).encode(), x, y) for key, (s, _, x, y) in found.items() if key[0] == lang and key not in gone]
        out += [(lang, k + 1, p.decode(), -a, x, y, sizes[lang], -s) for k, (s, a, p, x, y) in enumerate(sorted(own)[:top])]
    return sorted(out)


def corpus(seed):
    rng = random.Random(seed)
    words = [f"{x}{k}" for k in range(12) for x in ("a", "é", "Zz")] + ["the"] * 30 + ["İ", "\xa0", "𝄞"]
    fixed = [[rng.choice(words) for _ in range(rng.choice([2, 3, 4, 6]))] for _ in range(12)]
    rows = []
    for k in range(150):
        own = []
        for _ in range(rng.randrange(12)):
            own += rng.choice(fixed) if rng.random() < 0.6 else [rng.choice(words)]
            own.append(rng.choice(["", "", "", ".", ",\t", "\n", "?!", "\r\n", " : "]))
        rows.append((k, " ".join(own), rng.choice(["en", "en", "fr", None, ""])))
    rows += [(200, None, "en"), (201, "", "de"), (202, " .\n", "de"), (203, "b " * 20_000 + "c", "en"), (203, "one", "it"), *[(300 + k, "Quite. the same words all over again and again", "en") for k in range(40)]]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("seed", "top", "least"), [(1, 5, 3), (3, 2000, 4)])
def test_collocations_against_brute_force(spark, seed, top, least):
    rows = corpus(seed)
    table = spark.createDataFrame(rows, ROWS).repartition(3).selectExpr("*", "1 AS w1", "2 AS a", "'x' AS word", "3 AS rank")
    got = sorted(map(tuple, collocations.collocations(table, top=top, least=least).collect()))
    assert got == [r for r in brute(rows, top, least) if r]
    duck = duckdb.connect()
    duck.register("documents", table.select("doc_id", "text", "lang").toArrow())
    assert sorted(duck.execute(collocations.oracle(top=top, least=least)).fetchall()) == got


def test_growth_is_bounded(spark, monkeypatch):
    asked = []
    count = collocations.count_phrases

    def counted(documents, n, wanted, least, every=False):
        out = count(documents, n, wanted, least, every)
        asked.append((n, out.count()))
        return out

    monkeypatch.setattr(collocations, "count_phrases", counted)
    rows = corpus(5)
    table = spark.createDataFrame(rows, ROWS)
    got = sorted(map(tuple, collocations.collocations(table, top=3, least=2).collect()))
    assert got == brute(rows, 3, 2)
    assert max(n for k, n in asked if k == 3) < len({tuple(w[i : i + 3]) for w in (r[1].split() for r in rows if r[1]) for i in range(len(w) - 2)})


def test_large_counts_are_exact(spark):
    a = 2**53 + 1
    row = spark.createDataFrame([(a, 2**54 + 3)], "a long, of long").select(collocations._share(collocations.F.col("a"), collocations.F.col("of"))).first()
    assert row[0] == 2_000_000 * a // (2**54 + 3)


def test_empty(spark):
    out = collocations.collocations(spark.createDataFrame([], ROWS))
    assert out.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"] and out.count() == 0
