"""Operators against brute force, and nulls, empty and long texts, ties, repeated rows, empty tables, clashing names."""

import itertools
import math
import random
import re
import textwrap
import time
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

from factloom.llm import ann, decontaminate, html_extract, licenses, line_dedup, ngram_join, packing, quality, secrets, url_filter, words

DOCS = "doc_id long, text string"


def shingles(text):
    own = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(own[k : k + 5]) for k in range(len(own) - 4)} if len(own) >= 5 else ({tuple(own)} if own else set())


def corpus(seed, base=12, copies=6):
    rng = random.Random(seed)
    rows = []
    for _ in range(base):
        own = [rng.choice("alpha beta Gamma delta épsilon zeta eta theta iota kappa".split()) + str(rng.randrange(40)) for _ in range(rng.choice([1, 3, 6, 40, 90]))]
        for _ in range(rng.randrange(1, copies)):
            new = list(own)
            for _ in range(rng.randrange(3)):
                new[rng.randrange(len(new))] = f"edit{rng.randrange(99)}"
            rows.append(" ".join(new))
    rows += ["", None, " \t\n", rows[0].upper(), "w " * 30_000]
    rng.shuffle(rows)
    return [(k, t) for k, t in enumerate(rows)]


def brute_components(rows):
    sets = {k: shingles(t) for k, t in rows}
    up = {k: k for k in sets}

    def root(k):
        while up[k] != k:
            k = up[k]
        return k

    links = dict.fromkeys(sets, 0)
    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 80 * len(sets[a] | sets[b]):
            links[a], links[b] = links[a] + 1, links[b] + 1
            x, y = root(a), root(b)
            up[max(x, y)] = min(x, y)
    return {k: (len(sets[k]), root(k), links[k]) for k in sets}


@pytest.mark.parametrize(("block", "short"), [(1_000_000, 16), (60, 2)])
def test_ngram_join_against_brute_force(spark, block, short, monkeypatch):
    monkeypatch.setattr(ngram_join, "GROUP_SHINGLES", block)
    monkeypatch.setattr(ngram_join, "SHORT_LIST", short)
    rows = corpus(block)
    out = ngram_join.similar(spark.createDataFrame(rows, DOCS).repartition(3).selectExpr("*", "1 AS f", "2 AS component"))
    assert {r[0]: tuple(r[1:]) for r in out.collect()} == brute_components(rows)


def test_ngram_join_null_keys_repeats_and_empty(spark):
    rows = [(None, "a b c d e f"), (5, "a b c d e f"), (5, "a b c d e f"), (7, "a b c d e f")]
    out = sorted(map(tuple, ngram_join.similar(spark.createDataFrame(rows, DOCS)).collect()), key=str)
    assert out == [(5, 2, 5, 2), (5, 2, 5, 2), (7, 2, 5, 2), (None, 2, None, 0)]
    assert ngram_join.similar(spark.createDataFrame([], DOCS)).count() == 0


def test_ngram_join_against_brute_force_in_many_small_blocks(spark, monkeypatch):
    for name, value in (("_MEET", 4), ("_FLUSH", 50), ("_STARS", 2), ("_BUCKET_BITS", (1, 1)), ("_SLOTS", 8)):
        monkeypatch.setattr(ngram_join, name, value)
    rows = corpus(61)
    out = ngram_join.similar(spark.createDataFrame(rows, DOCS).repartition(3))
    assert {r[0]: tuple(r[1:]) for r in out.collect()} == brute_components(rows)


def test_ngram_join_blocks_meet_only_where_sizes_fit(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "GROUP_SETS", 4)
    rng = random.Random(63)
    rows = [(k, k % 2, 20 * 3 ** rng.randrange(5) + rng.randrange(12)) for k in range(60)] + [(60, 2, 9), (61, 2, 900)]
    got = ngram_join.dealt_blocks(spark.createDataFrame(rows, "node long, group long, n int"), 80).collect()
    for x, y in itertools.product(got, got):
        if x.group == y.group:
            assert (x.block in y.others) == (y.block in x.others) and x.block in x.others
            if 100 * min(x.n, y.n) >= 80 * max(x.n, y.n):
                assert y.block in x.others
            if x.group < 2 and max(x.n, y.n) > 2 * min(x.n, y.n):
                assert y.block not in x.others
    assert {(x.block, *x.others) for x in got if x.group == 2} == {(0, 0)}
    assert max(len(x.others) for x in got) < 60 // 2 // 4


def stages_after(spark, last=-1):
    found = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
    return {x.stageId(): x.shuffleWriteBytes() for x in map(found.apply, range(found.size())) if x.stageId() > last}


def test_ngram_join_moves_little_and_leaves_no_shuffle_files(spark):
    rng = random.Random(62)
    rows = [(k, " ".join(f"w{rng.randrange(10**6)}" for _ in range(300))) for k in range(4000)]
    rows += [(4000 + k, rows[k][1] + " more") for k in range(40)]
    docs = spark.createDataFrame(rows, DOCS).repartition(4).localCheckpoint()
    files = lambda: {str(p) for p in Path(spark.conf.get("spark.local.dir")).rglob("shuffle_*.data")}
    left, last = files(), max(stages_after(spark))
    out = ngram_join.similar(docs)
    for _ in range(50):
        if not files() - left:
            break
        time.sleep(0.1)
    assert not files() - left
    assert sum(stages_after(spark, last).values()) < sum(len(t) for _, t in rows)
    assert out.where("n_links = 1").count() == 80


def test_divide_skip_finds_every_link():
    rng = np.random.default_rng(1)
    base = np.unique(rng.integers(1, 2**60, 300).astype(np.uint64))
    sets = []
    for _ in range(120):
        drop = rng.random(len(base)) < rng.choice([0, 0.03, 0.1, 0.3])
        sets.append(np.unique(np.concatenate([base[~drop], rng.integers(1, 2**60, rng.integers(0, 40)).astype(np.uint64)])))
    sets.sort(key=len)
    want = {(r, s) for r in range(120) for s in range(r) if 100 * len(np.intersect1d(sets[r], sets[s])) >= 80 * len(np.union1d(sets[r], sets[s]))}
    assert {(r, s) for r, found in ngram_join.divide_skip(sets) for s in found.tolist()} == want and want
    found = {tuple(sorted((60 + r, s), reverse=True)) for r, own in ngram_join.divide_skip(sets[:60], sets[60:]) for s in own.tolist()}
    assert found == {(r, s) for r, s in want if r >= 60 > s}


def test_heap_merge_counts_occurrences():
    rng = random.Random(14)
    for _ in range(200):
        lists = [sorted(rng.sample(range(20), rng.randrange(12))) for _ in range(rng.randrange(8))]
        least = rng.randrange(1, 6)
        counts = {v: sum(v in x for x in lists) for v in range(20)}
        want = [(v, n) for v, n in counts.items() if n >= least]
        assert list(zip(*ngram_join.heap_merge(lists, least), strict=True)) == want


def test_ngram_join_repeated_keys_with_different_texts(spark):
    rng = random.Random(15)
    base = [f"w{k}" for k in range(40)]
    other = base[:]
    other[0] = "x"
    third = other[:]
    third[-1] = "y"
    rows = [(1, " ".join(base)), (1, " ".join(third)), (2, " ".join(other)), (3, " ".join([*third[:-1], "z"])), (4, " ".join(rng.choices(base, k=40)))]
    out = sorted(map(tuple, ngram_join.similar(spark.createDataFrame(rows, DOCS)).collect()))
    links = {k: n for k, _, _, n in out if k > 1}
    assert {(k, c) for k, _, c, _ in out} == {(1, 1), (2, 1), (3, 1), (4, 4)} and links == {2: 3, 3: 3, 4: 0}


def test_ngram_join_bands_keep_every_pair_of_fitting_sizes():
    for percent in (50, 80, 90):
        starts = ngram_join._band_starts(percent)
        for n in range(1, 400):
            for m in range(n, 400):
                gap = np.searchsorted(starts, m, "right") - np.searchsorted(starts, n, "right")
                assert gap <= 1 if 100 * n >= percent * m else gap >= 1


def test_words_and_counts():
    texts = ["A b", None, "", "  x\ty\x0bz ", "É é", "q" * 900, "a b c"]
    column = pa.array(texts)
    assert words.word_counts(column).tolist() == [2, 0, 0, 3, 2, 1, 2]
    assert words.word_counts(column.slice(3, 2)).tolist() == [3, 2]
    sizes = {k: len(s) for k, s in words.shingle_sets(column)}
    assert sizes == {0: 1, 1: 0, 2: 0, 3: 1, 4: 1, 5: 1, 6: 1}


def test_url_filter(spark):
    urls = ["http://A.example.ORG/es/1", "https://x.org/y", "org/", None, "http://org?x", "http://x.com/de/1", "http://x.net/porn", "http://cheap-pills.net/", "http://x.net/cheapest", "ftp://x.net/win#free", "http://example.org.net/es/", "http://com/fr/"]
    rows = [(k, u, "old") for k, u in enumerate(urls)]
    out = {r.page_id: r for r in url_filter.with_verdict(spark.createDataFrame(rows, "page_id int, url string, verdict string")).collect()}
    assert [out[k].rule for k in range(12)] == ["example.org/es/", "org/", None, None, None, "com/de/", None, None, None, None, None, "com/fr/"]
    assert [out[k].verdict[0] for k in range(12)] == list("baaaabbbabaa")
    assert (out[3].host, out[3].path, out[4].host, out[4].path, out[0].host) == ("", "", "org", "", "a.example.org")
    assert url_filter.with_verdict(spark.createDataFrame([], "page_id int, url string")).count() == 0


def test_secrets_against_plain_patterns():
    rng = random.Random(4)
    parts = ["password", "Token", "api_key", "APIKEY", ":", "=", " ", '"', "abc123xyz", "AKIA", "A1B2C3D4E5F6G7H8", "deadbeef" * 3, "0", "é", "\n", "secret"]
    for _ in range(400):
        text = "".join(rng.choice(parts) for _ in range(25))
        want = [("assign", m.start(), m.end()) for m in secrets.ASSIGN.finditer(text) if len(m[2]) >= 6]
        want += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
        want += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
        assert [s for s in secrets.spans(text) if s[0] in secrets.BASE_KINDS] == sorted(want, key=lambda s: (s[1], secrets.KINDS.index(s[0])))


def test_secrets_checksum_and_edges(spark):
    body = "Zq" * 15
    good = f"ghp_{body}{secrets.checksum(body)}"
    bad = good[:-1] + ("0" if good[-1] != "0" else "1")
    rows = [(1, good), (2, bad), (3, None), (4, ""), (None, "token=abcdefgh"), (1, good)]
    docs = spark.createDataFrame(rows, DOCS).selectExpr("*", "'x' AS spans")
    out = [tuple(r)[:4] + (r.spans,) for r in secrets.secret_digest(docs).collect()]
    assert out == [(1, 0, 0, 0, "github:0:40"), (2, 0, 0, 0, ""), (3, 0, 0, 0, ""), (4, 0, 0, 0, ""), (None, 1, 0, 0, "assign:0:14"), (1, 0, 0, 0, "github:0:40")]
    assert secrets.secret_spans(docs).count() == 3
    assert secrets.secret_digest(docs.limit(0)).count() == 0


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (None, ""),
        ("", ""),
        ("just words", "just words"),
        ("<body><nav>menu</nav><article><h1>T &amp; U</h1><p>One\n two<p>Three<br>four</article><footer>f</footer>", "T & U\nOne two\nThree four"),
        ("<body><div><p>aaa bbb ccc ddd</p><p>eee fff ggg</p></div><div class='sidebar'>x y z</div><section id=comments><p>me too me too me too</p></section></body>", "aaa bbb ccc ddd\neee fff ggg"),
        ("<body><header>h</header><main><header><h1>Head</h1></header><p>long text here, much of it</p><form>f</form><script>s('</p>')</script></main></body>", "Head\nlong text here, much of it"),
        ("<p>unclosed <b>bold <p>next &lt;tag&gt;", "unclosed bold\nnext <tag>"),
        ("<body><div class='cookie-notice'>we use</div><p>" + "word " * 5000 + "</p></body>", ("word " * 5000).strip()),
    ],
)
def test_html_main_text(page, want):
    assert html_extract.main_text(page) == want


def test_html_rows(spark):
    rows = [(1, "u", "<p>a</p>", "x"), (1, "u", "<p>a</p>", "x"), (None, None, None, None)]
    out = html_extract.with_main_text(spark.createDataFrame(rows, "page_id long, url string, html string, text string"))
    assert sorted(map(tuple, out.collect()), key=str) == [(1, "u", "a", 1), (1, "u", "a", 1), (None, None, "", 0)]
    assert html_extract.with_main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_quality_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit(docs, labels)
    out = quality.with_score(docs.unionByName(docs.limit(1).selectExpr("-1L AS doc_id", "CAST(NULL AS string) AS text", "lang", "source", "n_chars")), model)
    rows = out.where(quality.held_out(out.doc_id)).join(labels, "doc_id").select("quality", "score", "predicted").collect()
    good, bad = [r.score for r in rows if r.quality == 1], [r.score for r in rows if r.quality == 0]
    assert np.mean([g > b for g in good for b in bad]) > 0.95
    assert sum(r.predicted == r.quality for r in rows) / len(rows) > 0.95
    assert out.where("doc_id = -1").first().score == pytest.approx(model.prior)
    assert out.where("score < 0 OR score > 1 OR score IS NULL").count() == 0


def test_quality_votes_are_exact():
    rng = np.random.default_rng(0)
    counts = rng.poisson(1, (300, quality.TERMS))
    labels = rng.integers(0, 2, 300).astype(float)
    model = quality.model_of(counts[:200], labels[:200], (counts > 0).sum(0), 300)
    near = model.embed(counts[200:]) @ model.vectors.T
    for row, score in zip(near, model.scores(counts[200:]), strict=True):
        top = np.argsort(-row)[: quality.NEIGHBOURS]
        votes = np.maximum(row[top], 0).astype(float) ** quality.SHARPNESS
        assert score == pytest.approx((votes * labels[top]).sum() / votes.sum())


def test_quality_without_labels_or_rows(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], DOCS)
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in quality.with_score(docs, quality.fit(docs, none)).collect()} == {0.5}
    assert quality.with_score(docs.limit(0), quality.fit(docs.limit(0), none)).count() == 0


def test_packing(spark):
    rng = random.Random(2)
    rows = [(k, " ".join(["w"] * rng.choice([0, 1, 5, 200, 900, 2048, 2049, 9000]))) for k in range(300)] + [(None, None), (7, "x y"), (7, "x y")]
    out = packing.packed(spark.createDataFrame(rows, DOCS).selectExpr("*", "0 AS bin"), block_rows=100).collect()
    want = sum(len(t.split()) for _, t in rows if t)
    assert sum(r.n_words for r in out) == want and {r.doc_id for r in out} == {k for k, _ in rows}
    bins = {}
    for r in out:
        assert (r.bin is None) == (r.n_words == 0)
        if r.bin is not None:
            bins.setdefault(r.bin, []).append(r)
    for own in bins.values():
        own.sort(key=lambda r: r.offset)
        ends = [r.offset + r.n_words for r in own]
        assert [r.offset for r in own] == [0, *ends[:-1]]
        size = own[0].capacity
        assert {r.capacity for r in own} == {size} and ends[-1] <= size
        assert size == min(packing.CAPACITIES) or ends[-1] > max(c for c in packing.CAPACITIES if c < size)
    pieces = {}
    for r in out:
        if r.doc_id != 7:
            pieces.setdefault(r.doc_id, []).append(r)
    for own in pieces.values():
        own.sort(key=lambda r: r.piece)
        assert [r.start for r in own] == [2048 * k for k in range(len(own))]
    assert packing.packed(spark.createDataFrame([], DOCS)).count() == 0


def brute_best_fit(lengths, opened):
    """Contents of the bins of a plain best fit, where ``opened`` gives a new bin's size."""
    room, fill, since = [], [], []
    for step, length in enumerate(sorted(lengths, reverse=True)):
        fits = [k for k, r in enumerate(room) if r >= length]
        if fits:
            own = min(fits, key=lambda k: (room[k], -since[k]))
        else:
            own = len(room)
            room.append(opened(length))
            fill.append(0)
            since.append(step)
        room[own], fill[own], since[own] = room[own] - length, fill[own] + length, step
    return sorted(fill)


def cost_of_bins(fill):
    return sum(packing.cost_of(min(c for c in packing.CAPACITIES if c >= f)) for f in fill)


def least_cost(lengths):
    """Cost of the best packing of all, over every way to part the lengths."""
    best = math.inf

    def place(rest, bins):
        nonlocal best
        if not rest:
            best = min(best, cost_of_bins(bins))
            return
        for k in range(len(bins)):
            if bins[k] + rest[0] <= max(packing.CAPACITIES):
                place(rest[1:], [*bins[:k], bins[k] + rest[0], *bins[k + 1 :]])
        place(rest[1:], [*bins, rest[0]])

    place(sorted(lengths, reverse=True), [])
    return best


def test_best_fit_against_brute_force():
    rng = random.Random(3)
    cheap = lambda n: min((c for c in packing.CAPACITIES if c >= n), key=lambda c: (packing.cost_of(c) / c, c))
    fixed = lambda n: cheap(min(c for c in packing.CAPACITIES if c >= n))
    lower = 0
    for n in range(60):
        lengths = [rng.choice([rng.randrange(1, 2049), rng.randrange(1, 300), rng.choice([700, 900, 1100])]) for _ in range(rng.choice([5, 60, 200]))]
        for sizes in ((2048,), (256, 512, 1024, 2048), (512, 2048)):
            opened = lambda length, *_, sizes=sizes: min(c for c in sizes if c >= length)
            assert sorted(packing.best_fit(lengths, opened)[2]) == brute_best_fit(lengths, opened)
        bins, offsets, sizes = packing.pack(lengths)
        fill = [0] * len(sizes)
        for own, length in zip(bins, lengths, strict=True):
            fill[own] += length
        assert sizes == [min(c for c in packing.CAPACITIES if c >= f) for f in fill]
        own, table = cost_of_bins(fill), cost_of_bins(brute_best_fit(lengths, fixed))
        assert own <= table + 1e-9
        lower += own < table - 1e-9
    assert lower > 10


def test_packing_is_near_the_best_of_all_on_small_inputs():
    rng = random.Random(5)
    ours = best = 0
    for _ in range(40):
        lengths = [rng.randrange(50, 1500) for _ in range(7)]
        found = sum(packing.cost_of(c) for c in packing.pack(lengths)[2])
        least = least_cost(lengths)
        assert least - 1e-9 <= found <= 1.25 * least
        ours, best = ours + found, best + least
    assert ours <= 1.03 * best
    assert packing.pack([]) == ([], [], [])


def test_packing_does_not_depend_on_splits_and_spreads_copies(spark):
    rows = [(k % 40, " ".join(["w"] * (k % 700))) for k in range(400)] + [(7, "x y")] * 200 + [(None, "z " * 30)] * 100
    docs = spark.createDataFrame(rows, DOCS)
    one, two = (sorted(map(tuple, packing.packed(d, block_rows=50).collect()), key=str) for d in (docs.coalesce(1), docs.repartition(7)))
    assert one == two
    blocks = {}
    for r in one:
        if r[0] == 7 and r[3] == 2:
            blocks[r[4] >> 32] = blocks.get(r[4] >> 32, 0) + 1
    assert sum(blocks.values()) >= 200 and max(blocks.values()) < 60


def test_quality_ties_long_texts_and_clashing_names(spark):
    rng = np.random.default_rng(2)
    counts = np.repeat(rng.poisson(1, (10, quality.TERMS)), 40, 0)
    labels = np.tile([1.0, 0.0, 0.0, 0.0], 100)
    model = quality.model_of(counts, labels, (counts > 0).sum(0), 400)
    order = rng.permutation(400)
    other = quality.model_of(counts[order], labels[order], (counts > 0).sum(0), 400)
    assert model.scores(counts[::40]) == pytest.approx([0.25] * 10) and other.scores(counts[::40]) == pytest.approx([0.25] * 10)
    texts = [f"text number {k} with words of its own" for k in range(7)] + ["long " * 200_000, "long " * 200_000]
    docs = spark.createDataFrame([(k, t, 9.0, "old") for k, t in enumerate(texts * 2)], "doc_id long, text string, score double, predicted string").repartition(5)
    labels = spark.createDataFrame([(k, k % 2) for k in range(18)], "doc_id long, quality int")
    model = quality.fit(docs, labels)
    out = quality.with_score(docs, model)
    assert dict(out.dtypes)["predicted"] == "int" and out.count() == 18
    scores = {}
    for r in out.collect():
        scores.setdefault(r.text, set()).add(r.score)
    assert all(len(v) == 1 for v in scores.values())
    long = next(quality.term_counts(pa.array(["long " * 200_000])))
    assert long.max() > 65_535
    repeated = docs.unionByName(docs).unionByName(docs)
    assert len(quality.fit(repeated, labels, max_labelled=5).labels) == 5


def brute_deleted(rows):
    """Every document against every earlier one: all runs of enough words that both hold."""
    clean = [(k, [" ".join(re.findall(r"[^\x20\x09-\x0D]+", x)).lower() for x in t.split("\n")]) for k, t in rows if k is not None and t is not None]
    out = {}
    for n, (k, own) in enumerate(clean):
        gone, words = set(), [len(x.split()) for x in own]
        for _, other in clean[:n]:
            if not {x for x in own if x}.isdisjoint(other):
                gone.update(runs_in_both(own, other, words))
        out[k] = sorted(gone)
    return out


def test_line_dedup_against_brute_force(spark):
    rng = random.Random(6)
    lines = [" ".join(f"w{rng.randrange(60)}" for _ in range(rng.choice([1, 4, 6, 12, 60]))) for _ in range(25)]
    rows = [(k, "\n".join(rng.choice(lines) if rng.random() < 0.5 else f"own {k} {n} line here" for n in range(rng.randrange(1, 12)))) for k in range(60)]
    rows += [(60, None), (61, ""), (None, lines[0])]
    docs = spark.createDataFrame(rows, DOCS)
    want = brute_deleted(rows)
    found = {r.doc_id: sorted(r.places) for r in line_dedup.deleted_lines(docs).collect()}
    assert found == {k: v for k, v in want.items() if v} and found
    out = line_dedup.without_common_lines(docs.selectExpr("*", "'y' AS n_lines", "3 AS places"))
    assert out.columns == ["doc_id", "text", "places", "n_lines", "n_deleted"]
    for r in out.collect():
        text = dict(rows)[r.doc_id]
        gone = set(want.get(r.doc_id, []))
        assert r.n_deleted == len(gone)
        assert r.text == (text if not gone else "\n".join(x for n, x in enumerate(text.split("\n")) if n not in gone))
    assert line_dedup.without_common_lines(docs.limit(0)).count() == 0


def test_line_dedup_takes_passages_from_later_copies_only(spark):
    passage = " ".join(f"p{k}" for k in range(55))
    rows = [(3, f"start one\n{passage}\nend"), (1, f"{passage}\nfirst"), (2, "clean words of its own\nand more of them here"), (4, passage), (4, passage)]
    out = sorted((r.doc_id, r.text) for r in line_dedup.without_common_lines(spark.createDataFrame(rows, DOCS)).collect())
    assert out == [(1, f"{passage}\nfirst"), (2, rows[2][1]), (3, "start one\nend"), (4, ""), (4, "")]


def test_patience_aligns_in_order():
    rng = random.Random(8)
    for _ in range(200):
        a, b = ([rng.randrange(12) for _ in range(rng.randrange(14))] for _ in range(2))
        pairs = line_dedup.patience(a, b)
        assert all(a[i] == b[j] for i, j in pairs)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in itertools.pairwise(pairs))
    assert line_dedup.patience("abcdxyz", "qabcxrz") == [(0, 1), (1, 2), (2, 3), (4, 4), (6, 6)]


def edit_distance_in(window, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(window, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j - 1] + (c != d), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


@pytest.mark.parametrize("hits", [4_000_000, 300])
def test_decontamination_against_brute_force(hits, monkeypatch):
    monkeypatch.setattr(decontaminate, "_HITS", hits)
    rng = random.Random(9)
    letters = "abcdefghij "
    norm = lambda t: "".join(map(chr, decontaminate.normalised([t])[0]))
    items = [(k, "z" + "".join(rng.choice(letters) for _ in range(n - 2)) + "z") for k, n in enumerate((6, 9, 12, 25, 40, 90, 150, 200, 260, 390))]
    index = decontaminate.index_of(items, shortest=1)
    texts = []
    for _ in range(45):
        item = list(rng.choice(items)[1])
        for _ in range(rng.choice([0, 0, 1, 2, 4, 9, 16])):
            p = rng.randrange(len(item))
            item[p : p + 1] = rng.choice([[], ["k"], [item[p], "m"]])
        glue = rng.choice([" ", " ", "q"])
        texts.append("".join(rng.choice(letters) for _ in range(rng.randrange(40))) + glue + "".join(item).upper() + glue + "!!" + "".join(rng.choice(letters) for _ in range(30)))
    texts += [f"x {t}! y" for _, t in items] + [" ".join(texts[-12:])]
    found = {(t, index.items[k]): (texts[t][a:b], d) for t, k, a, b, d in decontaminate.matches(texts, index)}
    windows = {k: [norm(t)] if len(norm(t)) < decontaminate.Q else ["".join(map(chr, c)) for c, o in zip(index.codes, index.owner, strict=True) if o == k] for k, t in items}
    want = set()
    for t, text in enumerate(map(norm, texts)):
        for k, own in windows.items():
            if len(own[0]) < decontaminate.LEAST:
                want |= {(t, k)} if f" {own[0]} " in f" {text} " else set()
            elif any(edit_distance_in(w, text) <= int(len(w) * decontaminate.EDITS) for w in own):
                want.add((t, k))
    assert set(found) == want and len(want) > 25 and {k for _, k in want} == set(windows)
    for (_, k), (stretch, edits) in found.items():
        assert any(edit_distance_in(w.strip(), norm(stretch)) <= edits and abs(len(norm(stretch)) - len(w.strip())) <= edits + 2 for w in windows[k])


def test_decontamination_normal_form():
    text = "日本。語　テスト 😀 Ab-C"
    assert "".join(map(chr, decontaminate.normalised([text])[0])) == "日本 語 テスト ab c"
    assert decontaminate.matches(["a" * 60_000], decontaminate.index_of([(1, "a" * 400)]))[0][:2] == (0, 0)


def test_decontamination_rows(spark, monkeypatch):
    item = "the quick brown fox jumps over the lazy dog and runs away from all of it"
    docs = spark.createDataFrame([(1, f"é: {item.upper()}. x"), (2, None), (3, ""), (None, item), (1, f"é: {item.upper()}. x"), (4, "clean " * 3000)], DOCS)
    bench = spark.createDataFrame([(8, item), (9, None), (10, "short"), (11, item[::-1])], "item_id int, text string")
    for chars in (2_000_000, 80):
        monkeypatch.setattr(decontaminate, "BLOCK_CHARS", chars)
        out = sorted(map(tuple, decontaminate.contaminated(docs, bench).collect()), key=str)
        assert out == [(1, 8, 3, 3 + len(item), 0), (1, 8, 3, 3 + len(item), 0), (None, 8, 0, len(item), 0)]
        assert docs.where(~decontaminate.is_contaminated(docs, bench)).count() == 3
    assert decontaminate.contaminated(docs, bench.limit(0)).count() == 0
    assert decontaminate.contaminated(docs.limit(0), bench).count() == 0


def test_ann_recall_and_scores(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 16))
    rows = np.concatenate([centres[rng.integers(0, 12, 3000)] + rng.normal(scale=0.3, size=(3000, 16)), np.repeat(centres[:1], 1500, 0)])
    table = [(k, v.tolist(), 0.5) for k, v in enumerate(rows)] + [(9001, None, 0.0), (9002, [0.0] * 16, 0.0), (9003, [float("nan")] * 16, 0.0), (None, [1.0] * 16, 0.0)]
    vectors = spark.createDataFrame(table, "vec_id long, embedding array<double>, score double").repartition(4)
    out = ann.neighbours(vectors, vectors.where("vec_id % 100 = 0")).collect()
    got = {}
    for r in sorted(out, key=lambda r: (r.query_id, r["rank"])):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert set(got) == set(range(0, 4500, 100))
    found = total = 0
    for q, near in got.items():
        gaps = np.sqrt(((rows - rows[q]) ** 2).sum(1))
        order = [k for k in np.lexsort((np.arange(len(rows)), gaps)) if k != q][:10]
        assert [v for _, v in near] == pytest.approx([gaps[k] for k, _ in near]) and near == sorted(near, key=lambda x: (x[1], x[0]))
        found, total = found + len({k for k, _ in near} & set(order)), total + 10
    assert found / total >= 0.9


def test_ann_few_rows(spark):
    vectors = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, [1.0, 1.0]), (3, None)], "vec_id long, embedding array<double>")
    out = sorted(map(tuple, ann.neighbours(vectors, vectors.where("vec_id < 2")).collect()))
    assert out == [(0, 1, 1, 1.0), (0, 2, 2, 1.0), (1, 1, 2, 0.0), (1, 2, 0, 1.0)]
    assert ann.neighbours(vectors.limit(0), vectors.limit(0)).count() == 0


def test_licenses(spark):
    mit = "MIT License\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
    rows = [(1, "x.\nReleased under the MIT License."), (2, None), (3, ""), (4, mit + "\nLicensed under the Apache License, Version 2.0. Bye."), (5, "nothing " * 20_000), (1, "x.\nReleased under the MIT License.")]
    docs = spark.createDataFrame(rows, DOCS).selectExpr("*", "1 AS licenses")
    out = [(r.doc_id, r.sentence_ids, r.licenses) for r in licenses.with_licenses(docs).collect()]
    assert out[0] == out[5] == (1, ["MitRef"], ["MIT"]) and out[1:3] == [(2, [], []), (3, [], [])] and out[4] == (5, [], [])
    assert out[3] == (4, ["MitTitle", "MitGrant", "MitNotice", "Apache2Ref"], ["MIT", "Apache-2.0"])
    assert licenses.with_licenses(docs.limit(0)).count() == 0


def test_wrapped_licenses(spark):
    mit = "MIT License\n\nCopyright (c) 2020 Someone\n\n" + textwrap.fill(licenses_text("MitGrant"), 70) + ":\n\n" + textwrap.fill(licenses_text("MitNotice"), 72) + ".\n\n" + textwrap.fill(licenses_text("AsIsMit"), 75) + "."
    gpl = " * This program is free software: you can redistribute it and/or modify\n * it under the terms of the GNU General Public License as published by\n * the Free Software Foundation, either version 3 of the License, or\n * (at your option) any later version.\n *\n * This program is distributed in the hope that it will be useful,\n * but WITHOUT ANY WARRANTY; without even the implied warranty"
    mpl = "This Source Code Form is subject to the terms of the Mozilla\r\nPublic License, v. 2.0. If a copy"
    apache = "Copyright 2020 Someone\nLicensed under the Apache License, Version 2.0 (the \"License\");\nyou may not use this file except\nin compliance with the License."
    texts = [mit, gpl, mpl, apache, "x y\nLicensed under CC BY-NC 4.0.\nz", "Released under the MIT License.", "the mit\n\nlicense", "not the mit license here", "Released under CC0 1.0", None, ""]
    out = [tuple(r) for r in licenses.with_wrapped_licenses(spark.createDataFrame(list(enumerate(texts)), DOCS).coalesce(1)).select("sentence_ids", "licenses").collect()]
    assert out == [
        (["MitTitle", "MitGrant", "MitNotice", "AsIsMit"], ["MIT"]),
        (["FreeSoftware", "Gpl3PlusTerms", "GplHope"], ["GPL-3.0-or-later"]),
        (["Mpl2Ref"], ["MPL-2.0"]),
        (["Apache2Ref", "ApacheComply"], ["Apache-2.0"]),
        (["CcByNc4Ref"], ["CC-BY-NC-4.0"]),
        (["MitRef"], ["MIT"]),
        ([], []),
        ([], []),
        (["Cc0Ref"], ["CC0-1.0"]),
        ([], []),
        ([], []),
    ]


def licenses_text(identifier):
    return next(s for s, i in licenses.SENTENCES.items() if i == identifier)


def test_wrapped_licenses_keep_what_single_lines_give(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    one = {r.doc_id: set(r.licenses) for r in licenses.with_licenses(docs).collect()}
    more = {r.doc_id: set(r.licenses) for r in licenses.with_wrapped_licenses(docs).collect()}
    assert all(own <= more[k] for k, own in one.items())


def runs_in_both(later, earlier, words):
    """Places of every run of enough words, by comparing all pairs of places."""
    gone = set()
    for i, j in itertools.product(range(len(later)), range(len(earlier))):
        n = 0
        while i + n < len(later) and j + n < len(earlier) and later[i + n] == earlier[j + n]:
            n += 1
        if sum(words[i : i + n]) >= line_dedup.BLOCK_WORDS:
            gone.update(range(i, i + n))
    return sorted(gone)


def test_line_dedup_finds_runs_without_unique_lines():
    assert line_dedup.common_lines("xPyPz", "uPv", [1, 60, 1, 60, 1]) == [1, 3]
    assert line_dedup.common_lines("xPQyPQz", "uPQvPQw", [1, 6, 6, 1, 6, 6, 1]) == [1, 2, 4, 5]
    rng = random.Random(10)
    for _ in range(300):
        later, earlier = ([rng.randrange(5) for _ in range(rng.randrange(14))] for _ in range(2))
        words = [1 + 3 * k for k in later]
        assert line_dedup.common_lines(later, earlier, words) == runs_in_both(later, earlier, words)


@pytest.mark.parametrize("seed", range(3))
def test_line_dedup_against_every_earlier_document(spark, seed):
    rng = random.Random(seed)
    lines = [" ".join(f"w{rng.randrange(60)}" for _ in range(rng.choice([0, 0, 1, 2, 3, 4, 5, 6, 9, 12]))) for _ in range(14)]
    rows = [(1, "a b c d e f g h i\nx1"), (2, "x2\nk l m n o"), (3, "y\na b c d e f g h i\nk l m n o\nz"), (4, "a b c d e f g h i\nk l m n o\nq")]
    rows += [(k, "\n".join(rng.choice(lines) if rng.random() < 0.8 else f"own {k} {n}" for n in range(rng.randrange(1, 9)))) for k in range(5, 90)]
    want = {k: gone for k, gone in brute_deleted(rows).items() if gone}
    found = {r.doc_id: sorted(r.places) for r in line_dedup.deleted_lines(spark.createDataFrame(rows, DOCS).repartition(3)).collect()}
    assert found == want and found[4] == [0, 1]


def test_line_dedup_partners_beyond_the_first_holder_and_blank_lines(spark):
    a, b = "one two three four five six", "seven eight nine ten eleven twelve"
    verse = "rose red\nsky blue\n\nsea deep\nsand white\nsun high"
    rows = [(1, f"{a}\nx"), (2, f"{b}\ny"), (3, f"z\n{a}\n{b}"), (4, f"{a}\n{b}\nq"), (5, f"{a}\n\n\n\n\nown"), (6, f"{a}\n\n\n\n\nmine"), (7, verse), (8, f"head\n{verse}"), (9, "One  two\tthree four FIVE six\r\n" + b)]
    found = {r.doc_id: sorted(r.places) for r in line_dedup.deleted_lines(spark.createDataFrame(rows, DOCS)).collect()}
    assert found == {4: [0, 1], 8: [1, 2, 3, 4, 5, 6], 9: [0, 1]}


def test_decontamination_finds_excerpts_at_every_offset():
    rng = random.Random(11)
    items = [(k, "".join(rng.choice("abcdefghij ") for _ in range(n)).replace("  ", "xy").strip()) for k, n in enumerate((100, 233, 390))]
    index = decontaminate.index_of(items, excerpts=True)
    least = decontaminate.EXCERPT + decontaminate.EXCERPT_STEP - 1
    for k, item in items:
        texts = [f"1 2 3 4 5 {item[s : s + least + 2]} 6 7 8 9" for s in range(len(item) - least - 1)]
        assert {t for t, found, *_ in decontaminate.matches(texts, index) if found == k} == set(range(len(texts)))
    whole = [item for _, item in items]
    assert decontaminate.matches(whole, index) == decontaminate.matches(whole, decontaminate.index_of(items))


def plain_density(node, share):
    """Composite text density of an element from all that lies under it, by its definition."""
    under, stack = [], [(p, node.tag == "a") for p in node.parts]
    chars = links = tags = link_tags = 0
    while stack:
        part, in_link = stack.pop()
        under.append(part)
        if isinstance(part, str):
            chars, links = chars + len(part.strip()), links + in_link * len(part.strip())
        elif not part.dropped:
            tags, link_tags = tags + 1, link_tags + (part.tag == "a" or in_link)
            stack += [(p, in_link or part.tag == "a") for p in part.parts]
    if not chars:
        return 0.0, chars, links
    base = math.log(chars / max(chars - links, 1) * links + share * chars + math.e)
    return chars / max(tags, 1) * max(math.log(chars / max(links, 1) * max(tags, 1) / max(link_tags, 1)) / base, 0.0), chars, links


def random_page(rng, depth=0):
    out = ""
    for _ in range(rng.randrange(1, 4)):
        tag = rng.choice(["div", "section", "b", "i", "a", "text", "text"]) if depth < 5 else "text"
        inside = "word " * rng.randrange(1, 30) if tag == "text" else random_page(rng, depth + 1)
        out += inside if tag == "text" else f"<{tag}>{inside}</{tag}>"
    return out


def test_html_densities_against_brute_force():
    rng = random.Random(12)
    for _ in range(60):
        root = html_extract.parse(f"<body>{random_page(rng)}</body>")
        order = html_extract.densities(root)
        body = next(n for n in order if n.tag == "body")
        _, chars, links = plain_density(body, 0)
        share, sums = (links / chars if chars else 0.0), {}
        for node in order:
            assert node.density == pytest.approx(plain_density(node, share)[0])
            sums[id(node)] = sum(plain_density(p, share)[0] for p in node.parts if not isinstance(p, str))
            assert node.total == pytest.approx(sums[id(node)])
        assert body.best.total == pytest.approx(max(v for k, v in sums.items() if k != id(root)))


def test_html_density_decides():
    text = "word " * 60
    teaser = "<article><h2><a href=x>Another title</a></h2><p>Tease <a href=x>more</a></p></article>"
    assert html_extract.main_text(f"<body><article><h1>T</h1><p>{text}</p></article>{teaser}</body>") == f"T\n{text.strip()}"
    assert html_extract.main_text(f"<body><div class='post ad-free'><h1>T</h1><p>{text}</p><div class=ad>buy</div></div>x</body>") == f"T\n{text.strip()}"
    assert html_extract.main_text(f"<body><div class=comments><p>{text * 20}</p></div><article><p>short</p></article></body>") == "short"
    parts = f"<section><p>{text}</p><p>{text}</p></section><section><p>Short.</p></section><section><p>{text}</p></section>"
    wide = f"<body><div><a href=/>Logo</a></div><div><h1>T</h1>{parts}<ul><li><a>one</a><li><a>two</a><li><a>three</a></ul></div><div>Copyright</div></body>"
    assert html_extract.main_text(wide) == "\n".join(["T", text.strip(), text.strip(), "Short.", text.strip()])
    assert html_extract.main_text("<p title=don't>first</p><p class='x>second para is kept</p>") == "first\nsecond para is kept"


@pytest.mark.parametrize("page", ['<a "' * 250_000, "<b>" * 100_000 + "</x>" * 100_000, "<b><div>" + "<i>" * 100_000 + "</b>" * 100_000, "<!x" * 300_000, "<a x='" * 100_000 + '<a y="' * 50_000, "<a" + " " * 1_000_000, "<div class=ad>" * 70_000, "<p>a" * 200_000])
def test_html_hostile_pages_take_linear_time(page):
    began = time.process_time()
    html_extract.main_text(page)
    assert time.process_time() - began < 8


def test_secrets_private_keys_of_any_length():
    body = "\n".join("Ab1+" * 16 for _ in range(3000))
    whole = f"-----BEGIN RSA PRIVATE KEY-----\n{body}\n-----END RSA PRIVATE KEY-----"
    open_ended = f"-----BEGIN PRIVATE KEY-----\r\n{'Cd2/' * 16}\r\nEf3=\r\n"
    text = f"é {whole} then {open_ended} and words\n{whole}\n-----END EC PRIVATE KEY----- -----BEGIN CERTIFICATE-----"
    want = [(text.index(whole), text.index(whole) + len(whole)), (text.index(open_ended), text.index(open_ended) + len(open_ended.rstrip())), (text.rindex(whole), text.rindex(whole) + len(whole))]
    assert [s[1:] for s in secrets.spans(text) if s[0] == "pem"] == want
    began = time.process_time()
    assert len([s for s in secrets.spans("-----BEGIN PRIVATE KEY-----\n" * 20_000) if s[0] == "pem"]) == 20_000
    assert time.process_time() - began < 5


def test_secrets_checked_tokens_against_a_plain_pattern():
    rng = random.Random(13)
    for _ in range(300):
        parts = []
        for _ in range(6):
            body = "".join(rng.choice(secrets.BASE62) for _ in range(30))
            tail = secrets.checksum(body) if rng.random() < 0.6 else "".join(rng.choice(secrets.BASE62) for _ in range(6))
            parts.append(rng.choice(list(secrets.CHECKED)) + body + tail + rng.choice(["", " ", "x", "_", "é"]))
        text = rng.choice(["", " ", "q"]).join(parts)
        plain = re.compile("(?<![0-9A-Za-z])(" + "|".join(secrets.CHECKED) + r")([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z])")
        want = [(secrets.CHECKED[m[1]], m.start(), m.end()) for m in plain.finditer(text) if secrets.checksum(m[2]) == m[3] and not (m.start() and text[m.start() - 1].isalnum())]
        assert [s for s in secrets.spans(text) if s[0] in ("github", "npm")] == want


def test_url_vocabulary_from_text_and_table_with_weights(spark):
    assert url_filter.parse_vocabulary("# x\n\nPorn\t1\nads\t0.25\nads\t0.5\n") == {"porn": 1.0, "ads": 0.5}
    table = spark.createDataFrame([("Ads", 0.5), ("bet", 0.2), ("win", 0.4), ("bad", 2.0), (None, 1.0)], "term string, weight double")
    own = url_filter.vocabulary_of(table)
    urls = ["http://x.net/ads-bet", "http://x.net/ads-bet-win", "http://x.net/bad", "http://x.net/ads/ads/ads", "http://x.net/" + "a/" * 200_000 + "bad", None, ""]
    rows = spark.createDataFrame(list(enumerate(urls * 2)), "page_id int, url string")
    out = [r.verdict for r in url_filter.with_verdict(rows.coalesce(1), vocabulary=own).orderBy("page_id").collect()]
    assert out == ["allow", "block", "block", "allow", "block", "allow", "allow"] * 2
    assert {r.verdict for r in url_filter.with_verdict(rows, vocabulary={}).collect()} == {"allow"}
    with pytest.raises(ValueError):
        url_filter.vocabulary_of(table, most=3)
