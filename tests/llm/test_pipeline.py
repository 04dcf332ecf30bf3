"""Each pipeline stage, and the whole run, against brute force on the smallest tables."""

import pytest
from test_operators import brute_components, brute_deleted

import corpus_pipeline
from factloom.llm import decontaminate, quality

COLUMNS = list(corpus_pipeline.COLUMNS)


@pytest.fixture(scope="module")
def steps(spark, sf_dir, tmp_path_factory):
    folder = tmp_path_factory.mktemp("stages")
    docs = [spark.read.parquet(f"{sf_dir}/documents.parquet")]
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs[-1], sf_dir).write.parquet(str(folder / str(n)))
        docs.append(spark.read.parquet(str(folder / str(n))))
    return docs


def texts(df):
    return sorted((r.doc_id, r.text) for r in df.collect())


def test_columns_and_clean_rows(steps):
    assert all(d.columns == COLUMNS for d in steps[:5])
    assert all(0.5 * a.count() < b.count() <= a.count() for a, b in zip(steps[:4], steps[1:5], strict=True))


def test_quality_stage(spark, sf_dir, steps):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = quality.with_score(steps[0], quality.fit(steps[0], labels))
    assert texts(steps[1]) == texts(scored.where("score >= 0.3"))


def test_line_stage(steps):
    before = texts(steps[1])
    gone = brute_deleted(before)
    want = []
    for k, text in before:
        new = "\n".join(x for n, x in enumerate(text.split("\n")) if n not in gone[k]) if gone[k] else text
        if not (gone[k] and not new.strip(" ")):
            want.append((k, new))
    assert texts(steps[2]) == want


def test_near_copy_stage(steps):
    rows = texts(steps[2])
    found = brute_components(rows)
    assert texts(steps[3]) == [(k, t) for k, t in rows if found[k][1] == k]


def test_leak_stage(spark, sf_dir, steps):
    norm = lambda t: "".join(map(chr, decontaminate.normalised([t])[0]))
    items = [norm(r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    whole = {k for k, t in texts(steps[3]) if any(len(i) >= decontaminate.LEAST and i in norm(t) for i in items)}
    kept = {k for k, _ in texts(steps[4])}
    assert not whole & kept and whole
    others = {k for k, t in texts(steps[3]) if k not in kept and k not in whole}
    assert all(any(i[a : a + 60] in norm(dict(texts(steps[3]))[k]) for i in items for a in range(0, len(i), 20)) for k in others)


def test_packing_stage_and_run(spark, sf_dir, steps):
    words = {k: len(t.split()) for k, t in texts(steps[4])}
    found = {}
    for r in steps[5].collect():
        found[r.doc_id] = found.get(r.doc_id, 0) + r.n_words
    assert found == words
    run = corpus_pipeline.run(spark, sf_dir)
    assert run.columns == steps[5].columns and {r.doc_id for r in run.select("doc_id").collect()} == set(words)


def test_stages_take_nulls_empty_and_repeated_rows_and_other_columns(spark, sf_dir):
    good = spark.read.parquet(f"{sf_dir}/documents.parquet").where("lang = 'en' AND n_chars BETWEEN 400 AND 4000").orderBy("doc_id").limit(12).collect()
    rows = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in good]
    rows += [(None, rows[0][1], "en", None, None), (9001, None, None, None, None), (9002, "", "en", "s", 0), rows[3], (9003, "a b\n\n" * 3, None, "s", 12)]
    extra = ", ".join(f"'x' AS {c}" for c in ("score", "predicted", "n_lines", "component", "bin", "capacity", "item_id", "_places", "node"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", *extra.split(", "))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        assert stage(spark, docs.limit(0), sf_dir).count() == 0, name
        if name != "best-fit packing":
            assert out.columns == COLUMNS
            found = sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in out.collect())
            assert set(found) <= {(k is None, k or 0, t or "") for k, t, *_ in rows} | set(found) and len(found) <= len(rows), name
            assert (True, 0, rows[0][1]) in found or name == "quality classifier", name
        else:
            assert sum(r.n_words for r in out.collect()) == sum(len((t or "").split()) for _, t, *_ in rows)
