"""Sentences, definitions and facts of pages, on worked examples and edge cases."""

import pytest
from pyspark.sql import functions as F

from factloom.operators import pages, yields

PAGE = "# Ada Works\nSource: a book\nLast-Seen: 2020\n\nAda Works Inc. is a maker of U.S. engines, which sell. It grew, e.g. fast! \"Then\" it stopped here.\nMore of it came.\n\n## Later\nShort one.\r\n\r\nThe end of it is near.\n"


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return row.select(column).first()[0]


def test_body_paragraphs_and_sentences(spark):
    parts = one(spark, pages.paragraphs(pages.body(F.col("t"))), t=PAGE)
    assert len(parts) == 3 and parts[1] == "Short one." and parts[2] == "The end of it is near."
    assert one(spark, pages.sentences(F.col("t")), t=parts[0]) == ["Ada Works Inc. is a maker of U.S. engines, which sell.", "It grew, e.g. fast!", '"Then" it stopped here.', "More of it came."]
    assert one(spark, pages.title(F.col("t"), F.lit("x_y")), t="no title") == "x y"
    assert one(spark, pages.paragraphs(pages.body(F.col("t"))), t=None) == []
    assert one(spark, pages.sentences(F.col("t")), t="Dr. A met B. in St. Paul. " * 20_000).__len__() == 20_000


@pytest.mark.parametrize(
    ("title", "sentence", "want"),
    [
        ("Ada Works", "Ada Works is a maker of engines, which sell well.", "maker of engines"),
        ("Ada", "Ada is the best known, in production, of all works that are.", "best known, in production, of all works"),
        ("Ada", "Ada is one of them.", None),
        ("Ada", "Ada was a former town of note.", None),
        ("Ada", "Ada was a town of.", None),
        ("Ada", "Ada is an Ada town of note.", None),
        ("2024 Ada", "Ada is a town of note.", None),
        ("Ada election", "It is a vote of all members.", None),
        ("Iron Age", "In the history of Rome, the age lasted approximately from 900 to 700, or so.", "period in the history of Rome lasting approximately from 900 to 700"),
        ("climate change", "Present-day climate change includes both warming and its effects.", "present-day change that includes both warming and its effects"),
        ("Ada", "x " * 150 + "is a town of note.", None),
        ("Ada", "Ada is a " + "very " * 60 + "town", None),
        ("Ada", "", None),
        ("Ada", None, None),
    ],
)
def test_definitions(spark, title, sentence, want):
    rows = spark.createDataFrame([(title, sentence, 1)], "subject string, sentence string, _n int")
    assert pages.with_definition(rows).first().definition == want


def test_lead_definitions_try_three_sentences_and_open_brackets(spark):
    texts = ["Ada (once (Ad. \"Ad\" was a town of note.", "The name is short here. Ada is the same. Later Ada was a river of Rome.", "Ada is one of all. Ada is one of all. Ada is one of all. Ada is a town here.", "", None]
    got = pages.lead_definitions(spark.createDataFrame([(k, f"# Ada\n\n{t}" if t is not None else None) for k, t in enumerate(texts)], "page long, text string"), "page")
    assert {r.page: r.definition for r in got.collect()} == {0: "town of note", 1: "river of Rome"}


def facts(spark, *sentences, title="Ada Works", lead=False):
    rows = [(1, title, k, s, lead) for k, s in enumerate(sentences)]
    out = yields.yielded(spark.createDataFrame(rows, "page long, title string, place long, sentence string, lead boolean"))
    return sorted((r.pattern_id, r.subject, r.predicate, r.object) for r in out.collect())


def test_names_in_clauses(spark):
    assert facts(spark, "Ada Works was founded in 1999 by serial investor Ann Lee and Bob Ray Cox in 1999.") == [("founded_by_v2", "Ada Works", "founded_by", "Ann Lee"), ("founded_by_v2", "Ada Works", "founded_by", "Bob Ray Cox")]
    assert facts(spark, "The Ada engine was built by the firm Lee & Co and Ray's in 2001.") == [("developed_by_v2", "Ada engine", "developed_by", "Lee & Co"), ("develops_inverse_v2", "Lee & Co", "develops", "Ada engine")]
    assert facts(spark, "Ada, also known as the Big Ada and old, is here.") == [("alias_v2", "Ada", "alias", "Big Ada")]
    assert facts(spark, "It runs on on-premises and Cloud Nine.") == [("runs_on_v2", "Ada Works", "runs_on", "Cloud Nine"), ("runs_on_v2", "Ada Works", "runs_on", "on-premises")]
    assert facts(spark, "Ada makes dances that it supports with and. The firm uses oil.") == []


def test_screens_fragments_and_repeats(spark):
    assert facts(spark, "Ada is not a plant in Rome.", "Ada currently uses coal.", "Ada was introduced in 2024.", "In total, Ada was introduced in 1990.", None, "") == [("introduced_v2", "Ada Works", "introduced", "1990")]
    assert facts(spark, "Ada is a lamp, not designed to burn, in Rome.") == [("located_in_v2", "Ada", "located_in", "Rome")]
    assert len(facts(spark, *["Ada was introduced in 1990."] * 3, "ADA was introduced in 1990.")) == 1
    assert facts(spark, "Ada uses the oil that it has from the U.") == [("uses_v2", "Ada", "uses", "the oil")]


def test_lead_definition_only_in_leads_and_once_a_subject(spark):
    text = "Ada Works (born 1950), also known as Ad, is an American engineer best known for it."
    assert ("lead_definition_v2", "Ada Works", "is_a", "American engineer") in facts(spark, text, lead=True)
    assert not [f for f in facts(spark, text) if f[2] == "is_a"]
    assert not [f for f in facts(spark, "Ada is an American engineer and more.", lead=True) if f[2] == "is_a"]  # one word of the title
    assert not [f for f in facts(spark, "Ada Works is an American thing and more.", lead=True) if f[2] == "is_a"]


def test_across_pages(spark):
    rows = [(k, 0, "x", "A", p, o, "low", "stable", "s") for k, p, o in ((2, "uses", "Oil"), (1, "uses", "oil"), (3, "is_a", "x"), (4, "is_a", "y"))]
    out = yields.across_pages(spark.createDataFrame(rows, "page long, place long, pattern_id string, subject string, predicate string, object string, risk string, stability string, sentence string"))
    assert sorted((r.page, r.object) for r in out.collect()) == [(1, "oil"), (3, "x")]
