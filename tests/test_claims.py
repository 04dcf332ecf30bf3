"""Claims of wiki pages and judged sentence patterns, on worked examples and edge cases."""

from factloom.operators import claims

TEXT = """{{Infobox works
| Founder = Ann Lee and Bob Ray
| products = lamps, the oil; heat.
| known_for = cold
| known_for = light
| size =
}}
'''Ada Works''' is a [[Maker|maker]] of lamps, based in [[Rome]].<ref name="x">It is a lie.</ref> It is known for its heat and the glow. It develops oil.
Forbes put its net worth at US$1.5 billion. It ranked number 7. The current president of it is Bob.

More of [[Rome|the city]].
"""


def rows(spark, *texts, title="Ada Works", at="2021-05-06"):
    pages = spark.createDataFrame([(k, title, t, at) for k, t in enumerate(texts)], "page long, title string, text string, retrieved_at string")
    return claims.claims(pages)


def test_one_page(spark):
    got = [tuple(r)[2:6] for r in rows(spark, TEXT).orderBy("place").collect()]
    assert got == [
        ("definition", "Ada Works", "is_a", "maker of lamps"),
        ("relation", "Ada Works", "known_for", "heat"),
        ("relation", "Ada Works", "known_for", "glow"),
        ("relation", "Ada Works", "develops", "oil"),
        ("relation", "Ada Works", "known_for", "light"),
        ("relation", "Ada Works", "produces", "lamps"),
        ("relation", "Ada Works", "produces", "oil"),
        ("relation", "Ada Works", "produces", "heat"),
        ("relation", "Ann Lee", "founded", "Ada Works"),
        ("relation", "Bob Ray", "founded", "Ada Works"),
        ("context_link", "Ada Works", "mentioned_with", "Maker"),
        ("context_link", "Ada Works", "mentioned_with", "Rome"),
        ("context_link", "Ada Works", "mentioned_with", "Rome"),
        ("source_fact", "Ada Works", "estimated_net_worth", "US$1.5 billion"),
        ("source_fact", "Ada Works", "ranking", "rank 7"),
        ("source_fact", "Ada Works", "current_office_holder", "The current president of it is Bob."),
    ]


def test_kinds_are_taken_apart_and_times_kept(spark):
    found = claims.by_kind(rows(spark, TEXT, "Of it is known for his leadership of Ada and the Works."))
    assert {k: f.count() for k, f in found.items()} == {"definition": 1, "relation": 11, "context_link": 3, "source_fact": 3}
    leads = found["relation"].where("predicate = 'leader_of'").collect()
    assert [(r.object, r.temporal_class, r.as_of, r.risk) for r in leads] == [("Ada", "snapshot", "2021-05", "medium"), ("Works", "snapshot", "2021-05", "medium")]
    facts = found["source_fact"].collect()
    assert {(r.source_name, r.as_of, r.stability) for r in facts} == {("Forbes", "2021-05", "volatile"), ("unknown_source", "2021-05", "volatile")}


def test_edges(spark):
    assert rows(spark, None, "", "{{Infobox}}", "{{Infobox\n| founder =\n}}", "Words only.", "[[]] [[ |x]]").where("kind != 'context_link'").count() == 0
    assert rows(spark, "Ada Works is an Ada  works.").count() == 0  # a title doesn't define itself
    assert rows(spark, "It is a " + "long " * 50_000 + "one.").count() == 1
    assert [r.as_of for r in rows(spark, "It was the richest man.", at="May").where("kind = 'source_fact'").collect()] == ["May"]
    assert rows(spark).count() == 0


def test_patterns(spark):
    table = [("s", "t", "x", "action", "bird_behavior", t) for t in ("{subject} Moved", "{subject} flew", "{subject} ate {object}", "{subject} ate {object}", None)] + [("s", "t", "x", "action", "other", "{subject} ate {food}")]
    got = claims.judged_patterns(spark.createDataFrame(table, "source_id string, term string, sense string, pattern_type string, frame string, template string").where("template IS NOT NULL"))
    assert sorted((r.template, r.decision, r.reason) for r in got.collect()) == [
        ("{subject} Moved", "rejected_auto", "generic_template"),
        ("{subject} ate {food}", "needs_review", "unknown_semantic_frame:other"),
        ("{subject} ate {object}", "accepted_auto", "concrete_slots_known_frame"),
        ("{subject} flew", "rejected_auto", "no_concrete_slots"),
    ]
    assert all(r.pattern_id.startswith("pat-") and len(r.pattern_id) == 16 for r in got.collect())
