"""Style profiles against counting in Python."""

import re
from collections import Counter

from factloom.operators import style

ROWS = [
    ("a", "The Lake of Ada is calm\nthe hill of Ada sleeps\n\n# note of Bob\nÉté of Ada\r\nof gold-leaf"),
    ("a", None),
    ("b", "a calm Lake\ra calm hill\nwarm calm\n123\n" + "gold " * 4000),
    ("b", ""),
    (None, "no source of Ada of Ada"),
]


def plain(rows):
    out = {}
    for source, text in rows:
        if source is not None:
            out.setdefault(source, []).extend(x.strip() for x in re.split(r"\r\n|[\r\n]", text or "") if x.strip() and not x.strip().startswith("#"))
    return out


def words(line):
    return re.findall(r"[^\W\d_]+(?:-[^\W\d_]+)?", line)


def rhyme(word):
    for pattern in ("[aeiouy][^aeiouy]*[aeiouy][^aeiouy]*$", "[aeiouy][^aeiouy]*$"):
        if found := re.search(pattern, word):
            return found[0]
    return word


def test_profiles_names_and_rhymes(spark):
    texts = spark.createDataFrame(ROWS, "source string, text string").selectExpr("*", "1 AS n", "'x' AS word")
    rows = style.lines(texts, "source", "text")
    counts = style.word_counts(rows)
    got = {r.source: r for r in style.style_profiles(rows, counts).collect()}
    lines = plain(ROWS)
    everywhere = Counter(w.lower() for own in lines.values() for x in own for w in words(x))
    assert set(got) == {"a", "b"}
    for source, own in lines.items():
        own = [x for x in own if words(x)]
        metre = Counter(len(re.sub("[^aeiouy]", "", x.lower())) for x in own)
        first = Counter(words(x)[0].lower() for x in own)
        vocabulary = Counter(w.lower() for x in own for w in words(x))
        assert got[source].line_count == len(own)
        assert abs(got[source].avg_syllables - sum(s * n for s, n in metre.items()) / len(own)) <= 0.005
        assert got[source].common_syllables == [s for s, _ in sorted(metre.items(), key=lambda x: (-x[1], x[0]))[:3]]
        assert got[source].top_openers == [w for w, _ in sorted(first.items(), key=lambda x: (-x[1], x[0]))[:12]]
        scores = sorted(((n * n / (everywhere[w] - n + 2), w) for w, n in vocabulary.items() if len(w) >= 3), reverse=True)
        assert got[source].signature == [w for _, w in scores[:25]]
    assert sorted(map(tuple, style.proper_names(counts).collect())) == [("ada", 3, 0), ("lake", 2, 0)]
    last = Counter(words(x)[-1].lower() for own in lines.values() for x in own if words(x))
    sums = Counter()
    for w, n in last.items():
        sums[rhyme(w)] += n
    assert sorted(map(tuple, style.rhyme_groups(rows).collect())) == sorted((rhyme(w), w, n) for w, n in last.items() if sums[rhyme(w)] >= 2) != []


def test_empty(spark):
    rows = style.lines(spark.createDataFrame([], "source string, text string"), "source", "text")
    counts = style.word_counts(rows)
    assert style.style_profiles(rows, counts).count() == style.proper_names(counts).count() == style.rhyme_groups(rows).count() == 0
