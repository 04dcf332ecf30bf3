"""Phrase collocations of each language by best-first branch-and-bound growth.

Phrases of up to ``longest`` words grow by a word at an end. What is known of a phrase bounds every phrase that
begins with it: with a occurrences and a first part of l, none of them scores over a / (l + a). So only phrases
whose bound reaches a language's threshold are grown, best bounds first: the threshold starts at the score
of the 4000th pair of words and falls until 2000 phrases that no longer one takes the place of score at least that;
then nothing that isn't yet grown can come among them, and all ties are known.

Each pass over the texts counts the phrases that a step asks for. Which ones is told by a bit filter of fixed size
(8 MB) without false negatives, so a count is always of all occurrences; counts are summed in the tasks first.
A word is a 64-bit hash with its language, a phrase is its words.

Null texts have no words, a null language is ``und``, repeated rows count each time, an empty table gives no rows,
other columns are let go. Equal scores and counts are ranked by phrase. Scores are integers, computed as decimals.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factloom.llm.bits import bit_filter, cells, has, salts
from factloom.llm.shared import written
from factloom.llm.words import byte_rows, hash_words, mix, row_chunks, word_starts, words_at

_BREAK = np.zeros(256, bool)
_BREAK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_APART = _BREAK.copy()
_APART[[0x20, 0x09]] = True
#: Occurrences that a task sums at once.
_FLUSH = 1 << 20
#: Multiples of the wanted rows whose pairs of words set the thresholds; after the last one everything is grown.
_ROUNDS = (2, 16)
_SALTS = 32
_UND = "und"
#: The score of a share of 1.
_UNIT = 2_000_000

def _names(n: int, first: int = 1) -> list[str]:
    return [f"w{k}" for k in range(first, first + n)]


def _distinct(columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Indexes of one row of each run of equal rows, brought together by a hash, and the runs' lengths."""
    mixed = np.zeros(len(columns[0]), np.uint64)
    for c in columns:
        mixed = mix(mixed ^ c.astype(np.int64).view(np.uint64))
    order = np.argsort(mixed, kind="stable")
    head = np.ones(len(order), bool)
    head[1:] = np.logical_or.reduce([c[order[1:]] != c[order[:-1]] for c in columns])
    at = np.flatnonzero(head)
    return order[at], np.diff(np.append(at, len(order)))


class _Langs:
    """Numbers for the languages that a task meets."""

    def __init__(self) -> None:
        self.known: dict[str, int] = {}

    def codes(self, column: pa.Array) -> np.ndarray:
        own = column.fill_null(_UND).dictionary_encode()
        table = np.array([self.known.setdefault(x, len(self.known)) for x in own.dictionary.to_pylist()], np.int64)
        return table[own.indices.to_numpy()] if len(own) else np.zeros(0, np.int64)

    def column(self, codes: np.ndarray) -> pa.Array:
        return pa.DictionaryArray.from_arrays(pa.array(codes), pa.array(list(self.known), pa.string())).cast(pa.string())


def _words(batch: pa.RecordBatch, langs: _Langs) -> Iterator[tuple[np.ndarray, ...]]:
    """Bytes, first bytes of words, their hashes, languages and pieces, for one part of the batch after the other."""
    codes = langs.codes(batch.column(0))
    data, offsets = byte_rows(batch.column(1))
    for first, last in row_chunks(offsets):
        own = offsets[first : last + 1] - offsets[first]
        text = data[offsets[first] : offsets[last]]
        hashes, bounds = hash_words(text, own, space=_APART)
        if len(hashes):
            starts = word_starts(text, own, _APART)
            row = np.repeat(np.arange(last - first), np.diff(bounds))
            yield text, starts, hashes.view(np.int64), codes[first:last][row], np.cumsum(_BREAK[text])[starts] + row


def count_words(documents: DataFrame, least: int) -> DataFrame:
    """(lang, w1, word, a) of the words with at least ``least`` occurrences, and a row with no word for all of a language."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs = _Langs()
        for batch in batches:
            for text, starts, w, lang, _ in _words(batch, langs):
                some, n = _distinct([lang, w])
                yield pa.RecordBatch.from_arrays([langs.column(lang[some]), pa.array(w[some]), words_at(text, starts, some, _APART), pa.array(n)], names=["lang", "w1", "word", "a"])
                codes, n = np.unique(lang, return_counts=True)
                yield pa.RecordBatch.from_arrays([langs.column(codes), pa.nulls(len(codes), pa.int64()), pa.nulls(len(codes), pa.string()), pa.array(n)], names=["lang", "w1", "word", "a"])

    found = documents.mapInArrow(scan, "lang string, w1 long, word string, a long").groupBy("lang", "w1", "word").agg(F.sum("a").alias("a"))
    return found.where((F.col("a") >= least) | F.col("word").isNull())


def count_phrases(documents: DataFrame, n: int, asked: list[tuple[int, int, np.ndarray]], least: int, every: bool = False) -> DataFrame:
    """(lang, w1, …, a) of the phrases of ``n`` words with at least ``least`` occurrences of which one is asked for.

    ``asked`` has (start, words, filter): phrases whose words from ``start`` are in the filter; with
    ``every``, in all of the filters.
    """
    shared = documents.sparkSession.sparkContext.broadcast(asked)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, held, size = _Langs(), [], 0

        def summed() -> pa.RecordBatch:
            columns = [np.concatenate(c) for c in zip(*held, strict=True)]
            some, counts = _distinct(columns)
            return pa.RecordBatch.from_arrays([langs.column(columns[0][some]), *(pa.array(c[some]) for c in columns[1:]), pa.array(counts)], names=["lang", *_names(n), "a"])

        for batch in batches:
            for _, _, w, lang, piece in _words(batch, langs):
                at = np.flatnonzero(piece[n - 1 :] == piece[: len(piece) - n + 1]) if len(piece) >= n else np.zeros(0, np.int64)
                salt = salts(list(langs.known))[lang[at]]
                keep = np.full(len(at), every)
                for start, width, bits in shared.value:
                    met = has(bits, cells(salt, [w[at + start + k] for k in range(width)]))
                    keep = keep & met if every else keep | met
                at = at[keep]
                held.append([lang[at], *(w[at + k] for k in range(n))])
                size += len(at)
                if size >= _FLUSH:
                    yield summed()
                    held, size = [], 0
        if size:
            yield summed()

    kind = f"lang string, {', '.join(f'{w} long' for w in _names(n))}, a long"
    return documents.mapInArrow(scan, kind).groupBy("lang", *_names(n)).agg(F.sum("a").alias("a")).where(F.col("a") >= least)


def _share(a: Column, of: Column) -> Column:
    """floor(2000000 a / of), exactly."""
    return F.call_function("div", a.cast("decimal(20,0)") * F.lit(_UNIT), of.cast("decimal(20,0)"))


def _parts(n: int) -> list[tuple[int, int]]:
    """(start, words) of the parts of all cuts of a phrase of ``n`` words."""
    return [x for k in range(1, n) for x in ((1, k), (k + 1, n - k))]


def scored(phrases: DataFrame, n: int, counts: dict[int, DataFrame]) -> DataFrame:
    """Adds l, r and score of the least cut, and the bound of the phrases that begin with it; score is null where a part's count isn't known.

    ``bound`` leaves out what isn't known, so it's never too low.
    """
    for start, width in _parts(n):
        own = counts[width].select("lang", *(F.col(f"w{k + 1}").alias(f"w{start + k}") for k in range(width)), F.col("a").alias(f"f{start}_{width}"))
        phrases = phrases.join(own, ["lang", *_names(width, start)], "left")
    cuts = [(k, F.col(f"f1_{k}"), F.col(f"f{k + 1}_{n - k}")) for k in range(1, n)]
    a = F.col("a")
    each = F.array(*(F.struct(_share(a, left + right).alias("score"), F.lit(k).alias("k"), left.alias("l"), right.alias("r")) for k, left, right in cuts))
    known = F.forall(each, lambda c: c.score.isNotNull())
    unit = F.lit(_UNIT // 2).cast("long")
    bound = F.least(unit, *(F.coalesce(_share(a, left + a), unit) for _, left, _ in cuts))
    # what a phrase's own score can reach while the counts of some right parts aren't known
    most = F.least(unit, *(F.coalesce(_share(a, F.coalesce(left, a) + F.coalesce(right, a)), unit) for _, left, right in cuts))
    best = F.when(known, F.array_min(each))
    out = phrases.withColumns({"best": best, "bound": bound, "most": most})
    return out.select("lang", *_names(n), "a", F.col("best.l").alias("l"), F.col("best.r").alias("r"), F.col("best.score").alias("score"), "bound", "most")


def _threshold(scores: DataFrame, wanted: int) -> DataFrame:
    """(lang, low): about the greatest score that ``wanted`` rows of a language reach, to a thousandth of the range; 0 if there are fewer."""
    width = _UNIT // 2000
    cells = scores.groupBy("lang", F.floor(F.col("score") / width).alias("cell")).agg(F.count("*").alias("n"))
    above = F.sum("n").over(Window.partitionBy("lang").orderBy(F.desc("cell")).rowsBetween(Window.unboundedPreceding, 0))
    return cells.withColumn("above", above).groupBy("lang").agg((F.coalesce(F.max(F.when(F.col("above") >= wanted, F.col("cell"))), F.lit(0)) * width).cast("long").alias("low"))


def _survivors(phrases: DataFrame, n: int, longer: DataFrame | None, share: int) -> DataFrame:
    """Phrases that no longer one by a word holds in at least ``share`` percent of their occurrences.

    One word more is enough: what holds a phrase in a yet longer one holds it in one between.
    """
    if longer is None:
        return phrases
    ends = [longer.select("lang", *(F.col(f"w{k + s}").alias(f"w{k}") for k in range(1, n + 1)), F.col("a").alias("held")) for s in (0, 1)]
    most = ends[0].unionByName(ends[1]).groupBy("lang", *_names(n)).agg(F.max("held").alias("held"))
    return phrases.join(most, ["lang", *_names(n)], "left").where(F.coalesce(100 * F.col("held") < share * F.col("a"), F.lit(True))).drop("held")


def collocations(documents: DataFrame, text: str = "text", lang: str = "lang", top: int = 2000, longest: int = 4, least: int = 30, share: int = 80) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``top`` phrases of 2 to ``longest`` words."""
    if longest > 4:
        raise ValueError("parts of phrases of more than four words aren't all counted")
    docs = documents.select(F.coalesce(F.col(lang).cast("string"), F.lit(_UND)).alias("lang"), F.col(text).alias("text"))
    words = written(count_words(docs, least), "words")
    known = words.where(F.col("word").isNotNull())
    totals = words.where(F.col("word").isNull()).select("lang", F.col("a").alias("n"))
    counts = {1: known.select("lang", "w1", "a")}
    common = bit_filter(known, "lang", _names(1))
    # by length: all phrases counted so far with their scores; pairs are all counted, longer ones as they are asked for
    grams = {2: written(scored(count_phrases(docs, 2, [(0, 1, common), (1, 1, common)], least, every=True), 2, counts), "phrases")}
    counts[2] = grams[2].select("lang", "w1", "w2", "a")
    high = grams[2].select("lang").distinct().withColumn("high", F.lit(_UNIT).cast("long"))
    done: DataFrame | None = None
    for wanted in (*(k * top for k in _ROUNDS), None):
        low = _threshold(grams[2], wanted) if wanted else high.select("lang", F.lit(0).cast("long").alias("low"))
        steps = written(high.join(low, "lang"), "steps")
        for n in range(3, longest + 1):
            shorter = grams[n - 1].join(steps, "lang")
            between = lambda c: (F.col(c) >= F.col("low")) & (F.col(c) < F.col("high"))
            right, left = (bit_filter(shorter.where(between(c)), "lang", _names(n - 1)) for c in ("bound", "score"))
            found = _joined(grams.get(n), count_phrases(docs, n, [(0, n - 1, right), (1, n - 1, left)], least), n)
            if n > 3:
                # the last words of what may yet reach the threshold are counted, too
                found = written(found, "found")
                counts[n - 1] = grams[n - 1].select("lang", *_names(n - 1), "a")
                open_ = scored(found, n, counts).join(steps, "lang").where(F.col("score").isNull() & (F.col("most") >= F.col("low")))
                ends = open_.select("lang", *(F.col(f"w{k + 1}").alias(f"w{k}") for k in range(1, n)))
                more = _joined(grams[n - 1], count_phrases(docs, n - 1, [(0, n - 1, bit_filter(ends, "lang", _names(n - 1)))], least), n - 1)
                grams[n - 1] = written(scored(more, n - 1, counts), "phrases")
            counts[n - 1] = grams[n - 1].select("lang", *_names(n - 1), "a")
            grams[n] = written(scored(found, n, counts), "phrases")
        rows = None
        for n in range(2, longest + 1):
            reached = grams[n].join(steps, "lang").where(F.col("score") >= F.col("low"))
            own = _survivors(reached, n, grams.get(n + 1), share).select("lang", *(F.col(w) if k < n else F.lit(None).cast("long").alias(w) for k, w in enumerate(_names(longest))), "a", "l", "r", "score")
            rows = own if rows is None else rows.unionByName(own)
        rows = written(rows, "survivors")
        settled = steps.join(rows.groupBy("lang").agg(F.count("*").alias("own")), "lang", "left").where((F.col("low") == 0) | (F.col("own") >= top)).select("lang")
        ready = rows.join(settled, "lang")
        done = ready if done is None else done.unionByName(ready)
        high = written(steps.join(settled, "lang", "left_anti").select("lang", F.col("low").alias("high")), "steps")
        if high.isEmpty():
            break
    return _ranked(done, known, totals, top, longest)


def _joined(old: DataFrame | None, new: DataFrame, n: int) -> DataFrame:
    """Phrases of both tables once; a phrase has the same count in both."""
    new = new.select("lang", *_names(n), "a")
    return new if old is None else new.unionByName(old.select("lang", *_names(n), "a")).groupBy("lang", *_names(n)).agg(F.max("a").alias("a"))


def _ranked(rows: DataFrame, words: DataFrame, totals: DataFrame, top: int, longest: int) -> DataFrame:
    """The first ``top`` rows of each language by score, count and phrase; each of many parts gives its first ones."""
    low = _threshold(rows, top)
    rows = rows.join(low, "lang").where(F.col("score") >= F.col("low"))
    for w in _names(longest):
        rows = rows.join(words.select("lang", F.col("w1").alias(w), F.col("word").alias(f"t{w}")), ["lang", w], "left")
    rows = rows.withColumn("phrase", F.concat_ws(" ", *(f"t{w}" for w in _names(longest))))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(_SALTS)))
    for keys in (["lang", "salt"], ["lang"]):
        rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= top)
    return rows.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def oracle(top: int = 2000, longest: int = 4, least: int = 30, share: int = 80) -> str:
    """DuckDB SQL of ``collocations(documents)``: every phrase is counted."""
    return rf"""
WITH pieces AS (
  SELECT coalesce(lang, '{_UND}') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
lists AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
starts AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM lists),
grams AS (SELECT lang, w[i:i + k] AS p FROM starts, range({longest}) t(k) WHERE i + k <= len(w)),
counts AS (SELECT lang, p, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= {least}),
sizes AS (SELECT lang, count(*) AS n FROM starts GROUP BY lang),
cuts AS (SELECT lang, p, f AS a, unnest(range(1, len(p))) AS k FROM counts WHERE len(p) > 1),
each AS (
  SELECT c.lang, c.p, c.a, k, x.f AS l, y.f AS r, (2000000::HUGEINT * c.a // (x.f + y.f))::BIGINT AS score
  FROM cuts c JOIN counts x ON x.lang = c.lang AND x.p = c.p[1:k] JOIN counts y ON y.lang = c.lang AND y.p = c.p[k + 1:]),
best AS (SELECT * FROM each QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1),
inner_ AS (
  SELECT DISTINCT q.lang, q.p[i:i + k] AS p, q.f FROM counts q, range(1, {longest} + 1) s(i), range(1, {longest}) t(k) WHERE i + k <= len(q.p) AND k + 1 < len(q.p)),
gone AS (SELECT DISTINCT b.lang, b.p FROM best b JOIN inner_ q USING (lang, p) WHERE 100 * q.f >= {share} * b.a),
kept AS (SELECT lang, array_to_string(p, ' ') AS phrase, a, l, r, score FROM best ANTI JOIN gone USING (lang, p))
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM kept JOIN sizes USING (lang)
QUALIFY rank <= {top}"""
