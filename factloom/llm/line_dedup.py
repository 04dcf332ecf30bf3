"""Line dedup by pairwise alignment: common blocks go from the later of two documents.

Documents are ordered by key. A line is its words, A-Z in lower case; a blank line has none.
Every line that has the words of a block, and every shortest run of lines, from a line on or
up to a line, that reaches them, leads each of its holders to the first of these, so a run in n
documents makes n - 1 pairs, never all of them. Each line of a common block is within such a
run, and the run's first holder holds it, so what goes is what an alignment with every earlier
document would take. Every pair is aligned by a patience diff over its line hashes: lines that
are unique in both anchor the alignment, the gaps between anchors are aligned in the same way.
Aligned runs of lines with enough words are deleted from the later document. Runs that no
unique line anchors, and further occurrences of a run, are found by a suffix automaton of the
earlier document, so every run of enough words that both hold goes.

Texts are cut into lines once; the table of line hashes stays in the shared folder and is read by
the search for pairs and by the alignment.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator, Sequence
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.shared import written
from factloom.llm.words import line_hashes, mix

#: Words a block of lines needs to be deleted.
BLOCK_WORDS = 10
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def _increasing(places: Sequence[int]) -> list[int]:
    """Indices of a longest strictly increasing subsequence."""
    tails: list[int] = []
    at: list[int] = []
    before: list[int] = []
    for k, place in enumerate(places):
        n = bisect_left(tails, place)
        before.append(at[n - 1] if n else -1)
        tails[n : n + 1], at[n : n + 1] = [place], [k]
    out, k = [], at[-1] if at else -1
    while k >= 0:
        out.append(k)
        k = before[k]
    return out[::-1]


def patience(a: Sequence, b: Sequence) -> list[tuple[int, int]]:
    """Aligned (place in a, place in b) of equal lines, in increasing order in both."""
    out: list[tuple[int, int]] = []
    stack = [(0, len(a), 0, len(b))]
    while stack:
        a0, a1, b0, b1 = stack.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 >= a1 or b0 >= b1:
            continue
        in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        at_b = {line: k for k, line in enumerate(b[b0:b1], b0) if in_b[line] == 1}
        unique = [(k, at_b[line]) for k, line in enumerate(a[a0:a1], a0) if in_a[line] == 1 and line in at_b]
        anchors = [unique[k] for k in _increasing([place for _, place in unique])]
        if anchors:
            x, y = a0, b0
            for i, j in [*anchors, (a1, b1)]:
                if (x, y) != (a0, b0) or (i, j) != (a1, b1):
                    stack.append((x, i, y, j))
                if (i, j) != (a1, b1):
                    out.append((i, j))
                x, y = i + 1, j + 1
    return sorted(out)


def longest_matches(later: Sequence, earlier: Sequence) -> list[int]:
    """For each place of ``later``, lines of the longest run ending there that ``earlier`` holds."""
    steps: list[dict] = [{}]
    link, size, last = [-1], [0], 0
    for line in earlier:
        new = len(steps)
        steps.append({})
        link.append(0)
        size.append(size[last] + 1)
        at = last
        while at >= 0 and line not in steps[at]:
            steps[at][line] = new
            at = link[at]
        if at >= 0:
            to = steps[at][line]
            if size[to] == size[at] + 1:
                link[new] = to
            else:
                copy = len(steps)
                steps.append(dict(steps[to]))
                link.append(link[to])
                size.append(size[at] + 1)
                link[to] = link[new] = copy
                while at >= 0 and steps[at].get(line) == to:
                    steps[at][line] = copy
                    at = link[at]
        last = new
    out, at, run = [], 0, 0
    for line in later:
        while at and line not in steps[at]:
            at = link[at]
            run = size[at]
        if line in steps[at]:
            at, run = steps[at][line], run + 1
        out.append(run)
    return out


def _may_hold_more(later: Sequence, earlier: Sequence, words: Sequence[int], gone: set[int], block_words: int) -> bool:
    """Whether lines that ``earlier`` holds make a run of enough words that isn't gone already."""
    there, total, fresh = set(earlier), 0, False
    for k, line in enumerate(later):
        if line in there:
            total, fresh = total + words[k], fresh or k not in gone
            if fresh and total >= block_words:
                return True
        else:
            total, fresh = 0, False
    return False


def common_lines(later: Sequence, earlier: Sequence, words: Sequence[int], block_words: int = BLOCK_WORDS) -> list[int]:
    """Places in ``later`` of the lines in blocks of at least ``block_words`` words that ``earlier`` holds too."""
    out: list[int] = []
    run: list[int] = []
    last = (-2, -2)
    for pair in [*patience(later, earlier), (-9, -9)]:
        if pair != (last[0] + 1, last[1] + 1):
            if sum(words[k] for k in run) >= block_words:
                out += run
            run = []
        run.append(pair[0])
        last = pair
    if not _may_hold_more(later, earlier, words, set(out), block_words):
        return out
    found, begins = set(out), [0, *accumulate(words)]
    longest, done = longest_matches(later, earlier), 0
    for end, n in enumerate(longest, 1):
        if n and begins[end] - begins[end - n] >= block_words:
            found.update(range(max(end - n, done), end))
            done = end
    return sorted(found)


def run_seeds(line: np.ndarray, n: np.ndarray, bounds: np.ndarray, block_words: int = BLOCK_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of each document's distinct shortest runs of ``block_words``; document d has lines ``bounds[d]`` to ``bounds[d + 1]``."""
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    total, at = np.concatenate([[0], np.cumsum(n)]), np.arange(len(line))
    ends = np.searchsorted(total, total[:-1] + block_words, "left")
    begins = np.searchsorted(total, total[1:] - block_words, "right") - 1
    down, up = ends <= bounds[doc + 1], begins >= bounds[doc]
    first, size = np.concatenate([at[down], begins[up]]), np.concatenate([ends[down] - at[down], at[up] + 1 - begins[up]])
    owner = np.concatenate([doc[down], doc[up]])
    powers, inverse = (np.multiply.accumulate(np.append(np.uint64(1), np.full(len(line), x, np.uint64))) for x in (_FACTOR, _INVERSE))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(line * inverse[:-1], dtype=np.uint64)])
    seed = mix((sums[first + size] - sums[first]) * powers[first] + mix(size))
    order = np.lexsort((seed, owner))
    owner, seed = owner[order], seed[order]
    fresh = np.ones(len(seed), bool)
    fresh[1:] = (seed[1:] != seed[:-1]) | (owner[1:] != owner[:-1])
    return owner[fresh], seed[fresh].view(np.int64)


def line_table(documents: DataFrame, key: str, text: str) -> DataFrame:
    """(id, tag, lines, words): hash of each text, hashes of its lines and their numbers of words; without null keys and texts."""
    kind = documents.schema[key].dataType.simpleString()
    rows = documents.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("id"), F.xxhash64(text).alias("tag"), F.col(text).alias("_text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = 0
            for bounds, line, n in line_hashes(batch.column(2)):
                size, ends = len(bounds) - 1, pa.array(bounds, pa.int32())
                lists = [pa.ListArray.from_arrays(ends, pa.array(line.view(np.int64))), pa.ListArray.from_arrays(ends, pa.array(n, pa.int32()))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(done, size), batch.column(1).slice(done, size), *lists], names=["id", "tag", "lines", "words"])
                done += size

    return rows.mapInArrow(cut, f"id {kind}, tag long, lines array<long>, words array<int>")


def _seeds(lines: DataFrame, block_words: int) -> DataFrame:
    kind = lines.schema["id"].dataType.simpleString()

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, n = batch.column(2), batch.column(3)
            line, bounds = own.flatten().to_numpy().view(np.uint64), own.offsets.to_numpy().astype(np.int64)
            at, seed = run_seeds(line, n.flatten().to_numpy().astype(np.int64), bounds - bounds[0], block_words)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), batch.column(1).take(pa.array(at)), pa.array(seed)], names=["id", "tag", "seed"])

    return lines.mapInArrow(find, f"id {kind}, tag long, seed long").select(F.struct("id", "tag").alias("doc"), "seed")


def deleted_lines(documents: DataFrame, key: str = "doc_id", text: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """(key, tag, places): which lines of a document go, by place from 0; only documents that lose some.

    ``tag`` is a hash of the text, which tells documents of one key apart.
    """
    lines = written(line_table(documents, key, text), "lines")
    seeds = _seeds(lines, block_words)
    first = seeds.groupBy("seed").agg(F.min("doc").alias("owner"), F.max("doc").alias("last")).where("owner != last").drop("last")
    pairs = seeds.join(first, "seed").where("doc != owner").select("doc", "owner").distinct()
    doc = F.struct("id", "tag")
    both = pairs.join(lines.select(doc.alias("owner"), F.col("lines").alias("earlier")), "owner")
    both = both.join(lines.select(doc.alias("doc"), F.col("lines").alias("later"), "words"), "doc").select("doc.id", "doc.tag", "later", "words", "earlier")

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = [common_lines(x.as_py(), y.as_py(), w.as_py(), block_words) for x, w, y in zip(*(batch.column(k) for k in (2, 3, 4)), strict=True)]
            some = pa.array([k for k, p in enumerate(places) if p], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(some), batch.column(1).take(some), pa.array([p for p in places if p], pa.list_(pa.int32()))], names=["id", "tag", "places"])

    kind = lines.schema["id"].dataType.simpleString()
    found = both.mapInArrow(align, f"id {kind}, tag long, places array<int>")
    found = found.groupBy("id", "tag").agg(F.array_distinct(F.flatten(F.collect_set("places"))).alias("places"))
    return found.select(F.col("id").alias(key), "tag", "places")


def without_common_lines(documents: DataFrame, key: str = "doc_id", text: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """All rows, with the common lines deleted from ``text``; adds n_lines and n_deleted (long).

    A document that loses nothing keeps its text to the letter; one whose lines are all
    common has an empty text. Lines are compared by their words, A-Z in lower case; a
    blank line counts no word and goes with a block that it stands in or next to in both. Null keys and null texts pass unchanged. Equal
    rows, and rows of one key and text, are one document; rows of one key with different
    texts are ordered by a hash of the text. Empty tables give empty results. Other columns
    pass through; columns of the two names are replaced.
    """
    gone = deleted_lines(documents, key, text, block_words).select(F.col(key).alias("k"), F.col("tag").alias("t"), "places")
    kept = [c for c in documents.columns if c not in ("n_lines", "n_deleted")]
    # the row stays a struct until the end, so no column of it can clash with those of the join
    rows = documents.select(F.struct(*(F.col(f"`{c}`") for c in kept)).alias("row"), F.col(key).alias("k"), F.xxhash64(text).alias("t"))
    out, own = rows.join(gone, ["k", "t"], "left"), F.col("row")[text]
    lines = F.filter(F.split(own, "\n"), lambda _, k: ~F.array_contains("places", k))
    new = F.when(F.col("places").isNull(), own).otherwise(F.array_join(lines, "\n"))
    count = F.when(own.isNull(), 0).otherwise(F.length(own) - F.length(F.replace(own, F.lit("\n"))) + 1).cast("long")
    deleted = F.when(F.col("places").isNull(), 0).otherwise(F.size("places")).cast("long")
    return out.select(*(new.alias(c) if c == text else F.col("row")[c].alias(c) for c in kept), count.alias("n_lines"), deleted.alias("n_deleted"))
