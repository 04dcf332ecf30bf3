"""Prefix trie of conversations by truncation peeling.

A node is a distinct sequence of first turns; the root is the sequence of none. Starting at the greatest depth,
the conversations that end there are merged with the nodes that survived from below; every node's last turn
is stripped, and equal remainders are grouped into the nodes of the next depth. Counts, leaves and saved
tokens are summed on the way, so every node is found and finished in one pass.

A turn is a 16-byte hash of all turns so far and 4 bytes with its number of words; a path is their
concatenation, so stripping a turn is a substring and a node's key is the hash in its last element.
Texts are only read to hash them and to count their words.

Sets of any shape are handled: null ids have no conversation, a null turn sorts first, null roles and texts are
empty; equal turn numbers of a conversation sort by role and by the text's hash; repeated rows are repeated
turns; an empty table has no nodes, not even a root. Other columns are let go.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factloom.llm.shared import written

#: Bytes of a path's element: the hash of all turns so far, and the words of its last text.
HASH, ELEMENT = 16, 20
#: Depth beyond which what a conversation shares with no other one is laid out at once instead of being peeled.
DEEP = 32
#: Parts among which the children of one node are dealt.
_SALTS = 64
_EMPTY = hashlib.sha256(b"").hexdigest()


def _short_hash(value: Column) -> Column:
    return F.unhex(F.substring(F.sha2(value, 256), 1, 2 * HASH))


def turns_of(conversations: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(key, turns): each conversation's turns in order, as hashes and words."""
    role, text = F.coalesce(F.col(role), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    words = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+"))
    own = F.struct(F.col(turn).alias("turn"), role.alias("role"), _short_hash(F.concat(F.md5(role.cast("binary")), text)).alias("hash"), F.unhex(F.lpad(F.hex(words.cast("long")), 8, "0")).alias("words"))
    rows = conversations.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("key"), own.alias("own"))
    lists = rows.groupBy("key").agg(F.sort_array(F.collect_list("own")).alias("own"))
    return lists.select("key", F.transform("own", lambda t: F.struct(t.hash.alias("hash"), t.words.alias("words"))).alias("turns"))


def with_shared_heads(turns: DataFrame, every: int = 20, most: int = 4) -> DataFrame:
    """(key, turns) rebuilt: the first h turns of conversation key - key % every, then its own after its first h; h is crc32(key) % most."""
    heads = turns.where(F.col("key") % every == 0).select(F.col("key").alias("base"), F.slice("turns", 1, most - 1).alias("head"))
    h = (F.crc32(F.col("key").cast("string")) % most).cast("int")
    both = turns.withColumns({"h": h, "base": F.col("key") - F.col("key") % every}).join(heads, "base", "left")
    own = F.slice("turns", F.col("h") + 1, F.size("turns"))
    return both.select("key", F.when(F.col("head").isNull(), own).otherwise(F.concat(F.slice("head", F.lit(1), F.col("h")), own)).alias("turns"))


def _paths(turns: DataFrame) -> DataFrame:
    step = lambda path, t: F.concat(path, _short_hash(F.concat(F.substring(path, -ELEMENT, HASH), t.hash)), t.words)
    return turns.select("key", F.aggregate("turns", F.lit(b""), step).alias("path"))


def _element(path: str | Column, depth: Column) -> tuple[Column, Column]:
    """Key and words of the node of that depth on a path."""
    path = F.col(path) if isinstance(path, str) else path
    at = (depth - 1) * ELEMENT + 1
    words = F.conv(F.hex(F.substring(path, at + HASH, F.lit(ELEMENT - HASH))), 16, 10).cast("long")
    return F.when(depth > 0, F.substring(path, at, F.lit(HASH))).otherwise(F.lit(b"")), F.when(depth > 0, words).otherwise(F.lit(0).cast("long"))


def _with_cuts(ends: DataFrame) -> DataFrame:
    """Adds ``cut``: the least of the depths 32, 64, 128, … at which no other path has the same beginning, null if there is none."""
    cuts = F.transform(F.sequence(F.lit(0), F.floor(F.log2((F.col("depth") - 1) / DEEP)).cast("int")), lambda k: (F.lit(DEEP) * F.pow(F.lit(2), k)).cast("int"))
    deep = ends.where(F.col("depth") > DEEP).select("path", F.explode(cuts).alias("cut")).withColumn("at", _element("path", F.col("cut"))[0])
    alone = deep.groupBy("at").agg(F.count("*").alias("n")).where("n = 1").select("at")
    least = deep.join(alone, "at", "left_semi").groupBy("path").agg(F.min("cut").alias("cut"))
    return ends.join(least, "path", "left")


def _tails(ends: DataFrame) -> DataFrame:
    """Nodes below the cut of each path that has one; only its own conversations are members."""
    depth = F.col("depth")
    rows = ends.where(F.col("cut").isNotNull()).select(_element("path", depth)[0].alias("leaf"), "path", "conv_id", "n_convs", "cut", depth.alias("last"), F.explode(F.sequence(F.col("cut") + 1, depth)).alias("depth"))
    key, words = _element("path", depth)
    rows = rows.select("leaf", "cut", "last", "depth", "conv_id", "n_convs", key.alias("key"), _element("path", depth - 1)[0].alias("parent"), ((F.col("n_convs") - 1) * words).alias("own"))
    below = Window.partitionBy("leaf").orderBy(depth.desc()).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("saved_tokens", F.sum("own").over(below))
    return rows.select("depth", "key", "parent", "conv_id", "n_convs", (depth < F.col("last")).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"), "saved_tokens", (depth == F.col("cut") + 1).alias("top"), "leaf")


def _peeled(entering: DataFrame, depth: int) -> list[DataFrame]:
    """Node tables from ``depth`` up to the root; ``entering`` has what joins the survivors at each depth."""
    sums = ("n_convs", "n_children", "n_leaves", "saved_tokens")
    levels: list[DataFrame] = []
    while depth >= 0:
        rows = entering.where(F.col("depth") == depth).drop("depth")
        if levels:
            last = levels[-1]
            stripped = F.substring("path", F.lit(1), F.lit(depth * ELEMENT))
            rows = rows.unionByName(last.select(stripped.alias("path"), "conv_id", "n_convs", F.lit(1).cast("long").alias("n_children"), "n_leaves", "saved_tokens"))
        found = rows.groupBy("path").agg(F.min("conv_id").alias("conv_id"), *(F.sum(c).alias(c) for c in sums))
        own = (F.col("n_convs") - 1) * _element("path", F.lit(depth))[1]
        found = found.withColumns({"n_leaves": F.when(F.col("n_children") == 0, 1).otherwise(F.col("n_leaves")), "saved_tokens": F.col("saved_tokens") + own})
        levels.append(written(found.withColumn("depth", F.lit(depth)), "level"))
        depth -= 1
    return levels


def _ends(members: DataFrame) -> DataFrame:
    """(key, ends_sha256) over the ascending ids of each key's members; ids are laid out in parts, then hashed part by part."""

    def lay_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, ids = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            starts = [k for k in range(len(keys)) if not k or keys[k] != keys[k - 1]]
            runs = list(zip(starts, [*starts[1:], len(keys)], strict=True))
            texts = [",".join(map(str, ids[a:b])) for a, b in runs]
            yield pa.RecordBatch.from_arrays([pa.array([keys[a] for a, _ in runs], pa.binary()), pa.array([ids[a] for a, _ in runs], pa.int64()), pa.array(texts, pa.string())], names=["key", "first", "ids"])

    def hash_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state = None, None
        for batch in batches:
            keys, hashes = [], []
            for key, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if key == current:
                    state.update(b"," + ids.encode())
                    continue
                if state is not None:
                    keys.append(current)
                    hashes.append(state.hexdigest())
                current, state = key, hashlib.sha256(ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(hashes, pa.string())], names=["key", "ends_sha256"])
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([current], pa.binary()), pa.array([state.hexdigest()])], names=["key", "ends_sha256"])

    parts = members.repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id").mapInArrow(lay_out, "key binary, first long, ids string")
    return parts.repartition("key").sortWithinPartitions("key", "first").mapInArrow(hash_up, "key binary, ends_sha256 string")


def trie(turns: DataFrame) -> DataFrame:
    """One row per node of (key, turns): conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    paths = written(_paths(turns), "paths")
    depth = (F.length("path") / ELEMENT).cast("int")
    ends = paths.groupBy("path").agg(F.min("key").alias("conv_id"), F.count("*").alias("n_convs")).withColumn("depth", depth)
    most = paths.agg(F.max(depth)).first()[0]
    if most is None:
        most = -1
    zero = F.lit(0).cast("long")
    counts = ["conv_id", "n_convs"]
    tails = None
    if most > DEEP:
        ends = written(_with_cuts(ends), "ends")
        tails = written(_tails(ends), "tails")
        whole = ends.where(F.col("cut").isNull())
        leaf = _element("path", F.col("depth"))[0]
        cut = ends.where(F.col("cut").isNotNull()).withColumn("leaf", leaf).join(tails.where("top").select("leaf", "saved_tokens"), "leaf")
        path = F.substring(F.col("path"), F.lit(1), F.col("cut") * ELEMENT)
        entering = whole.select("depth", "path", *counts, zero.alias("n_children"), zero.alias("n_leaves"), zero.alias("saved_tokens"))
        entering = entering.unionByName(cut.select(F.col("cut").alias("depth"), path.alias("path"), *counts, (zero + 1).alias("n_children"), (zero + 1).alias("n_leaves"), "saved_tokens"))
    else:
        entering = ends.select("depth", "path", *counts, zero.alias("n_children"), zero.alias("n_leaves"), zero.alias("saved_tokens"))
    entering = written(entering, "entering", by=["depth"])
    if tails is not None:
        most = entering.agg(F.max("depth")).first()[0]
    columns = ["depth", "key", "parent", "conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    nodes = None
    for level in _peeled(entering, most):
        own, above = _element("path", F.col("depth"))[0], _element("path", F.col("depth") - 1)[0]
        level = level.withColumns({"key": own, "parent": F.when(F.col("depth") > 0, above)}).select(columns)
        nodes = level if nodes is None else nodes.unionByName(level)
    if tails is not None:
        nodes = nodes.unionByName(tails.select(columns))
    if nodes is None:
        kind = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
        return turns.sparkSession.createDataFrame([], kind)
    # the children of a node are dealt over salts, each of which meets the node's id once
    kids = nodes.withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(_SALTS)))
    parents = nodes.where("n_children > 0").select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    met = kids.where(F.col("parent").isNotNull()).select("parent", "salt").distinct().join(parents, "parent")
    hashes = _ends(paths.select(_element("path", depth)[0].alias("key"), F.col("key").alias("conv_id")))
    out = kids.join(met, ["parent", "salt"], "left").join(hashes, "key", "left")
    return out.select("conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(_EMPTY)).alias("ends_sha256"))


def oracle(every: int = 20, most: int = 4) -> str:
    """DuckDB SQL of ``trie(with_shared_heads(turns_of(conversations)))``; CRC-32 is computed bit by bit."""
    digit = "list_reduce(range(8), lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END, xor(crc, ascii(s[i])::BIGINT))"
    crc = f"xor(list_reduce(range(1, length(s) + 1), lambda crc, i: {digit}, 4294967295::BIGINT), 4294967295::BIGINT)"
    return f"""
WITH turns AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i, md5(coalesce(role, '')) || md5(coalesce(text, '')) AS own,
    len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS words
  FROM conversations WHERE conv_id IS NOT NULL),
ids AS (SELECT conv_id, {crc} % {most} AS h FROM (SELECT DISTINCT conv_id, CAST(conv_id AS VARCHAR) AS s FROM turns)),
rebuilt AS (
  SELECT a.conv_id, 0 AS part, b.i, b.own, b.words FROM ids a JOIN turns b ON b.conv_id = a.conv_id - a.conv_id % {every} AND b.i <= a.h
  UNION ALL SELECT a.conv_id, 1, b.i, b.own, b.words FROM ids a JOIN turns b ON b.conv_id = a.conv_id AND b.i > a.h),
lists AS (
  SELECT ids.conv_id, coalesce(list(own ORDER BY part, i) FILTER (own IS NOT NULL), []) AS own, coalesce(list(words ORDER BY part, i) FILTER (own IS NOT NULL), []) AS words
  FROM ids LEFT JOIN rebuilt USING (conv_id) GROUP BY ALL),
prefixes AS (SELECT conv_id, own, words, unnest(range(len(own) + 1)) AS depth FROM lists),
nodes AS (
  SELECT own[1:depth] AS path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(CASE WHEN depth = 0 THEN 0 ELSE words[depth] END) AS last_words,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (len(own) = depth), '')) AS ends_sha256
  FROM prefixes GROUP BY path, depth),
kids AS (SELECT path[1:depth - 1] AS path, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY ALL),
counted AS (SELECT nodes.*, coalesce(kids.n, 0) AS n_children FROM nodes LEFT JOIN kids USING (path)),
above AS (SELECT path[1:d] AS path, n_children, (n_convs - 1) * last_words AS saved FROM (SELECT *, unnest(range(depth + 1)) AS d FROM counted)),
sums AS (SELECT path, count(*) FILTER (n_children = 0) AS n_leaves, sum(saved) AS saved_tokens FROM above GROUP BY path)
SELECT a.conv_id, a.depth, p.conv_id AS parent_conv_id, a.n_convs, a.n_children, s.n_leaves, CAST(s.saved_tokens AS BIGINT) AS saved_tokens, a.ends_sha256
FROM counted a JOIN sums s USING (path) LEFT JOIN nodes p ON a.depth > 0 AND p.path = a.path[1:a.depth - 1]"""
