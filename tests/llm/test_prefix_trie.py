"""The prefix trie against brute force: nulls, ties, repeated rows, copies, deep conversations, empty tables, clashing names."""

import hashlib
import random
import re
import zlib

import duckdb
import pytest

from factloom.llm import prefix_trie

ROWS = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text))


def brute_nodes(lists):
    members, ends = {}, {}
    for c, turns in lists.items():
        ends.setdefault(tuple(turns), []).append(c)
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    kids = {}
    for path in members:
        if path:
            kids.setdefault(path[:-1], []).append(path)
    leaves, saved = dict.fromkeys(members, 0), dict.fromkeys(members, 0)
    for path, own in members.items():
        for d in range(len(path) + 1):
            leaves[path[:d]] += path not in kids
            saved[path[:d]] += (len(own) - 1) * words(path[-1][1]) if path else 0
    out = []
    for path, own in members.items():
        ids = ",".join(map(str, sorted(ends.get(path, []))))
        out.append((min(own), len(path), min(members[path[:-1]]) if path else None, len(own), len(kids.get(path, [])), leaves[path], saved[path], hashlib.sha256(ids.encode()).hexdigest()))
    return sorted(out, key=repr)


def brute_rebuilt(rows):
    own = {}
    for c, turn, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0)):
        own.setdefault(c, []).append((role or "", text or ""))
    h = {c: zlib.crc32(str(c).encode()) % 4 for c in own}
    return {c: own.get(c - c % 20, [])[: h[c]] + turns[h[c] :] for c, turns in own.items()}


def collected(df):
    return sorted((tuple(r) for r in df.select(COLUMNS).collect()), key=repr)


def conversations(seed, n=90):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        if c in (20, 45):
            continue
        for t in range(rng.choice([1, 1, 2, 3, 4, 7])):
            turn = None if t == 0 and rng.random() < 0.2 else t
            rows.append((c, turn, rng.choice(["user", "assistant", None]), rng.choice(["a b", "A", "", None, "x\ty  z\n", "é " * 3, "long " * 5000]) if t < 4 else f"turn {rng.randrange(3)}"))
    rows += [(None, 0, "user", "lost"), (1000, None, None, None), (1001, 5, "user", "x")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_trie_against_brute_force_and_sql(spark, seed):
    rows = conversations(seed)
    table = spark.createDataFrame(rows, ROWS).repartition(5).selectExpr("*", "1 AS key", "2 AS path", "3 AS depth", "4 AS salt")
    got = collected(prefix_trie.trie(prefix_trie.with_shared_heads(prefix_trie.turns_of(table))))
    assert got == brute_nodes(brute_rebuilt(rows))
    duck = duckdb.connect()
    duck.register("conversations", table.select("conv_id", "turn", "role", "text").toArrow())
    sql = duck.execute(f"SELECT {', '.join(COLUMNS)} FROM ({prefix_trie.oracle()})").fetchall()
    assert sorted(sql, key=repr) == got


def test_deep_conversations_that_share_a_beginning(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "DEEP", 4)
    rng = random.Random(5)
    base = [("user", f"w{k} x") for k in range(30)]
    lists = {}
    for c in range(40):
        cut = rng.choice([0, 2, 4, 5, 7, 8, 9, 16, 17, 30])
        lists[c] = base[:cut] + [("user", f"own {rng.randrange(3)} {c % 7} {k}") for k in range(rng.choice([0, 0, 1, 6, 25]))]
    lists |= {100: lists[7], 101: lists[7], 102: base, 103: [("a", "")] * 40}
    rows = [(c, k, *turn) for c, turns in lists.items() for k, turn in enumerate(turns)]
    turns = prefix_trie.turns_of(spark.createDataFrame(rows, ROWS))
    assert collected(prefix_trie.trie(turns)) == brute_nodes({c: t for c, t in lists.items() if t})


def test_ties_repeats_and_empty(spark):
    rows = [(1, 0, "user", "a b"), (1, 0, "user", "a b"), (1, 0, "assistant", "c"), (2, 3, "assistant", "c"), (2, 4, "user", "a b")]
    got = collected(prefix_trie.trie(prefix_trie.turns_of(spark.createDataFrame(rows, ROWS))))
    assert got == brute_nodes({1: [("assistant", "c"), ("user", "a b"), ("user", "a b")], 2: [("assistant", "c"), ("user", "a b")]})
    empty = prefix_trie.trie(prefix_trie.with_shared_heads(prefix_trie.turns_of(spark.createDataFrame([], ROWS))))
    assert empty.columns == COLUMNS and empty.count() == 0
