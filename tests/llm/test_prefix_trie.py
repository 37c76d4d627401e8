"""The prefix trie against a plain trie in memory."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from ledgerline.llm import prefix_trie
from ledgerline.operators import ordered

TURNS = "conv_id long, turn long, role string, text string, x long, pos long, depth long, block long"


def plain(paths):
    """Nodes of conversations given as tuples of (role, text)."""
    members, ends, kids = defaultdict(list), defaultdict(list), defaultdict(set)
    for conv, path in paths.items():
        for k in range(len(path) + 1):
            members[path[:k]].append(conv)
        for k in range(len(path)):
            kids[path[:k]].add(path[: k + 1])
        ends[path].append(conv)
    leaves, saved = defaultdict(int), defaultdict(int)
    for node, of in members.items():
        for k in range(len(node) + 1):
            leaves[node[:k]] += node not in kids
            saved[node[:k]] += (len(of) - 1) * len(node[-1][1].encode()) if node else 0
    digest = lambda node: hashlib.sha256(",".join(map(str, sorted(ends.get(node, [])))).encode()).hexdigest()
    return sorted(
        (min(of), len(n), min(members[n[:-1]]) if n else -1, len(of), len(kids.get(n, ())), leaves[n], saved[n], digest(n))
        for n, of in members.items()
    )


def built(turns, shared=False, block=prefix_trie.BLOCK):
    placed = prefix_trie.turn_digests(turns)
    parts = prefix_trie.with_shared_starts(placed) if shared else (placed, None)
    trie = prefix_trie.prefix_trie(*parts, block=block)
    nodes = prefix_trie.with_parent(trie.nodes).join(prefix_trie.end_digests(trie.ends), prefix_trie.NODE, "left")
    return sorted(
        tuple(r)
        for r in nodes.select(
            "conv_id", "depth", F.coalesce("parent_conv_id", F.lit(-1)), "n_convs", "n_children", "n_leaves", "saved",
            F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)),
        ).collect()
    )


def make(spark, convs):
    rows = [(c, t, r, x, 1, 2, 3, 4) for c, turns in convs.items() for t, r, x in turns]
    return spark.createDataFrame(rows, TURNS).repartition(4)


def random_convs(seed, n=60, longest=11):
    rng = random.Random(seed)
    return {
        c: [(t, rng.choice(["u", "a", None]), rng.choice(["", "hé", None, "yes"])) for t in range(rng.randrange(1, longest))]
        for c in rng.sample(range(-40, 200), n)
    }


def said(turns):
    return tuple((r or "", x or "") for _, r, x in turns)


@pytest.mark.parametrize("block", [1, 3, 4])
def test_trie_equals_a_plain_one(spark, block):
    convs = random_convs(block)
    assert built(make(spark, convs), block=block) == plain({c: said(t) for c, t in convs.items()})


def test_busy_conversations_and_nodes_are_cut_alike(spark, cut_all):
    convs = random_convs(9, 20)
    convs[500] = convs[501] = [(t, "u", str(t % 3)) for t in range(60)]
    want = plain({c: said(t) for c, t in convs.items()})
    assert built(make(spark, convs)) == want


def test_half_of_all_conversations_are_one(spark, monkeypatch):
    monkeypatch.setattr(ordered, "HOT_ROWS", 200)
    convs = {c: [(0, "u", "same"), (1, "a", "answer")] for c in range(1_500)}
    convs |= {5_000 + c: [(0, "u", "same"), (1, "a", str(c))] for c in range(300)}
    assert built(make(spark, convs)) == plain({c: said(t) for c, t in convs.items()})


def test_rebuilt_conversations(spark):
    rng = random.Random(4)
    convs = {
        c: [(t, rng.choice("ua"), rng.choice(["x", "yy"])) for t in range(rng.choice([1, 1, 3, 8]))]
        for c in rng.sample(range(-20, 90), 60)
    }
    paths = {}
    for c in convs:
        h = zlib.crc32(str(c).encode()) % 9
        first = c - (c % 5 if c >= 0 else -(-c % 5))
        paths[c] = said(convs.get(first, [])[:h]) + said(convs[c][h:])
    assert any(not p for p in paths.values())
    assert built(make(spark, convs), shared=True) == plain(paths)


def test_null_turns_come_first_repeats_count_and_rows_without_id_go(spark):
    convs = {1: [(None, "u", "first"), (0, "u", "second")], 2: [(3, "u", "first"), (3, "u", "first")], None: [(0, "u", "x")]}
    want = plain({1: (("u", "first"), ("u", "second")), 2: (("u", "first"), ("u", "first"))})
    assert built(make(spark, convs)) == want


def test_no_conversation_gives_no_node(spark):
    assert built(spark.createDataFrame([], TURNS)) == []
    assert built(spark.createDataFrame([(None, 0, "u", "x", 1, 1, 1, 1)], TURNS), shared=True) == []


def test_texts_of_nodes(spark):
    placed = prefix_trie.turn_digests(make(spark, {1: [(0, "u", "a"), (1, "a", "b")], 2: [(0, "u", "a")]}))
    texts = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "a")], "conv_id long, pos long, text string")
    nodes = prefix_trie.last_turns(prefix_trie.prefix_trie(placed).nodes, texts)
    assert sorted((r.depth, r.text, r.n_convs) for r in nodes.collect()) == [(1, "a", 2), (2, "b", 1)]
