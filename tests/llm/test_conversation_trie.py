import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyroom.llm import conversation_trie as ct
from tallyroom.llm import queries
from tests.compare import compare, connect

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows, block=100, shares=6):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, (role or "").encode(), (text or "").encode(), role or "", text or ""))
    turns = {c: [x[-2:] for x in sorted(v)] for c, v in own.items()}
    paths = {}
    for c, t in turns.items():
        h = zlib.crc32(str(c).encode()) % shares
        paths[c] = t if block is None else turns.get(c - int(np.fmod(c, block)), [])[:h] + t[h:]
    members = defaultdict(list)
    for c, p in paths.items():
        for d in range(len(p) + 1):
            members[tuple(p[:d])].append(c)
    children = defaultdict(list)
    for n in members:
        if n:
            children[n[:-1]].append(n)
    leaves, saved = defaultdict(int), defaultdict(int)
    for n, m in members.items():
        for d in range(len(n) + 1):
            leaves[n[:d]] += not children[n]
            saved[n[:d]] += (len(m) - 1) * (len(n[-1][1]) if n else 0)
    out = []
    for n, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(paths[c]) == len(n))
        out.append((min(m), len(n), min(members[n[:-1]]) if n else None, len(m), len(children[n]), leaves[n], saved[n], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def got(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=repr)


def tree(seed, convs, words, longest):
    rng = random.Random(seed)
    return [(c, t, rng.choice("ua"), rng.choice(words)) for c in convs for t in range(rng.randrange(longest + 1))]


@pytest.mark.parametrize("seed, block", [(1, 100), (2, None), (3, 100)])
def test_against_brute_force(spark, seed, block):
    rng = random.Random(seed)
    rows = tree(seed, range(300), ["a", "bb", "", "é🙂"], 5) + tree(seed + 9, [rng.randrange(-500, 10**12) for _ in range(50)], ["a", "bb"], 9)
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, SCHEMA)
    assert got(ct.prefix_trie(df, block)) == brute(rows, block)


def test_hot_parent_and_long_conversation(spark, monkeypatch):
    """A third of all turns in one conversation, a third of all nodes under one parent; stretches and tasks smaller than both."""
    monkeypatch.setattr(ct, "STRETCH", 16)
    rows = [(7, t, "user", f"t{t % 5}") for t in range(500)] + [(c, t, "user", "same" if t == 0 else f"own {c}") for c in range(1000, 1500) for t in range(2)] + tree(4, range(2000, 2200), ["x", "y"], 4)
    df = spark.createDataFrame(rows, SCHEMA).repartition(7)
    assert got(ct.prefix_trie(df, None)) == brute(rows, None)
    assert got(ct.prefix_trie(df)) == brute(rows)


def test_tour_positions_nest(spark):
    rows = tree(5, range(120), ["a", "b"], 5)
    nodes = ct.prefix_trie(spark.createDataFrame(rows, SCHEMA), None).collect()
    at = sorted([r.enter_at for r in nodes] + [r.exit_at for r in nodes])
    assert at == list(range(2 * len(nodes)))
    by = {(r.conv_id, r.depth): r for r in nodes}
    for r in nodes:
        assert r.enter_at < r.exit_at
        if r.depth:
            up = by[r.parent_conv_id, r.depth - 1]
            assert up.enter_at < r.enter_at and r.exit_at < up.exit_at


def test_contract_in_pieces():
    """However the nodes are dealt, the stretches hold each arc once and their links form one list."""
    # root(0,0) - (0,1) - (0,2), and (5,1) under the root
    conv, depth = np.array([0, 0, 0, 5]), np.array([0, 1, 2, 1])
    child, sibling, parent = np.array([0, 0, -1, -1]), np.array([-1, 5, -1, -1]), np.array([0, 0, 0, 0])
    w = np.ones((8, 3), np.int64)
    for deal in ([0, 0, 0, 0], [0, 1, 0, 1], [0, 1, 2, 3]):
        links, arcs = {}, 0
        for p in set(deal):
            i = np.flatnonzero(np.array(deal) == p)
            rows = np.stack([2 * i, 2 * i + 1], 1).ravel()
            s, before, heads, whole, nc, nd = ct.contract(conv[i], depth[i], child[i], sibling[i], parent[i], w[rows])
            arcs += whole[:, 0].sum()
            for h, c, d in zip(heads, nc, nd):
                links[int(conv[i][h // 2]), int(2 * depth[i][h // 2] + h % 2)] = (int(c), int(d))
        at, steps = (0, 0), 0
        while at in links:
            at, steps = links[at], steps + 1
        assert arcs == 8 and steps == len(links) and at[1] == -1


def test_odd_rows(spark):
    rows = [(1, None, None, None), (1, 0, "user", "hi"), (1, 0, "user", "hi"), (1, 0, "bot", "hi"), (2, 5, "user", ""), (None, 1, "user", "lost"), (205, 0, "user", "x" * 50_000), (-3, 1, None, "neg"), (100, 0, "u", "base"), (101, 0, "u", "own"), (199, 3, "u", "last")]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({n: F.lit("clash") for n in ("depth", "pos", "a", "h1", "part", "length", "next", "base", "at", "chars")})
    assert got(ct.prefix_trie(df)) == brute(rows)
    assert got(ct.prefix_trie(df, None)) == brute(rows, None)
    assert ct.prefix_trie(df.limit(0)).count() == 0


def test_sql(spark):
    sf = "/root/testdata/sf0.01"
    assert compare(spark, connect(sf), queries.op13_conversation_trie, queries.ORACLE_SQL["op13_conversation_trie"], sf) > 300
