"""The compressed trie against a trie of dictionaries."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from kinforge.llm import tries

SCHEMA = "conv_id long, turn long, role string, text string"


def plain(rows, siblings=None, heads=4):
    """Every prefix of every conversation, one by one."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()
            own[c].append(((turn is not None, turn or 0), role, digest, text))
    own = {c: [(r, t) for _, r, _, t in sorted(v)] for c, v in own.items()}
    full = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % heads
        first = c - (c % siblings if c >= 0 else -(-c % siblings)) if siblings else c
        full[c] = own.get(first, [])[:h] + v[h:] if siblings else v
    members = defaultdict(list)
    for c, v in full.items():
        for d in range(len(v) + 1):
            members[tuple(v[:d])].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    out = []
    totals = {}
    for node in sorted(members, key=len, reverse=True):
        words = len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
        leaves = sum(totals[x][0] for x in children[node]) or 1
        saved = sum(totals[x][1] for x in children[node]) + (len(members[node]) - 1) * words
        totals[node] = leaves, saved
        ends = ",".join(map(str, sorted(c for c in members[node] if len(full[c]) == len(node))))
        out.append((min(members[node]), len(node), min(members[node[:-1]]) if node else None, len(members[node]), len(children[node]), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def nodes(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def conversations(seed, n=120, texts=3, turns=6):
    """Few texts, so that prefixes repeat; copies, empty texts, nulls, ties."""
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-30, 400), n):
        for k in range(rng.choice([1, 1, 2, 3, turns])):
            rows.append((c, rng.choice([k, k, k, None]), rng.choice(["user", "assistant", None]) if rng.random() < 0.2 else "user", rng.choice(["", None, "a b  c", "d\x0be", *[f"w{i} x" for i in range(texts)]])))
    return rows + rows[:5] + [(None, 0, "user", "nobody")]


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("siblings", [None, 20])
def test_same_nodes_as_plain_trie(spark, monkeypatch, seed, siblings):
    rows = conversations(seed)
    monkeypatch.setattr(tries, "RUN", 15)  # many runs, so that points are shared
    monkeypatch.setattr(tries, "CHUNK", 2)
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(1) for c in ("path", "words", "key", "depth", "part", "kind", "head", "h", "t", "saved")}).repartition(3)
    assert nodes(tries.trie(df, siblings)) == plain(rows, siblings)


@pytest.mark.parametrize("runs", [1, 2, 5, 11, 40])
def test_runs_meet_at_their_ends(spark, runs):
    """Copies of one conversation, its prefixes and its continuations over several runs."""
    rows = [(c, k, "user", f"t{k}") for c in range(60) for k in range(4 if c < 40 else c - 39)] + [(100 + c, k, "user", "t0" if k < 2 else f"{c} {k}") for c in range(10) for k in range(c + 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    old = tries.RUN
    try:
        tries.RUN = -(-70 // runs)
        assert nodes(tries.trie(df)) == plain(rows)
    finally:
        tries.RUN = old


def test_long_conversations_and_empty_tables(spark):
    assert tries.trie(spark.createDataFrame([], SCHEMA), 20).count() == 0
    assert tries.trie(spark.createDataFrame([(None, 1, "a", "b")], SCHEMA)).count() == 0
    rows = [(c, k, "user", f"{k} words" if k < 1500 or c else "end") for c in range(3) for k in range(2000 - c)] + [(9, 0, "user", "long " * 50_000)]
    assert nodes(tries.trie(spark.createDataFrame(rows, SCHEMA))) == plain(rows)


def test_conversations_left_without_turns(spark):
    """A conversation shorter than the head that it should borrow from a missing one has no turns."""
    rows = [(c, 0, "user", "x y") for c in range(21, 40)]
    got = nodes(tries.trie(spark.createDataFrame(rows, SCHEMA), 20))
    assert got == plain(rows, 20) and any(r[1] == 0 and r[7] != tries.NOTHING for r in got)


def test_points_are_fewer_than_nodes():
    """Only branches, ends, leaves and the two paths at a run's edges become rows."""
    path = lambda *turns: b"".join(hashlib.md5(t.encode()).digest() for t in turns)
    import numpy as np

    convs = sorted((path("a", *[f"{c}-{k}" for k in range(30)]), c) for c in range(50))
    made = [r for r in tries.Run(0).tree((c, p, np.ones(len(p) // 16, np.int64)) for p, c in convs) if r["kind"] == "point"]
    assert len(made) == 48 + 2 * 30 + 2  # leaves inside, both edge paths below the branch, the branch, the root
    assert sum(len(r["below"]) for r in made) == 50 * 30 + 2
