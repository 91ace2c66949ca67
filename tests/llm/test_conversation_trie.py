"""The conversation trie and its subtree totals against plain versions."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from longspan.llm.contraction import subtree_sums
from longspan.llm.op12_conversation_trie import conversation_trie, id_digests


def brute(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            code = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            own[conv].append((turn is not None, turn or 0, role, code, text))
    told = {c: [(v[2], v[4]) for v in sorted(turns)] for c, turns in own.items()}
    rebuilt = {}
    for c in told:
        h, base = zlib.crc32(str(c).encode()) % 9, c - (abs(c) % 5) * (1 if c >= 0 else -1)
        rebuilt[c] = tuple(told.get(base, [])[:h] + told[c][h:])
    members, kids, leaves, saved = defaultdict(list), defaultdict(list), {}, {}
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    for node in members:
        if node:
            kids[node[:-1]].append(node)
    for node in sorted(members, key=len, reverse=True):
        leaves[node] = sum(leaves[k] for k in kids[node]) if kids[node] else 1
        saved[node] = sum(saved[k] for k in kids[node]) + ((len(members[node]) - 1) * len(node[-1][1].encode()) if node else 0)
    out = []
    for node, convs in members.items():
        ends = ",".join(str(c) for c in sorted(convs) if rebuilt[c] == node)
        above = min(members[node[:-1]]) if node else None
        sums = leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()
        out.append((min(convs), len(node), above, len(convs), len(kids[node]), *sums))
    return sorted(out, key=str)


def trie(spark, rows, clash=("depth", "name", "n", "place", "code", "n_bytes")):
    frame = spark.createDataFrame([(*r, *["own"] * len(clash)) for r in rows], "conv_id bigint, turn bigint, role string, text string" + "".join(f", {c} string" for c in clash))
    return sorted((tuple(r) for r in conversation_trie(frame).collect()), key=str)


def test_odd_conversations(spark):
    """Nulls in every column, ties, equal rows, negative ids, absent bases, turnless conversations
    and one long conversation that takes most rows."""
    rng = random.Random(4)
    rows = [(None, 1, "user", "lost"), (5, None, None, None), (5, 1, "user", "é" * 30), (5, 1, "user", "é" * 30), (5, 1, "bot", "tie"), (5, 1, "bot", "tied")]
    rows += [(c, t, rng.choice(["user", "bot"]), rng.choice("ab")) for c in (*range(-7, 30), 1001, 1007) for t in range(rng.randrange(1, 11))]
    rows += [(40, t, "user", f"turn {t % 3}") for t in range(700)] + [(c, t, "user", "same") for c in range(50, 75) for t in range(9)]
    got = trie(spark, rows)
    assert got == brute(rows)
    assert any(r[1] > 600 for r in got)


def test_no_conversation(spark):
    assert trie(spark, []) == [] == trie(spark, [(None, 1, "user", "x")])


@pytest.mark.parametrize("shape", ["random", "path", "star", "comb", "forest"])
def test_subtree_sums(spark, shape):
    rng = random.Random(shape)
    n = 400
    above = {
        "random": lambda k: rng.randrange(k), "path": lambda k: k - 1, "star": lambda k: 0,
        "comb": lambda k: k - 2 if k % 2 == 0 else k - 1, "forest": lambda k: rng.randrange(max(0, k - 3), k) if k % 50 else None,
    }[shape]
    parent = {0: None, **{k: above(k) for k in range(1, n)}}
    own = {k: (rng.randrange(100), 1) for k in parent}
    total = {k: list(v) for k, v in own.items()}
    for k in sorted(parent, reverse=True):
        if parent[k] is not None:
            for i in (0, 1):
                total[parent[k]][i] += total[k][i]
    frame = spark.createDataFrame([(k, p, *own[k]) for k, p in parent.items()], "node bigint, parent bigint, a bigint, b bigint")
    got = {r.node: [r.a, r.b] for r in subtree_sums(frame, ["a", "b"]).collect()}
    assert got == total


def test_digest_of_ids_over_many_ranges(spark):
    """A name whose ids reach over all ranges is digested like the others."""
    frame = spark.range(5000).selectExpr("struct(if(id < 4000, 0, id % 7) as depth) as name", "id * 3 as conv_id")
    want = defaultdict(list)
    for k in range(5000):
        want[0 if k < 4000 else k % 7].append(3 * k)
    got = {r.name.depth: r.sha256 for r in id_digests(frame).collect()}
    assert got == {d: hashlib.sha256(",".join(map(str, sorted(v))).encode()).hexdigest() for d, v in want.items()}
