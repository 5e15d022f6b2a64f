import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from kinetrove.llm import prefix_trie
from kinetrove.llm.oracles import ORACLES
from kinetrove.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def brute_rebuilt(rows):
    own = defaultdict(list)
    for r in rows:
        if r.conv_id is not None:
            role, text = r.role or "", r.text or ""
            key = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()[:12]
            own[r.conv_id].append(((r.turn is not None, r.turn or 0), __import__("base64").b64encode(key), (role, text)))
    own = {c: [t for _, _, t in sorted(x)] for c, x in own.items()}
    h = {c: zlib.crc32(str(c).encode()) % 6 for c in own}
    return {c: own.get(c - c % 100, [])[: h[c]] + own[c][h[c] :] for c in own}


def brute_trie(convs):
    nodes = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            nodes[tuple(turns[:d])].append(c)
    found = {}
    for key in sorted(nodes, key=len, reverse=True):
        kids = [found[k] for k in nodes if len(k) == len(key) + 1 and k[:-1] == key]
        ends = ",".join(str(c) for c in sorted(nodes[key]) if len(convs[c]) == len(key))
        saved = (len(nodes[key]) - 1) * (len(key[-1][1]) if key else 0) + sum(k["saved"] for k in kids)
        found[key] = {"n": len(nodes[key]), "kids": len(kids), "leaves": sum(k["leaves"] for k in kids) or 1, "saved": saved, "sha": hashlib.sha256(ends.encode()).hexdigest()}
    return sorted(
        (min(nodes[k]), len(k), min(nodes[k[:-1]]) if k else None, x["n"], x["kids"], x["leaves"], x["saved"], x["sha"]) for k, x in found.items()
    )


def key(rows):
    return sorted(tuple(r) for r in rows)


@pytest.mark.parametrize("options", [{}, {"cells": 30}, {"cells": 7, "shard_turns": 9}])
def test_nodes_equal_brute_force(spark, options):
    rng, rows = random.Random(len(options)), []
    for c in [*range(0, 130), *range(200, 240), *range(1000, 1060)]:
        kind = rng.random()
        turns = ["hi", "same", "more"] + ["x"] * 3 if kind < 0.3 else [rng.choice("abc") for _ in range(rng.choice((1, 2, 4, 9)))]
        rows += [(c, t, "user" if t % 2 == 0 else "bot", x) for t, x in enumerate(turns)]
    rows += [(1100, t, "user", f"long {t % 3}") for t in range(60)] + [(1101, t, "user", f"long {t % 3}") for t in range(50)]
    rng.shuffle(rows)
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    want = brute_trie(brute_rebuilt(turns.collect()))
    assert key(prefix_trie.prefix_trie(turns, **options).collect()) == key(want)


def test_given_table_and_sql(spark, sql):
    turns = spark.read.parquet(f"{SF}/conversations.parquet")
    got = QUERIES["op12_prefix_trie"](spark, SF)
    want = brute_trie(brute_rebuilt(turns.collect()))
    assert got.columns == [f.split()[0] for f in prefix_trie.TRIE_SCHEMA.split(", ")]
    assert key(got.collect()) == key(want)
    other = sql(ORACLES["op12_prefix_trie"])
    assert sorted(other.columns) == sorted(got.columns)
    assert key(other.select(", ".join(got.columns)).fetchall()) == key(want)


def test_odd_rows(spark):
    rows = [
        (None, 0, "user", "a"), (1, None, None, None), (1, 0, "user", "a"), (1, 0, "user", "a"), (2, 3, "", "é漢🙂"), (-5, 1, "user", "a"), (-100, 0, "user", "z"), (9, 0, "user", " "),
        (200, 0, "user", "w " * 30_000), (207, 0, "user", "w " * 30_000), (300, 1, "a", "bc"), (301, 1, "ab", "c"),
    ]
    turns = spark.createDataFrame([(*r, "s", 1, 2) for r in rows], "conv_id long, turn long, role string, text string, seq string, size int, depth int")
    # The remainder of a negative number keeps its sign, as in SQL.
    convs = {c: t for c, t in brute_rebuilt([r for r in turns.collect() if (r.conv_id or 0) >= 0]).items()}
    own = {-5: [("user", "a")], -100: [("user", "z")]}
    for c, base in ((-5, convs_of(rows, 0)), (-100, own[-100])):
        h = zlib.crc32(str(c).encode()) % 6
        convs[c] = base[:h] + own[c][h:]
    assert key(prefix_trie.prefix_trie(turns).collect()) == key(brute_trie(convs))
    nothing = prefix_trie.prefix_trie(turns.where("false"))
    assert nothing.count() == 0 and nothing.columns == [f.split()[0] for f in prefix_trie.TRIE_SCHEMA.split(", ")]


def convs_of(rows, c):
    return [(r[2] or "", r[3] or "") for r in rows if r[0] == c]
