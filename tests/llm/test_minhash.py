import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinetrove.llm import minhash


def brute_set(text):
    words = (text or "").encode().lower().split()
    return frozenset(b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def brute(rows, percent=85):
    sets = [brute_set(r.text) for r in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= percent * len(a | sets[j]):
                parent[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r.doc_id is not None:
            least[find(i)] = min(least.get(find(i), r.doc_id), r.doc_id)
    return sorted(((r.doc_id, len(s), least.get(find(i)), r.doc_id == least.get(find(i))) for i, (r, s) in enumerate(zip(rows, sets))), key=str)


def found(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in df.collect()), key=str)


def edited(rng, words, n):
    words = list(words)
    for k in rng.sample(range(len(words)), n):
        words[k] = f"x{rng.random()}"
    return " ".join(words)


@pytest.fixture(scope="module")
def copies(spark):
    """Chains and stars of near copies, many of them around the wanted similarity."""
    rng, rows = random.Random(5), []
    for group in range(6):
        base = [f"g{group}w{rng.randrange(400)}" for _ in range(150 + 60 * group)]
        rows += [edited(rng, base, rng.choice((0, 1, 1, 2, 3, 4, 5))) for _ in range(30)]
        for _ in range(10):
            base = edited(rng, base, 1).split()
            rows.append(" ".join(base))
    rows += [" ".join(f"s{k}v{i}" for i in range(40)) + " " + " ".join(f"common{i}" for i in range(60)) for k in range(20)]
    return spark.createDataFrame([(k, t) for k, t in enumerate(rows)], "doc_id long, text string")


def test_components_equal_brute_force_on_near_copies(copies):
    want = brute(copies.collect())
    assert found(minhash.near_duplicates(copies, block=7)) == want
    assert 20 < len({c for _, _, c, _ in want}) < 200


def test_components_equal_brute_force_on_documents(documents):
    near = documents.limit(60).withColumn("text", F.concat("text", F.lit(" one more tail"))).withColumn("doc_id", F.col("doc_id") + 10_000)
    docs = documents.unionByName(near)
    assert found(minhash.near_duplicates(docs)) == brute(docs.collect())


def test_odd_rows(odd, empty):
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in minhash.near_duplicates(odd).collect()), key=str)
    assert got == sorted(((a, b, c) for a, b, c, _ in brute_odd(odd.collect())), key=str)
    assert minhash.near_duplicates(empty).count() == 0
    assert minhash.near_duplicates(empty).columns == ["doc_id", "n_shingles", "component_id", "kept"]


def brute_odd(rows, percent=85):
    """Empty sets are linked with nothing: each such row stands for itself."""
    filled = [r for r in rows if brute_set(r.text)]
    return brute(filled, percent) + [(r.doc_id, 0, r.doc_id, True) for r in rows if not brute_set(r.text)]


def test_sketch_estimates_similarity_and_bands_meet():
    rng = np.random.default_rng(1)
    limit, missed, met = minhash.most_odd(85), 0, 0
    for _ in range(60):
        pool = rng.integers(0, 1 << 63, 460, np.uint64)
        a, b = pool[:425], np.concatenate([pool[35:], pool[:0]])
        j = len(np.intersect1d(a, b)) / 460
        assert 0.84 < j < 0.86
        sa, sb = minhash.samples(np.sort(a)), minhash.samples(np.sort(b))
        odd = int(np.bitwise_count(minhash.odd_sketch(sa) ^ minhash.odd_sketch(sb)).sum())
        missed += odd > limit
        met += bool((minhash.band_keys(sa) == minhash.band_keys(sb)).any())
        unshared = -minhash.BITS / 2 * np.log(1 - 2 * odd / minhash.BITS)
        assert abs(1 - unshared / 2 / minhash.SAMPLES - j) < 0.12
    assert missed == 0 and met == 60
    far = [minhash.odd_sketch(minhash.samples(rng.integers(0, 1 << 63, 300, np.uint64))) for _ in range(2)]
    assert int(np.bitwise_count(far[0] ^ far[1]).sum()) > limit


def test_shingles_are_told_apart_as_word_sequences():
    assert len(minhash.shingles(b"", 5)) == len(minhash.shingles(b" \n", 5)) == 0
    assert len(minhash.shingles(b"a b", 5)) == 1
    assert minhash.shingles(b"A  b", 5) == minhash.shingles(b"a b", 5) != minhash.shingles(b"b a", 5)
    text = ("a b c d e f " * 50).encode()
    assert len(minhash.shingles(text, 5)) == len(brute_set(text.decode()))
    assert minhash.shingles("É".encode(), 5) != minhash.shingles("é".encode(), 5)


def test_members_meet_their_parts_once(spark):
    rng = random.Random(8)
    rows = [(part, 1000 * part + i, 1000 * part + (i if i % 3 else 0), bytes([rng.randrange(4)])) for part in range(4) for i in range(50)]
    table = spark.createDataFrame(rows, "part long, id long, comp long, payload binary")
    got = minhash.joined_in_blocks(table, lambda left, right: (np.array([a == b for b in right]) for a in left), 8)
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1
    # With what was together before, all of a part that are equal are together.
    joined = {i: comp for _, i, comp, _ in rows}
    forest = minhash.Forest()
    for u, v in got.collect():
        forest.join(joined[u], joined[v])
    want = minhash.Forest()
    for part, i, comp, payload in rows:
        for other, j, with_, same in rows:
            if part == other and payload == same:
                want.join(comp, with_)
    assert [forest.find(c) for c in joined.values()] == [want.find(c) for c in joined.values()]
