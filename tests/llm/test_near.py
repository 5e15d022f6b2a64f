import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from kinetrove.llm import golay, minhash, simhash
from kinetrove.llm.components import components
from tests.llm.test_minhash import brute, brute_odd, brute_set, edited, found


def test_golay_code_is_perfect():
    of_bit, count, errors = golay.tables()
    words = np.arange(1 << 23)
    low, high = golay._halves()
    codewords = words[(low[words & 0xFFF] ^ high[words >> 12]) == 0]
    assert len(codewords) == 4096
    weights = np.bitwise_count(codewords)
    assert sorted(set(weights.tolist())) == [0, 7, 8, 11, 12, 15, 16, 23]
    assert count.sum() == 1 + 23 + 253 + 6 * 1771
    for s in range(2048):
        for e in errors[s, : count[s]]:
            assert golay.syndrome(int(e)) == s
        assert bin(errors[s, 0]).count("1") <= 3


def test_neighbours_share_a_key():
    rng = np.random.default_rng(2)
    words = rng.integers(0, 1 << 23, 4000)
    own = golay.indices(words)
    for bit in range(-1, 23):
        other = words if bit < 0 else words ^ (1 << bit)
        rows, keys = golay.keys(other)
        met = np.zeros(len(words), bool)
        np.logical_or.at(met, rows, keys == own[rows])
        assert met.all()


def test_links_lose_no_pair(spark):
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(60)]
    prints = set(base) | {0, (1 << 64) - 1, 7, 1 << 63}
    for b in base:
        for n in (1, 2, 3, 3, 3, 4, 5):
            prints.add(b ^ sum(1 << k for k in rng.sample(range(64), n)))
    signed = [(p - (1 << 64) if p >> 63 else p,) for p in prints]
    got = {(r.u, r.v) for r in simhash.links(spark.createDataFrame(signed, "print long")).collect()}
    mask = (1 << 64) - 1
    want = {(a, b) for (a,) in signed for (b,) in signed if a < b and bin((a ^ b) & mask).count("1") <= 3}
    assert got == want and len(want) > 300


def test_components_of_paths_stars_and_rings(spark):
    rng = random.Random(4)
    links = [(i, i + 1) for i in range(200, 260)] + [(500, i) for i in range(501, 560)] + [(i, 900 + (i - 899) % 30) for i in range(900, 930)] + [(5, 5), (7, 3), (7, 3)]
    links = [(a, b) if rng.random() < 0.5 else (b, a) for a, b in links]
    got = dict(components(spark.createDataFrame(links, "u long, v long")).collect())
    assert got == {**dict.fromkeys(range(200, 261), 200), **dict.fromkeys(range(500, 560), 500), **dict.fromkeys(range(900, 930), 900), 7: 3, 3: 3}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_components_of_stars_take_no_round(spark, monkeypatch):
    """Every round is jobs and plans that the driver holds."""
    from kinetrove.llm import components as module

    seen = []
    monkeypatch.setattr(module, "stage", lambda df, name, f=module.stage: seen.append(name) or f(df, name))
    links = [(i, 100 * (i // 100)) for i in range(400) if i % 100] + [(1001, 1000)]
    got = dict(module.components(spark.createDataFrame(links, "u long, v long")).collect())
    assert got == {**{i: 100 * (i // 100) for i in range(400)}, 1000: 1000, 1001: 1000}
    assert seen.count("links") == 1
    assert module.components(spark.createDataFrame([], "u long, v long")).count() == 0 and seen.count("links") == 2


def brute_print(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 3]), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_classes(rows):
    prints = [brute_print(r.text) for r in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= 3:
                parent[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r.doc_id is not None:
            least[find(i)] = min(least.get(find(i), r.doc_id), r.doc_id)
    return [(r.doc_id, f"{p:016x}", least.get(find(i))) for i, (r, p) in enumerate(zip(rows, prints))]


def key(rows):
    return sorted((str(a), b, str(c)) for a, b, c in rows)


def test_classes_equal_brute_force(documents, odd, empty):
    near = documents.limit(40).withColumn("text", F.concat("text", F.lit(" tail"))).withColumn("doc_id", F.col("doc_id") + 10_000)
    for docs in (documents.unionByName(near), odd):
        rows = docs.collect()
        assert key(simhash.near_duplicates(docs).collect()) == key(brute_classes(rows))
    assert simhash.near_duplicates(empty).count() == 0


def test_short_texts_and_case():
    assert simhash.fingerprint(b"", 3) == simhash.fingerprint(b" \n ", 3) == 0
    assert simhash.fingerprint(b"A b", 3) == xxhash.xxh64_intdigest(b"a b", 42)
    assert simhash.fingerprint("É A b".encode(), 3) == xxhash.xxh64_intdigest("É a b".encode(), 42)
    assert simhash.fingerprint("a b".encode(), 3) == xxhash.xxh64_intdigest("a b".encode(), 42)


def test_unique_keeps_the_smallest(spark, odd, empty):
    docs = odd.where("doc_id IS NOT NULL")
    kept = simhash.unique(docs)
    assert kept.columns == docs.columns
    assert sorted({r.doc_id for r in kept.collect()}) == sorted({c for _, _, c in brute_classes(docs.collect())})
    assert simhash.unique(empty).count() == 0


def test_similar_texts_go_and_others_stay(spark):
    """Copies with words replaced, one for each of 300 texts: recall by similarity, and nothing below 0.8 is linked."""
    rng, rows, like = random.Random(8), [], {}
    for k in range(300):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.choice((40, 120, 400, 900)))]
        n = len(base)
        text = " ".join(base)
        rows.append((2 * k, text))
        copy = edited(rng, base, max(1, round(n * rng.choice((0.004, 0.013, 0.015, 0.021)))))
        rows.append((2 * k + 1, copy))
        a, b = brute_set(text), brute_set(copy)
        like[2 * k + 1] = len(a & b) / len(a | b)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r.doc_id for r in simhash.unique_texts(docs).collect()}
    assert all(2 * k in kept for k in range(300)) and all(i in kept for i, j in like.items() if j < 0.8)
    for low, high, least in ((0.8, 0.85, 0.8), (0.85, 0.9, 0.9), (0.9, 1.0, 0.97)):
        near = [i for i, j in like.items() if low <= j < high]
        assert len(near) > 20 and sum(i not in kept for i in near) >= least * len(near), (low, len(near))
    near = [i for i, j in like.items() if j >= 0.8]
    assert sum(i not in kept for i in near) >= 0.9 * len(near)


def test_similar_texts_of_odd_rows_and_documents(documents, odd, empty):
    docs = odd.where("doc_id IS NOT NULL")
    kept = simhash.unique_texts(odd)
    assert kept.columns == odd.columns
    assert kept.where("doc_id IS NULL").count() == odd.where("doc_id IS NULL").count()
    assert sorted({r.doc_id for r in kept.collect() if r.doc_id is not None}) == sorted({c for _, _, c, _ in brute_odd(docs.collect(), 80)})
    assert simhash.unique_texts(empty).count() == 0
    near = documents.limit(60).withColumn("text", F.concat("text", F.lit(" one more tail"))).withColumn("doc_id", F.col("doc_id") + 10_000)
    both = documents.unionByName(near)
    kept, want = {r.doc_id for r in simhash.unique_texts(both, block=7).collect()}, {c for _, _, c, _ in brute(both.collect(), 80)}
    # Nothing goes that should stay; of what should go, texts of a few words at just 0.8 may be missed.
    assert kept >= want and len(kept - want) <= 0.05 * (both.count() - len(want))


def test_group_of_near_copies_gives_few_pairs(spark, monkeypatch):
    """200 texts of one origin, many of them not linked: some candidates for each, not one for each key, and links as before."""
    rng, seen, stage = random.Random(11), {}, minhash.stage

    def kept_by_name(df, name):
        seen[name] = stage(df, name)
        return seen[name]

    base = [f"w{rng.randrange(3000)}" for _ in range(300)]
    docs = spark.createDataFrame([(k, edited(rng, base, rng.randrange(1, 9))) for k in range(200)], "doc_id long, text string")
    monkeypatch.setattr(minhash, "stage", kept_by_name)
    kept, want = {r.doc_id for r in simhash.unique_texts(docs).collect()}, {c for _, _, c, _ in brute(docs.collect(), 80)}
    assert kept >= want and len(kept - want) <= 0.05 * (200 - len(want)) and 20 < len(want) < 180
    twos = seen["buckets"].where("n = 2 AND class <> leader").select("leader", "class").distinct().count()
    assert seen["star-pairs"].count() <= 4 * 200 + twos
    assert found(minhash.near_duplicates(docs)) == brute(docs.collect())


def test_wide_keys_meet_within_size_and_errors():
    assert simhash.most_wide(80) < simhash.WIDE * 0.3 and simhash.wide_fingerprint(np.zeros(0, np.uint64)) == bytes(simhash.WIDE // 8)
    one = np.random.default_rng(3).integers(0, 1 << 63, 3000, np.uint64)
    bits = np.unpackbits(np.frombuffer(simhash.wide_fingerprint(one), np.uint8))
    assert 0.4 < bits.mean() < 0.6
    half = np.unpackbits(np.frombuffer(simhash.wide_fingerprint(one[:2700]), np.uint8))
    assert 20 < (bits != half).sum() < simhash.most_wide(80)


def test_keys_of_sets_are_not_broadcast(spark, documents, monkeypatch, capsys):
    """Spark sizes the keys like the sets that they come from: within its limit, millions of them went through the driver."""
    plans, stage = {}, minhash.stage

    def planned(df, name):
        df.explain()
        plans[name] = capsys.readouterr().out
        return stage(df, name)

    assert int(spark.conf.get("spark.sql.autoBroadcastJoinThreshold").rstrip("b")) >= 10 << 20
    monkeypatch.setattr(minhash, "stage", planned)
    monkeypatch.setattr(simhash, "stage", planned)
    for run in (simhash.unique_texts, minhash.near_duplicates):
        run(documents)
        assert "BroadcastExchange" not in plans["buckets"] and "SortMergeJoin [part" in plans["buckets"]
        # Of the members only what is one row for each set may be broadcast.
        assert "SortMergeJoin [class" in plans["members"] and plans["members"].count("BroadcastExchange") <= 1
    assert "BroadcastHashJoin [doc_id" not in plans["near-dropped"]


def test_ids_go_only_if_no_row_stays(spark):
    docs = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (2, "c"), (3, "b"), (None, "b")], "doc_id long, text string")
    marked = spark.createDataFrame([(1, True), (1, True), (2, False), (2, True), (3, False), (3, False)], "doc_id long, stays boolean")
    got = simhash.without_copies(docs, marked)
    assert sorted((str(r.doc_id), r.text) for r in got.collect()) == [("1", "a"), ("1", "b"), ("2", "a"), ("2", "c"), ("None", "b")]


def test_keys_of_fingerprints_are_not_broadcast(spark, capsys):
    prints = simhash.stage(spark.createDataFrame([(k * k,) for k in range(100)], "print long"), "prints")  # files, so that their size is known
    simhash.links(prints).explain()
    plan = capsys.readouterr().out
    assert "Broadcast" not in plan and "SortMergeJoin [key" in plan
