import hashlib
import re
from collections import defaultdict

import pandas as pd
from pyspark.sql import functions as F

from kinetrove.llm import exact, mixing
from kinetrove.llm.common import word_count
from kinetrove.llm.oracles import ORACLES
from kinetrove.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def same(spark_rows, sql_rows):
    def keys(df):
        df = df[sorted(df.columns)]
        return sorted(tuple("" if pd.isna(v) else f"{v:.9g}" if isinstance(v, float) else str(v) for v in r) for r in df.itertuples(index=False))

    return keys(spark_rows) == keys(sql_rows)


def test_queries_equal_sql(spark, sql):
    for name in ("op4_exact_groups", "op10_mixing", "op5_warc"):
        got, want = QUERIES[name](spark, SF).toPandas(), sql(ORACLES[name]).df()
        for frame in (got, want):
            for c in ("refers_to", "target"):
                if c in frame:
                    frame[c] = frame[c].astype(float)
        assert same(got, want), name


def brute(rows):
    groups = defaultdict(list)
    for i, r in enumerate(rows):
        text = r.text or ""
        sha = hashlib.sha256(re.sub("[ \t-\r]", "", text).encode()).hexdigest()
        groups[sha].append((-len(text), r.doc_id is None, r.doc_id or 0, i, r))
    return groups


def test_groups_of_odd_rows(odd, empty):
    got = exact.groups(odd).collect()
    groups = brute(odd.collect())
    assert len(got) == 12
    for sha, members in groups.items():
        mine = [g for g in got if g.text_sha256 == sha]
        assert len(mine) == len(members) and {g.group_size for g in mine} == {len(members)}
        assert {g.keep_id for g in mine} == {min(members)[4].doc_id}
        assert sum(g.kept for g in mine) == 1
    assert exact.groups(empty).count() == 0


def test_unique_keeps_one_of_each_and_all_columns(odd, empty):
    kept = exact.unique(odd)
    assert kept.columns == odd.columns
    groups = brute(kept.collect())
    assert all(len(m) == 1 for m in groups.values()) and set(groups) == set(brute(odd.collect()))
    for sha, members in brute(odd.collect()).items():
        assert groups[sha][0][:3] == min(members)[:3]
    assert exact.unique(empty).count() == 0


def test_small_filter_gives_the_same_groups(spark):
    rows = [(i, f"text {i % 700}") for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    slim = docs.select(exact.digest(F.col("text")).alias("sha"))
    repeated, blocks = exact.repeated_filter(slim, rows_per_task=300)
    flagged = exact.maybe_repeated(slim, repeated, blocks)
    assert flagged.where("maybe").count() == 2000
    alone = spark.createDataFrame([(i, f"only {i}") for i in range(2000)], "doc_id long, text string").select(exact.digest(F.col("text")).alias("sha"))
    repeated, blocks = exact.repeated_filter(alone, rows_per_task=300)
    assert exact.maybe_repeated(alone, repeated, blocks).where("maybe").count() < 60  # few false ones
    repeated, blocks = exact.repeated_filter(slim, most_blocks=1)
    assert blocks == 1 and exact.maybe_repeated(slim, repeated, blocks).where("maybe").count() == 2000


def water_filled(sizes, weights, share, cap):
    target, open_, total = dict.fromkeys(sizes, 0.0), set(sizes), share * sum(sizes.values())
    while open_ and total > 1e-9:
        level = total / sum(weights[s] for s in open_)
        full = {s for s in open_ if target[s] + level * weights[s] >= cap * sizes[s] - 1e-9}
        if not full:
            for s in open_:
                target[s] += level * weights[s]
            break
        for s in full:
            total -= cap * sizes[s] - target[s]
            target[s] = cap * sizes[s]
        open_ -= full
    return target


def test_targets_share_out_what_full_sources_cannot_take(spark):
    sizes = {"a": 10, "b": 1000, "c": 5, "d": 0, "é": 300, None: 40}
    totals = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    weights = dict(zip(["a", "b", "c", "d", "é", None], [3, 1, 2, 3, 1, 2]))
    want = water_filled(sizes, weights, 1.5, 2.0)
    for r in mixing.targets(totals).collect():
        assert abs(r.target - want[r.source]) < 1e-6, r


def test_mix_is_near_targets_and_repeatable(spark, documents, odd, empty):
    for docs in (documents, odd):
        first = mixing.mix(docs, lambda doc: word_count(doc["text"])).select("doc.doc_id", "doc.source", "size", "source_size", "target", "copies", "taken").toPandas()
        again = mixing.mix(docs.repartition(7), lambda doc: word_count(doc["text"])).select("doc.doc_id", "doc.source", "size", "source_size", "target", "copies", "taken").toPandas()
        assert same(first, again)
        assert first.copies.between(0, 2).all() and len(first) == docs.count()
        for _, part in first.groupby("source", dropna=False):
            assert abs(part.taken.sum() - part.target.iloc[0]) <= 2 * part["size"].max() + 1
    assert mixing.mix(empty, lambda doc: word_count(doc["text"])).count() == 0
    assert mixing.mix(odd, lambda doc: word_count(doc["text"])).select("doc.*").columns == odd.columns


def test_a_hot_source_is_sampled_evenly(spark):
    docs = spark.range(40_000).select(F.col("id").alias("doc_id"), F.lit("one").alias("source"), F.lit("w w w").alias("text"))
    mixed = mixing.mix(docs, lambda doc: word_count(doc["text"])).agg(F.sum("taken").alias("t"), F.max("target").alias("w")).first()
    assert abs(mixed.t - mixed.w) <= 3
