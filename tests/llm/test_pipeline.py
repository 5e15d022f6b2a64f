import corpus_pipeline
from kinetrove.llm import packing, toxicity
from kinetrove.llm.common import stage
from tests.llm.test_exact_mixing import brute
from tests.llm.test_minhash import brute_odd
from tests.llm.test_tokens import ids_of

SF = "/root/testdata/sf0.001"


def test_each_stage_does_its_work(spark, documents):
    docs, seen = documents, {}
    for name, function in corpus_pipeline.STAGES:
        before, docs = docs, stage(function(spark, docs, SF), name)
        seen[name] = (before, docs)
        if name != "packing":
            assert docs.columns == documents.columns
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
    before, after = seen["toxicity"]
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    assert ids(after) == ids(toxicity.toxicity(before, labels).where("predicted = 0"))
    before, after = seen["exact"]
    assert ids(after) == sorted(min(m)[4].doc_id for m in brute(before.collect()).values())
    before, after = seen["near"]
    want = brute_odd(before.collect(), 80)
    assert ids(after) == sorted({c for _, _, c, _ in want}) and len(ids(after)) < len(want)
    before, after = seen["mixing"]
    assert set(ids(after)) <= set(ids(before)) and max(ids(after).count(i) for i in set(ids(after))) <= 2
    before, after = seen["packing"]
    total = sum(len(ids_of(r.text, 1)) for r in before.collect())
    assert sum(r.length for r in after.collect()) == total


def test_run_and_odd_rows(spark, odd, empty):
    assert corpus_pipeline.run(spark, SF).columns == [f.split()[0] for f in packing.SCHEMA.split(", ")]
    for docs in (odd, empty):
        for name, function in corpus_pipeline.STAGES:
            before, docs = docs, stage(function(spark, docs, SF), name)
            if name != "packing":
                assert docs.columns == before.columns
                assert set(docs.select("doc_id").collect()) <= set(before.select("doc_id").collect())
        assert "sequence_id" in docs.columns
        if before.isEmpty():
            assert docs.isEmpty()
        else:
            assert sum(r.length for r in docs.collect()) == sum(len(ids_of(r.text, 1)) for r in before.collect())
