import zlib

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from kinetrove.llm import packing, token_files
from kinetrove.llm.common import scratch
from kinetrove.llm.tokens import encoder, public_path

PATH = public_path()


def ids_of(text, end):
    tokenizer = encoder(PATH).tokenizer
    return np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, end], "<u4")


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([*"ab Z1.'s\n\t \r\x0b\x1c\x85\xa0 　é漢🙂٣²_-", "'ll", " the", "  ", "\n\n", "<|endoftext|>", "12"]), max_size=30).map("".join))
def test_remembered_runs_equal_the_library(text):
    encode = encoder(PATH)
    for _ in range(2):
        assert np.frombuffer(encode(text), "<u4").tolist() == encode.tokenizer.encode(text, add_special_tokens=False).ids


def test_given_texts_equal_the_library(documents):
    encode = encoder(PATH)
    for row in documents.collect():
        assert np.frombuffer(encode(row.text), "<u4").tolist() == encode.tokenizer.encode(row.text, add_special_tokens=False).ids


def check_files(docs, rows):
    want = sorted(((r.doc_id is not None, r.doc_id or 0, zlib.crc32(ids_of(r.text, 2)), len(ids_of(r.text, 2)), r.doc_id) for r in docs.collect()))
    got = sorted(rows, key=lambda r: r.start)
    start = 0
    for r in got:
        assert r.start == start
        start += r.n_tokens
    assert [r.doc_id for r in got] == [w[4] for w in want]
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_crc32) for r in got) == sorted((str(w[4]), w[3], w[2]) for w in want)


def test_token_files_round_trip(documents, odd, empty):
    for docs in (documents, odd):
        check_files(docs, token_files.token_files(docs, PATH, length=64, rows=8).collect())
    assert token_files.token_files(empty, PATH).count() == 0


def test_sequences_by_arithmetic(spark, documents):
    shards = token_files.write_tokens(documents, scratch(spark, "t"), PATH, length=64, rows=8)
    for s in shards.collect():
        shard = token_files.Shard(s.path)
        with pa.OSFile(s.path.removeprefix("file://")) as file:
            table = pa.ipc.open_stream(file).read_all()
        assert shard.n_batches * 8 == table.num_rows >= s.n_sequences
        for k in (0, s.n_sequences // 2, s.n_sequences - 1):
            ids, mask = shard.sequence(k)
            assert ids.tolist() == table["ids"][k].as_py() and mask.tolist() == table["mask"][k].as_py()
        assert not shard.sequence(0)[0].flags.owndata
        assert int(np.sum(np.concatenate(table["mask"].to_pylist()))) == s.n_tokens


def check_packing(docs, rows, length):
    pieces = {}
    sequences = {}
    for r in rows:
        pieces.setdefault((r.doc_id, r.doc_tokens), []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
    for parts in sequences.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == parts[0].sequence_length and (at == length or at & (at - 1) == 0)
    wanted = [ids_of(d.text, 1) for d in docs.collect()]
    assert sum(r.length for r in rows) == sum(map(len, wanted))
    return pieces


def test_packing_keeps_every_id(documents, odd, empty):
    for length in (64, 2048):
        rows = packing.pack(documents, PATH, length=length).collect()
        pieces = check_packing(documents, rows, length)
        for d in documents.collect():
            ids, at = ids_of(d.text, 1), 0
            for r in sorted(pieces[d.doc_id, len(ids)], key=lambda r: r.start):
                assert r.start == at and r.ids_crc32 == zlib.crc32(ids[at : at + r.length])
                at += r.length
            assert at == len(ids)
    check_packing(odd, packing.pack(odd, PATH).collect(), 2048)
    assert packing.pack(empty, PATH).count() == 0


def test_level_minimises_the_sum_of_squares():
    rng = np.random.default_rng(1)
    for _ in range(300):
        packer = packing.Packer(length=32)
        packer.open[1:32] = rng.integers(0, 4, 31)
        size = int(rng.integers(1, 32))
        best = None
        for level in range(33 - size):
            if level and not packer.open[level]:
                continue
            after = packer.open.copy()
            after[level] -= level > 0
            after[level + size] += level + size < 32
            cost = int((after[1:32] ** 2).sum())
            if best is None or cost < best[0] or cost == best[0] and level > best[1]:
                best = (cost, level)
        assert packer.level(size) == best[1]


def test_few_windows_stay_open():
    packer = packing.Packer(length=64, most_open=10)
    for i in range(500):
        packer.add(i, np.full(40, i, "<u4"))
        assert packer.open.sum() <= 10
    packer.finish()
    rows = packer.take()
    assert sum(r[2] for r in rows) == 500 * 40
    assert len({r[5] for r in rows if r[7] < 64}) <= 6


def test_other_vocabularies_go_through_the_whole_pipeline():
    other = encoder(public_path("word_bpe_49k.json"))
    assert not other.by_piece and encoder(PATH).by_piece
    text = "Hello  World, it's 12 o'clock"
    assert np.frombuffer(other(text), "<u4").tolist() == other.tokenizer.encode(text, add_special_tokens=False).ids
