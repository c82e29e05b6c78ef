import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerlark.llm import packing, token_files
from ledgerlark.llm._common import fresh_path
from ledgerlark.llm._tokens import ChunkEncoder

SCHEMA = "doc_id long, text string, start long, ids string"
TEXTS = ["it's  a\n\n\ttest $$—x é$ <|endoftext|> ÀB$ don't.  　x  \n", "", " ", "\n\n", "a\x1cb  c", "ΑΣ Σ. ΟΔΟΣ$ İI ß$$ ﬁ5% 12a$b'll", None, "word " * 3000, "the the the", "Eauouon. Étion’s"]
BYTES, WORDS = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))


@pytest.mark.parametrize(("path", "drops"), [(BYTES, False), (WORDS, True)])
def test_ids_are_the_library_s(path, drops):
    e = ChunkEncoder(path, drops, chunks=50, pieces=20)

    def encoded(texts):
        ids, at = e.encode(pa.array(texts, pa.string()))
        return [ids[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]

    @settings(max_examples=150, deadline=None)
    @given(st.lists(st.text(alphabet=st.sampled_from("aZé'sß9²$&%., \t\n\r\x1c\x85\xa0 ́Σ中—<|>_"), max_size=40), max_size=4))
    def same(texts):
        assert encoded(texts) == e.library(texts)

    same()
    texts = [t or "" for t in TEXTS]
    assert encoded(texts) == e.library(texts)


def ids_of(path, text, end):
    return ChunkEncoder(path, path == WORDS).library([text or ""])[0] + np.array([end], "<u4").tobytes()


def test_token_files(spark):
    rows = [(7 * i % 101, TEXTS[i % len(TEXTS)], 1, "x") for i in range(60)] + [(5, "same", 0, ""), (5, "same", 0, ""), (None, "no id", 0, "")]
    path = fresh_path(spark, "tokens")
    token_files.write_tokens(spark.createDataFrame(rows, SCHEMA), path, WORDS, 2)
    read = token_files.read_tokens(spark, path)
    got = sorted((tuple(r) for r in token_files.starts(token_files.checksums(read), read.select("file", "n_tokens")).select("start", "doc_id", "n_tokens", "ids_crc32").collect()))
    assert [r[1] for r in got] == sorted((r[0] for r in rows), key=lambda i: (i is not None, i))
    assert [r[0] for r in got] == np.cumsum([0] + [r[2] for r in got[:-1]]).tolist()
    want = sorted((zlib.crc32(ids_of(WORDS, t, 2)), len(ids_of(WORDS, t, 2)) // 4) for _, t, _, _ in rows)
    assert sorted((r[3], r[2]) for r in got) == want


def test_empty_tables(spark):
    path = fresh_path(spark, "tokens")
    empty = spark.createDataFrame([], SCHEMA)
    token_files.write_tokens(empty, path, WORDS, 2)
    assert token_files.read_tokens(spark, path).count() == 0
    assert packing.packed(empty, BYTES).count() == 0


def test_cuts():
    for n in [1, 31, 32, 33, 1023, 1024, 1025, 5000]:
        assert sum(packing.cuts(n)) == n and max(packing.cuts(n)) <= 1024
    assert packing.cuts(0) == []


def test_packing(spark):
    rows = [(i, TEXTS[i % len(TEXTS)], 0, "x") for i in range(200)] + [(3, TEXTS[3], 0, ""), (None, "no id", 0, "")]
    got = packing.packed(spark.createDataFrame(rows, SCHEMA), BYTES).collect()
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert sorted(sequences) == list(range(len(sequences)))
    padding = 0
    for pieces in sequences.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= 1024
        padding += 0 if at & (at - 1) == 0 else 1024 - at
    total = sum(len(ids_of(BYTES, t, 0)) // 4 for _, t, _, _ in rows)
    assert sum(r.length for r in got) == total and padding <= max(1024, 0.02 * total)
    whole = ids_of(BYTES, TEXTS[7], 0)
    own = sorted((r for r in got if r.doc_id == 7), key=lambda r: r.start)
    at = 0
    for r in own:
        assert r.start == at and r.ids_crc32 == zlib.crc32(whole[4 * at : 4 * (at + r.length)]) and r.doc_tokens == len(whole) // 4
        at += r.length


def test_sequences_hold_the_ids(spark):
    rows = [(i, TEXTS[i % len(TEXTS)], 0, "x") for i in range(30)] + [(None, None, 0, "")]
    docs = spark.createDataFrame(rows, SCHEMA)
    stored = packing.sequences(docs, BYTES).collect()
    assert all(len(r.ids) == 1024 and not any(r.ids[sum(p.length for p in r.pieces) :]) for r in stored)
    of = {}
    for r in packing.packed(docs, BYTES, keep_ids=True).collect():
        assert len(r.ids) == r.length and zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32
        of.setdefault(r.doc_id, []).append((r.start, r.ids))
    for i, t, _, _ in rows:
        assert np.array([x for _, ids in sorted(of[i]) for x in ids], "<u4").tobytes() == ids_of(BYTES, t, 0)


def test_workers_leave_fewer_than_a_sequence_of_each_class(spark):
    rows = [(i, TEXTS[7], 0, "x") for i in range(20)]
    got = packing.filled(spark.createDataFrame(rows, SCHEMA).coalesce(1), BYTES, 0).collect()
    left = [len(r.ids) for r in got if r.sequence_id is None]
    assert all(len(r.ids) == 1024 for r in got if r.sequence_id is not None)
    assert all(left.count(n) < 1024 // n for n in left) and all(len(r.pieces) == 1 for r in got if r.sequence_id is None)


def test_long_texts(spark):
    text = "Ab c, " * 70_000 + "é" * 100_000
    docs = spark.createDataFrame([(1, text, 0, ""), (2, "x", 0, "")], SCHEMA)
    own = sorted((r.start, r.length, r.ids_crc32) for r in packing.packed(docs, BYTES).collect() if r.doc_id == 1)
    whole = ids_of(BYTES, text, 0)
    assert [(a, n, zlib.crc32(whole[4 * a : 4 * (a + n)])) for a, n, _ in own] == own and sum(n for _, n, _ in own) == len(whole) // 4
    path = fresh_path(spark, "tokens")
    token_files.write_tokens(docs, path, WORDS, 2)
    got = {r.doc_id: (r.n_tokens, r.ids_crc32) for r in token_files.checksums(token_files.read_tokens(spark, path)).collect()}
    assert got == {i: (len(w) // 4, zlib.crc32(w)) for i, w in ((1, ids_of(WORDS, text, 2)), (2, ids_of(WORDS, "x", 2)))}
