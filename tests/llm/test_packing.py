"""Packing: exact round trip, gapless windows, ids equal to those of whole texts."""
import random
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from test_llm import edges, frame, prose

from ledgerspark.llm import packing


def plain(text):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.default_tokenizer())
    return t.encode(text or "", add_special_tokens=False).ids + [1]


def ids_of(blob):
    return [int.from_bytes(blob[i:i + 4], "little") for i in range(0, len(blob), 4)]


@pytest.mark.parametrize("length", [2048, 100])
def test_pack_round_trip(spark, length):
    rng = random.Random(length)
    df, docs = frame(spark, edges() + [prose(rng.choice([1, 5, 50, 3000]), rng) for _ in range(40)])
    df = df.repartition(7)
    rows = packing.pack(df, length=length).collect()
    # every sequence is gapless from 0 and all but the last are full
    by_seq = {}
    for r in rows:
        by_seq.setdefault(r.sequence_id, []).append(r)
    assert sorted(by_seq) == list(range(len(by_seq)))
    for s, pieces in by_seq.items():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at and r.length >= 1 and len(r.ids) == 4 * r.length
            at += r.length
        assert at == length or s == len(by_seq) - 1 and at <= length
    # each document is there once, whole; repeated and null ids as often as they occur
    found = []
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        if r.start == 0:
            found.append([r.doc_id, r.doc_tokens, b""])
        assert found[-1][0] == r.doc_id and len(found[-1][2]) == 4 * r.start
        found[-1][2] += bytes(r.ids)
    assert all(4 * n == len(b) for _, n, b in found)
    want = [(i, plain(t)) for i, t in docs]
    assert sorted(((i, ids_of(b)) for i, _, b in found), key=str) == sorted(want, key=str)
    # the put-together sequences, from pieces in order and out of order
    whole = {s: b"".join(bytes(r.ids) for r in sorted(p, key=lambda r: r.offset)) for s, p in by_seq.items()}
    pieces = packing.pack(df, length=length)
    last = max(whole)
    for p in (pieces, spark.createDataFrame(rows, pieces.schema).repartition(5, "doc_id")):
        out = packing.sequences(p, length=length).collect()
        got = {r.sequence_id: bytes(r.ids) for r in out}
        assert len(out) == len(got)
        assert [len(b) for b in got.values()] == [4 * r.length for r in out]
        assert all(r.padding == (0 if r.length & (r.length - 1) == 0 else length - r.length) for r in out)
        if p is not pieces:             # the same pieces; a second pack() may deal partitions anew
            assert got == whole
        else:
            assert sorted(got) == sorted(whole) and all(len(got[s]) == 4 * length for s in got if s != last)


def test_query_digest(spark):
    df, docs = frame(spark, edges())
    out = packing.packed(df)
    assert out.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert {t for _, t in out.dtypes} == {"bigint"}
    short = {(r.doc_id, r.ids_crc32) for r in out.collect() if r.length == r.doc_tokens}
    for i, t in docs:
        ids = plain(t)
        if (i, zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids))) not in short:
            assert len(ids) > 100          # cut over sequences
    assert packing.packed(df.limit(0)).count() == 0
    assert packing.sequences(packing.pack(df.limit(0))).count() == 0


def test_bases_over_many_blocks(spark):
    from ledgerspark.llm.common import bases
    rows = [(p, (p * 7) % 5 + 1) for p in range(0, 700, 2)]
    got = {r.part: r.base for r in bases(spark.createDataFrame(rows, "part int, n long"), "part", "n", block=16).collect()}
    assert got == {p: sum(n for q, n in rows if q < p) for p, _ in rows}


#: Marks that join or split words, several kinds of white space, and what has a rule of its own.
PARTS = list("aAbZ09 \n\t.,'’#éÉßΣςσ漢😀") + ["\u0301", "\u0308", "\xa0", "\u2003", "\u200d", "\x1c", "\x85", "\u1100", "\u1161",
                                             "'s", "'ll", "<|", "<|endoftext|>", "İ", "\u212a", "\u0958", "word", "Été,", "(Ωμέγα)", "жук!"]


@given(st.lists(st.lists(st.sampled_from(PARTS), max_size=60).map("".join), min_size=1, max_size=6))
@settings(max_examples=300, deadline=None)
def test_ids_equal_those_of_whole_texts(encoders, texts):
    encode, whole = encoders
    for text, blob in zip(texts, encode(texts)):
        assert ids_of(blob) == whole.encode(text, add_special_tokens=False).ids + [packing.END]


@pytest.fixture(scope="module")
def encoders():
    from tokenizers import Tokenizer

    return packing.encoder(packing.default_tokenizer()), Tokenizer.from_file(packing.default_tokenizer())
