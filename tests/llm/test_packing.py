"""Packing against the tokenizer on whole texts and against exhaustive search."""

import itertools
import struct
import zlib
from collections import Counter

import corpus
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from pulsegrid.llm import packing, tokens


@pytest.fixture(scope="module")
def whole():
    return Tokenizer.from_file(tokens.tokenizer_path())


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.characters(codec="utf-8"), st.sampled_from(" \n\t'.,aABé́ \x1c\x85İΣ"))), max_size=5))
def test_ids_are_those_of_whole_texts(whole, texts):
    found = tokens.encoder(tokens.tokenizer_path()).encode(texts)
    assert [list(struct.unpack(f"<{len(b) // 4}I", b)) for b in found] == [whole.encode(t, add_special_tokens=False).ids for t in texts]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list(" aB1.,'sté×÷ÀΣσ́—<|>ñ\n")), max_size=25), max_size=4))
def test_pieces_within_words(whole, texts):
    found = tokens.encoder(tokens.tokenizer_path()).encode(texts)
    assert [list(struct.unpack(f"<{len(b) // 4}I", b)) for b in found] == [whole.encode(t, add_special_tokens=False).ids for t in texts]


def test_special_token_text(whole):
    text = "a<|endoftext|>b <|startoftext|> <|ENDOFTEXT|> X<|EndOfText|>Y It's 42"
    (data,) = tokens.encoder(tokens.tokenizer_path()).encode([text])
    assert list(struct.unpack(f"<{len(data) // 4}I", data)) == whole.encode(text, add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 3), max_size=5), st.integers(0, 60))
def test_fullest_is_optimal(counts, space):
    chosen = packing.fullest(counts, sorted(counts, reverse=True), space)
    assert all(k <= counts[n] for n, k in chosen.items())
    every = [sum(n * k for n, k in zip(counts, ks)) for ks in itertools.product(*[range(c + 1) for c in counts.values()])]
    assert sum(n * k for n, k in chosen.items()) == max(s for s in every if s <= space)


def check(rows, docs, whole, window):
    wanted = Counter()
    for doc_id, text in docs:
        ids = whole.encode(text or "", add_special_tokens=False).ids + [1]
        for at in range(0, len(ids), window):
            piece = ids[at:at + window]
            wanted[(doc_id, at, len(piece), zlib.crc32(struct.pack(f"<{len(piece)}I", *piece)), len(ids))] += 1
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows) == wanted
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in bins.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= window
    assert sorted(bins) == list(range(len(bins)))
    return bins


@pytest.mark.parametrize("window", [16, 2048])
def test_pieces_and_places(spark, whole, window):
    docs = corpus.clashing(corpus.odd_documents(spark))
    rows = packing.pack(docs, window=window).collect()
    check(rows, [(r[0], r[1]) for r in corpus.odd_rows()], whole, window)


def test_little_padding(spark, whole):
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = packing.pack(table).collect()
    bins = check(rows, [tuple(r) for r in table.select("doc_id", "text").collect()], whole, 2048)
    assert sum(2048 - sum(n for _, n in b) for b in bins.values()) <= 2 * 2048


def test_empty_table(spark):
    assert packing.pack(corpus.empty_documents(spark)).collect() == []
