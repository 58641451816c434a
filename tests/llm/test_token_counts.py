"""Token counts: the public library on whole tables, odd texts and every white-space character; merging rounds."""

import random

import corpus
import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from pulsegrid.llm import token_counts
from pulsegrid.llm.tokens import tokenizer_path

PATH = tokenizer_path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(PATH)
    return lambda texts: [len(e.ids) for e in tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def counted(texts):
    encoded = [(t or "").encode() for t in texts]
    bounds = np.cumsum([0] + [len(e) for e in encoded])
    return token_counts.counter(PATH).count(np.frombuffer(b"".join(encoded), dtype=np.uint8), bounds).tolist()


ODD = [
    "", " ", "  ", "\n", " \n", "\n ", "a", " a", "a ", "  a", "a  ", "a  b", "a \n b", "a\n\nb", "\t\ta", "don't can't we'll I'd 's 'S", "12 345,678.90",
    "x" * 3000, "ab" * 2000, "aaaaaaa aaaa", "straße ÄÖÜ žluťoučký 🦊🦊 kůň", "漢字仮名交じり文" * 40, "नमस्ते दुनिया", " a  b", "a　b", "　", "  x",
    "a\x1cb \x1f c", "<|endoftext|>", "a<|endoftext|>b", "a <|endoftext|> b", "<|endoftext|><|endoftext|>", "<|endoftext", "|>", "<|endoftext|> ", "\x00\x01\x7f", "é", "﻿bom",
]


def test_odd_texts_match_the_library(library):
    assert counted(ODD) == library(ODD)
    assert [counted([t])[0] for t in ODD] == library(ODD)


def test_special_strings_do_not_cross_texts(library):
    texts = ["x<|endof", "text|> y", "z"]
    assert counted(texts) == library(texts)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("ab 's\n\t19.é  漢🦊T'")), max_size=30), max_size=5))
def test_random_texts_match_the_library(library, texts):
    assert counted(texts) == library(texts)


def test_every_white_or_odd_character_matches_the_library(library):
    points = [*range(0x2100), *range(0x2FF0, 0x3100), 0xFEFF, 0x180E, *range(0x1F300, 0x1F340), *range(0xFE00, 0xFE10)]
    texts = [f"a{chr(p)}b {chr(p)}{chr(p)} {chr(p)}" for p in points]
    assert counted(texts) == library(texts)


def test_rounds_match_one_merge_at_a_time():
    merges = token_counts.PairMerges(PATH)
    rng = random.Random(5)
    rank = dict(zip(merges.key.tolist(), merges.rank.tolist()))
    words = ["".join(rng.choice("aeinrst") for _ in range(rng.randint(1, 60))) for _ in range(200)] + ["a" * k for k in range(1, 40)]

    def plain(word):
        symbols = [int(merges.byte_symbol[b]) for b in word.encode()]
        while len(symbols) > 1:
            best, at = min((rank.get(a << 20 | b, 1 << 40), i) for i, (a, b) in enumerate(zip(symbols, symbols[1:])))
            if best == 1 << 40:
                break
            symbols[at:at + 2] = [int(merges.product[best])]
        return len(symbols)

    assert merges.count([w.encode() for w in words]).tolist() == [plain(w) for w in words]
    assert merges.count([]).tolist() == [] and merges.count([b"", b"a"]).tolist() == [0, 1]


def test_whole_tables_match_the_library(spark, library):
    folder = "/root/testdata/sf0.01"
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.query(spark, folder).collect()}
    rows = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    counts = library([r.text for r in rows])
    assert got == {r.doc_id: (len((r.text or "").encode()), n, n > 512) for r, n in zip(rows, counts)}


def test_defined_cases(spark, library, tmp_path):
    docs = corpus.clashing(corpus.odd_documents(spark)).withColumns({"n_bytes": F.lit("mine"), "over_limit": F.lit(1)})
    rows = token_counts.query(spark, corpus.written(docs, tmp_path)).collect()
    texts = [r[1] for r in corpus.odd_rows()]
    want = sorted(zip([r[0] or -1 for r in corpus.odd_rows()], [len((t or "").encode()) for t in texts], library(texts)))
    assert sorted((r.doc_id or -1, r.n_bytes, r.n_tokens) for r in rows) == want


def test_memo_starts_afresh_and_long_texts_are_whole(library, monkeypatch):
    monkeypatch.setattr("pulsegrid.llm.text_buffers.MEMO_PIECES", 50)
    rng = random.Random(1)
    texts = [" ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 70))) for _ in range(200)) for _ in range(6)]
    texts.append(" ".join(texts * 40) + "漢字" * 60_000)
    own = token_counts.TokenCounter(PATH)
    for text in texts:
        data = np.frombuffer(text.encode(), dtype=np.uint8)
        assert own.count(data, np.array([0, len(data)])).tolist() == library([text])


def test_empty_table(spark, tmp_path):
    assert token_counts.query(spark, corpus.written(corpus.empty_documents(spark), tmp_path)).collect() == []
