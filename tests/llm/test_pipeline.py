"""The pipeline's stages against plain versions of their decisions."""

import re
from collections import Counter

import compare_stages
import corpus
import pytest

import corpus_pipeline as P

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    from pulsegrid.llm.common import documents
    from pulsegrid.session import durable

    docs, out = documents(spark, FOLDER), {}
    out["documents"] = [tuple(r) for r in docs.collect()]
    for name, stage in P.STAGES:
        docs = durable(stage(spark, docs, FOLDER))
        out[name] = [tuple(r) for r in docs.collect()]
        if name != "packing":
            assert docs.columns == documents(spark, FOLDER).columns
    return out


def test_language_stage_keeps_texts_with_letters(stages):
    before, after = stages["documents"], stages["language_id"]
    assert set(after) <= set(before)
    gone = [r for r in before if r not in set(after)]
    assert len(gone) <= 0.01 * len(before) + sum(not re.search(r"[^\W\d_]", r[1] or "") for r in before)


def test_line_stage(stages):
    assert Counter((r[0], r[1]) for r in stages["line_dedup"]) == compare_stages.without_shared_lines(stages["language_id"])


def test_join_stage(stages):
    from test_ngram_join import brute

    kept = {doc for (doc, _, component) in brute([r[:2] for r in stages["line_dedup"]]) if doc == component}
    assert sorted(r[0] for r in stages["ngram_join"]) == sorted(kept)
    assert set(stages["ngram_join"]) <= set(stages["line_dedup"])


def test_mixing_stage(stages):
    taken = compare_stages.words_by_source(stages["mixing"])
    for source, target in compare_stages.targets(stages["ngram_join"]).items():
        assert taken[source] == int(target + 0.5)
    texts = {r[0]: r[1] for r in stages["ngram_join"]}
    cut = [r for r in stages["mixing"] if r[1] != texts[r[0]]]
    assert len(cut) <= len({r[3] for r in stages["ngram_join"]})
    assert all(r[1].split() == texts[r[0]].split()[:len(r[1].split())] for r in cut)


def test_packing_stage(stages):
    from test_packing import check
    from tokenizers import Tokenizer
    from collections import namedtuple

    from pulsegrid.llm import tokens

    Piece = namedtuple("Piece", "doc_id start length ids_crc32 doc_tokens sequence_id offset")
    check([Piece(*r) for r in stages["packing"]], [r[:2] for r in stages["mixing"]], Tokenizer.from_file(tokens.tokenizer_path()), 2048)


def test_run_is_the_stages(spark, stages):
    rows = P.run(spark, FOLDER).collect()
    strip = lambda rs: Counter(tuple(r)[:5] for r in rs)
    assert strip(rows) == strip(stages["packing"])


def test_odd_and_empty_tables(spark, tmp_path):
    assert P.run(spark, corpus.written(corpus.clashing(corpus.odd_documents(spark)), tmp_path / "a")).count() > 0
    assert P.run(spark, corpus.written(corpus.empty_documents(spark), tmp_path / "b")).collect() == []
