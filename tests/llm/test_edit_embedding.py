"""The edit embedding against a plain walk, its likeness, and the neighbours of the query."""

import hashlib
import random

import corpus
import numpy as np
import pytest

from pulsegrid.llm import edit_embedding as E


def plain(text):
    """One text, one step at a time."""
    level = max(len(text), 1).bit_length() - 1
    steps = set(E.sampled_steps(level).tolist())
    i, out = 0, []
    for j in range(3 * len(text)):
        if i >= len(text):
            break
        c = ord(text[i]) + 1
        if j in steps:
            out.append("0123456789abcdef"[(c * 2654435761 % 2**32) >> 28])
        multiplier = int(E._step_values(j, 1, 2)[0] | np.uint64(1)) % 2**32
        i += (c * multiplier % 2**32) >> 31
    return f"{level:02x}:" + "".join(out)


def test_walk_matches_plain_walk():
    rng = random.Random(3)
    texts = ["", "a", "ab", "é🦊" * 40, "x" * 500, "\0\0a"] + ["".join(rng.choice("abcde fgé") for _ in range(rng.randint(1, 900))) for _ in range(30)]
    assert E.fingerprints(texts) == [plain(t) for t in texts]


def test_likeness_follows_edits():
    rng = random.Random(5)
    base = " ".join(corpus.words(rng, 700))
    other = " ".join(corpus.words(rng, 700))

    def edited(n):
        t = list(base)
        for _ in range(n):
            at = rng.randrange(len(t))
            t[at:at + rng.randint(0, 1)] = rng.choice(["", "q", "zz"])
        return "".join(t)

    prints = E.fingerprints([base, edited(3), edited(200), other, base[:len(base) // 2] + other[len(base) // 2:], base + base[:50]])
    near = [E.likeness(prints[0], p) for p in prints]
    assert near[0] == 1.0 and near[1] > 0.85 and near[1] > near[2] > near[3] and near[3] < 0.2 and 0.35 < near[4] < 0.75 and near[5] > 0.9


def brute(rows):
    ordered = sorted(((r[0], r[1] or "") for r in rows), key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    out = []
    for i, (doc, text) in enumerate(ordered):
        after = ordered[(i + 1) % len(ordered)][1]
        h = len(text) // 2
        out.append((doc, len(text), text[:len(text) - h] + after[:h], text, after))
    return out


@pytest.mark.parametrize("per_block", [2, 5, 4000])
def test_query_neighbours(spark, tmp_path, monkeypatch, per_block):
    monkeypatch.setattr(E, "ROWS_PER_BLOCK", per_block)
    monkeypatch.setattr(E, "GROUP_CHARS", 3000)
    folder = corpus.written(corpus.clashing(corpus.odd_documents(spark)), tmp_path)
    rows = E.query(spark, folder).collect()
    wanted = [(d, n, hashlib.sha256(e.encode()).hexdigest(), *E.fingerprints([t, e])) for d, n, e, t, _ in brute(corpus.odd_rows())]
    key = lambda r: tuple(str(v) for v in r)
    assert sorted([tuple(r)[:5] for r in rows], key=key) == sorted(wanted, key=key)
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in rows)


def test_one_row_and_none(spark):
    one = spark.createDataFrame([(1, "abcdef")], "doc_id long, text string")
    assert E.with_next(one).first().near_next == 1.0
    assert E.with_next(corpus.empty_documents(spark)).collect() == []
    assert E.with_next(spark.createDataFrame([(None, "abc"), (None, "abd")], "doc_id long, text string")).count() == 2


def test_near_pairs_finds_edited_copies(spark):
    rng = random.Random(9)
    texts = [" ".join(corpus.words(rng, 300)) for _ in range(20)]
    texts += [t[:100] + "x" + t[101:] for t in texts[:10]]
    found = spark.createDataFrame(list(enumerate(E.fingerprints(texts))), "doc_id long, fingerprint string")
    pairs = {(r.a, r.b) for r in E.near_pairs(found).collect()}
    assert pairs == {(i, 20 + i) for i in range(10)}


def mixed_texts():
    """Texts edited at the start, short texts, one beginning that many share, and copies."""
    rng = random.Random(11)
    texts = []
    for _ in range(25):
        t = " ".join(corpus.words(rng, 120))
        texts += [t, " ".join(corpus.words(rng, 12)) + t[60:]]
    for n in (8, 10, 12, 15, 18, 20, 30, 40) * 4:
        t = "".join(rng.choice("abcdefghij") for _ in range(n))
        texts += [t, t[:n - 2] + "zz"]
    head = " ".join(corpus.words(rng, 60))
    for _ in range(20):
        t = head + " " + " ".join(corpus.words(rng, 60))
        texts += [t, t[:-8] + "quiteoff"]
    return texts + texts[:6] + ["", ""]


@pytest.mark.parametrize("block", [5, 256])
def test_near_pairs_recall(spark, monkeypatch, block):
    monkeypatch.setattr(E, "BAND_BLOCK", block)
    prints = E.fingerprints(mixed_texts())
    wanted = [(i, j) for i in range(len(prints)) for j in range(i + 1, len(prints)) if E.likeness(prints[i], prints[j]) >= 0.8]
    links = E.near_pairs(spark.createDataFrame(list(enumerate(prints)), "doc_id long, fingerprint string")).collect()
    assert all(r.a < r.b and r.likeness == E.likeness(prints[r.a], prints[r.b]) >= 0.8 for r in links)
    label = list(range(len(prints)))
    for _ in range(len(prints)):
        for r in links:
            label[r.a] = label[r.b] = min(label[r.a], label[r.b])
    met = sum(label[i] == label[j] for i, j in wanted)
    assert len(wanted) > 40 and met >= 0.95 * len(wanted), (met, len(wanted))
