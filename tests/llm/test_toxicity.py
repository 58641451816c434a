"""Toxicity: held-out quality by label and language, noisy-or by hand, where the toxic sentences are, defined cases."""

import math
import random
import re

import corpus
import numpy as np
from pyspark.sql import functions as F

from pulsegrid.llm import toxicity
from pulsegrid.llm.hashing import segment_hashes

FOLDER = "/root/testdata/sf0.1"


def test_held_out_documents_of_every_language(spark):
    found = toxicity.query(spark, FOLDER)
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "lang")
    marks = spark.read.parquet(f"{FOLDER}/labels.parquet").select("doc_id", "toxic")
    rows = found.where("held_out").join(docs, "doc_id").join(marks, "doc_id").select("predicted", "toxic", "lang", "score").collect()
    hits = {}
    for r in rows:
        hits.setdefault((r.lang, r.toxic), []).append(r.predicted)
    for lang in ("de", "en", "es", "fr"):
        assert np.mean(hits[lang, 0]) <= 0.05
        assert np.mean(hits[lang, 1]) >= 0.7
    toxic = [p for (_, t), ps in hits.items() if t == 1 for p in ps]
    assert len(toxic) > 100 and np.mean(toxic) >= 0.85
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)


def plain_features(text):
    """[features of each sentence with a word]: words and their beginnings, as texts."""
    found = []
    for part in re.split(r"[.!?\n]", (text or "").lower()):
        words = set(re.findall(r"[^\W\d_]+", part))
        if words:
            found.append({(w, True) for w in words} | {(w[:k], False) for w in words for k in toxicity.STEMS if len(w) > k})
    return found


def hash_of(feature):
    name, whole = feature
    data = np.frombuffer(name.encode(), dtype=np.uint8)
    found = segment_hashes(data, np.array([0]), np.array([len(data)])) * (toxicity._WHOLE if whole else np.uint64(1))
    return int(found[0] >> np.uint64(64 - toxicity.FEATURE_BITS))


def test_noisy_or_by_hand():
    rng = random.Random(2)
    vocabulary = ["bad", "worse", "worst", "terrible", "schrecklich", "schreckhaft", "fine", "été"]
    weight = {("bad", True): 3.0, ("schreck", False): 2.5, ("terrible", True): 1.0, ("été", True): 0.5, ("worst", True): 2.0}
    hashed = {hash_of(f): w for f, w in weight.items()}
    names = np.array(sorted(hashed))
    model = toxicity.SentenceModel(names, np.array([hashed[n] for n in names.tolist()]), -2.0)
    texts = [None, "", "...", "fine"] + [" ".join(rng.choice(vocabulary) + rng.choice(["", "", ".", "!\n"]) for _ in range(rng.randint(1, 15))) for _ in range(60)]
    scores, worst, worst_score = model.documents(texts, toxicity.Known(names))
    for text, score, best in zip(texts, scores, worst_score):
        p = [1 / (1 + math.exp(2.0 - sum(weight.get(f, 0.0) for f in s))) for s in plain_features(text)]
        clean = 1.0
        for x in p:
            clean *= 1 - x
        assert abs(score - (1 - clean)) < 1e-9 and abs(best - max(p, default=0.0)) < 1e-9


def test_training_finds_the_toxic_word_in_small_bags():
    """Ten documents of three sentences; the toxic ones hold feature 0, every one holds feature 1."""
    bags = [(d, s) for d in range(10) for s in range(3)]
    entries = [(i, 1) for i, (d, s) in enumerate(bags) if s == 0] + [(i, 0) for i, (d, s) in enumerate(bags) if s == 2 and d < 5]
    row, column = (np.array(x) for x in zip(*entries))
    own = toxicity.Bags(row, column, np.array([d for d, _ in bags]), np.zeros(10), np.array([1] * 5 + [0] * 5))
    w, b = toxicity.train(own, 2, 1e-3)
    assert w[0] > 3 and w[0] > 10 * w[1]
    score = -np.expm1(-own.evidence(w, b))
    plain = [1 - np.prod([1 / (1 + np.exp(b + sum(w[c] for r, c in entries if r == i))) for i, (e, _) in enumerate(bags) if e == d]) for d in range(10)]
    assert np.allclose(score, plain) and min(score[:5]) > 0.7 > 0.3 > max(score[5:])


def test_offending_sentences_are_located(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    model = toxicity.fit(docs, spark.read.parquet(f"{FOLDER}/labels.parquet"), F.lit(True))
    text = "A nice day. It is fine.\nYou pathetic loser! The end"
    odd = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string")
    (row,) = toxicity.offending_sentences(odd, model).collect()
    assert (row.doc_id, row.sentence, row.text) == (1, 3, "You pathetic loser")
    scored = {r.doc_id: r for r in toxicity.score(odd, model).collect()}
    assert scored[1].worst_sentence == 3 and scored[2].score == scored[3].score == 0 and scored[2].worst_sentence == -1


def test_features_match_a_plain_split():
    texts = ["One two. Two two three!\n\nfour? Ünï éinundzwanzig", "", "...", None, "same same. same", "naïveté naïvement"]
    s = toxicity.sentence_features(texts)
    wanted, held = set(), []
    for d, t in enumerate(texts):
        for i, part in enumerate(re.split(r"[.!?\n]", (t or "").lower())):
            for features in plain_features(part):
                held.append((d, i))
                wanted |= {(d, i, hash_of(f)) for f in features}
    got = list(zip(s.doc.tolist(), s.sentence.tolist(), s.feature.tolist()))
    assert set(got) == wanted and len(got) == len(wanted) and held == list(zip(s.held_doc.tolist(), s.held_sentence.tolist()))


def test_defined_cases(spark, tmp_path):
    folder = corpus.written(corpus.clashing(corpus.odd_documents(spark)), tmp_path)
    marks = [(4, 1), (5, 0), (6, None), (7, 1), (8, 0), (99, 1), (None, 0)]
    spark.createDataFrame(marks, "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
    rows = toxicity.query(spark, folder).collect()
    assert len(rows) == len(corpus.odd_rows()) and all(0 <= r.score <= 1 for r in rows)
    by_id = {r.doc_id: r.score for r in rows}
    assert by_id[4] == by_id[5] == by_id[6] and by_id[0] == by_id[1] == 0


def test_ties_and_long_texts():
    names = np.array(sorted([hash_of(("bad", True))]))
    model = toxicity.SentenceModel(names, np.array([4.0]), -2.0)
    texts = ["fine. bad one. bad two. fine", "word " * 200_000 + ". bad", "bad" * 100_000]
    _, worst, _ = model.documents(texts, toxicity.Known(names))
    assert worst.tolist() == [1, 1, 0]


def test_empty_tables(spark, tmp_path):
    folder = corpus.written(corpus.empty_documents(spark), tmp_path)
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
    assert toxicity.query(spark, folder).collect() == []
