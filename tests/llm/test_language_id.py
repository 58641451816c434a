"""Language identification: held-out accuracy and defined cases."""

import collections
import math

import corpus
import numpy as np
from pyspark.sql import functions as F

from pulsegrid.llm import language_id

FOLDER = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    found = language_id.query(spark, FOLDER).where("held_out").join(spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "lang"), "doc_id")
    right, total, rejected = found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*"), F.sum(F.col("rejected").cast("int"))).first()
    assert total > 100 and right > 0.97 and rejected <= 0.01 * total


def test_defined_cases(spark, tmp_path):
    folder = corpus.written(corpus.clashing(corpus.odd_documents(spark)), tmp_path)
    rows = language_id.query(spark, folder).collect()
    assert len(rows) == len(corpus.odd_rows())
    by_id = {r.doc_id: r for r in rows}
    for i in (0, 1, 2, 3, 16):
        assert (by_id[i].lang_pred, by_id[i].score) == ("und", 0.0)
    assert all(0 <= r.score <= 1 and r.lang_pred in ("en", "de", "fr", "und") for r in rows)
    assert by_id[4].lang_pred == by_id[5].lang_pred and by_id[4].score == by_id[5].score


def test_foreign_text_is_rejected(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    model = language_id.fit(docs, F.lit(True))
    odd = spark.createDataFrame([(1, "ξενοδοχείο αυτοκίνητο " * 9), (2, "zxqj kvwq zzxj qqkx " * 9), (3, "The and of the in on that")], "doc_id long, text string")
    found = {r.doc_id: r.rejected for r in language_id.predict(odd, model).collect()}
    assert found == {1: True, 2: True, 3: False}


def test_number_signs_are_no_letters(spark):
    model = language_id.fit(spark.read.parquet(f"{FOLDER}/documents.parquet"), F.lit(True))
    texts = ["½", "²", "Ⅷ 2", "٣ ४", "_", "①", "½ x", "ª", "漢"]
    odd = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {texts[r.doc_id]: r for r in language_id.predict(odd, model).collect()}
    assert all(found[t].lang_pred == "und" and found[t].score == 0 for t in texts[:6])
    assert all(found[t].lang_pred != "und" for t in texts[6:])


def plain_grams(text):
    """Hashed n-gram counts by their definition."""
    words = "".join(chr(c) if c >= 128 or 97 <= c <= 122 else " " for c in text.lower().encode()).encode("latin-1").split(b" ")
    data = b" " + b"".join(w + b" " for w in words if w)
    out = collections.Counter()
    for n in language_id.ORDERS:
        for i in range(len(data) - n + 1):
            gram = int.from_bytes(data[i:i + n], "big")
            out[((gram + n) * 2654435761 % 2**32) >> 20] += 1
    return out


def test_nearest_centroid_by_hand(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    model = language_id.fit(docs, F.lit(True))
    texts = [r.text for r in docs.limit(25).collect()] + ["a", "é", "x" * 5000, "Der Hund. " * 3000]
    for text in texts:
        grams = plain_grams(text)
        vector = {g: math.log1p(c) * float(model.idf[g]) for g, c in grams.items()}
        norm = math.sqrt(sum(v * v for v in vector.values()))
        cosines = [sum(v * float(row[g]) for g, v in vector.items()) / norm for row in model.matrix]
        lang, score, _ = model.predict(text)
        assert abs(score - min(1, max(0, max(cosines)))) < 1e-4
        assert cosines[model.languages.index(lang):] and max(c for c, own in zip(cosines, model.languages) if own == lang) >= max(cosines) - 1e-5


def test_ties_take_the_first_language():
    row = np.ones((1, language_id.DIMENSIONS), dtype=np.float32) / 64
    model = language_id.Centroids(np.ones(language_id.DIMENSIONS, dtype=np.float32), np.concatenate([row, row]), ["aa", "bb"], np.zeros(language_id.LENGTH_BANDS))
    assert model.predict("some text")[0] == "aa"


def test_empty_table(spark, tmp_path):
    folder = corpus.written(corpus.empty_documents(spark), tmp_path)
    assert language_id.query(spark, folder).collect() == []
