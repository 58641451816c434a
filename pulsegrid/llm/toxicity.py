"""Toxicity by multiple-instance learning: sentences are scored, documents are their noisy-or.

Every sentence has a probability from the features of its words, which are the words and their beginnings of 4 to 7
letters (languages that build words from parts share these); a document is toxic unless no sentence is. The weights are
trained from document labels alone through the noisy-or, so the model also tells which sentences made a document
toxic (:func:`offending_sentences`).

Training counts, in Spark, how many documents of each label hold a feature, and keeps the features that go with the
toxic label. The lasso's penalty is the one whose model explains the labels of a quarter of the training documents best,
fitted without them; the bias is set on these as well. Both labels count alike in total, so a score of 0.7 means 0.7
at even odds of the labels, whatever their shares in a table are.

Defined cases: a null or empty text has no sentence and scores what no evidence scores, 0. Rows with equal texts get
equal scores; repeated ids are scored row by row. With labels of one kind only, or none, every score is 0. Label
rows without a document, or with a null label, are left out. Columns besides the ids, text and toxic are not read.

The model is fitted on about ``PER_LABEL`` labelled documents of each label, chosen by a hash of the id, and has at
most ``MOST_FEATURES`` features; what reaches the driver of a training document is where it holds these.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pulsegrid.llm.batches import map_batches, text_groups
from pulsegrid.llm.common import crc_bucket, documents, labels
from pulsegrid.llm.hashing import run_edges, segment_hashes

PER_LABEL = 3000
MOST_FEATURES = 50_000
#: Letters of the beginnings.
STEMS = (4, 5, 6, 7)
#: Bits of a feature's hash; a group of texts has fewer than 2^(64 - FEATURE_BITS) sentences.
FEATURE_BITS = 40
#: Features are tried from this likelihood ratio between the labels on; the lasso chooses among them.
LEAST_RATIO = 8.0
PENALTIES = (1e-4, 3e-4, 1e-3, 3e-3)
#: Steps and rates of the lasso and of the fit without it of what it chose.
STEPS, REFIT = (200, 0.5), (100, 0.2)
SHIFTS = np.round(np.arange(-2.0, 2.05, 0.1), 1)
FIRST_BIAS = -5.0
THRESHOLD = 0.7
GROUP_BYTES = 2 << 20

_SENTENCE_END = re.compile(r"[.!?\n]")
_IS_LETTER = np.array([c >= 128 or 97 <= c <= 122 for c in range(256)])
_IS_END = np.isin(np.arange(256), [ord(c) for c in ".!?\n"])
_WHOLE = np.uint64(0x9E3779B97F4A7C15)


class Known:
    """Membership in a sorted array, most misses by one look at a table of bits."""

    def __init__(self, names: np.ndarray):
        self.names = names
        self.table = np.zeros(1 << 20, dtype=bool)
        self.table[names & 0xFFFFF] = True

    def which(self, found: np.ndarray) -> np.ndarray:
        """Indices of ``found`` that are names."""
        maybe = np.flatnonzero(self.table[(found & np.uint64(0xFFFFF)).astype(np.int64)])
        if not len(maybe) or not len(self.names):
            return maybe[:0]
        at = np.minimum(np.searchsorted(self.names, found[maybe].astype(np.int64)), len(self.names) - 1)
        return maybe[self.names[at] == found[maybe].astype(np.int64)]


@dataclass
class Sentences:
    """Features of texts: (doc, sentence, feature), distinct and in order, of ``known`` features where these are given;
    and, in order, (doc, sentence) of every sentence with a word. Sentences are numbered from 0 in each document."""

    doc: np.ndarray
    sentence: np.ndarray
    feature: np.ndarray
    held_doc: np.ndarray
    held_sentence: np.ndarray


def sentence_features(texts: list[str | None], known: Known | None = None) -> Sentences:
    encoded = [(t or "").lower().encode("utf-8", "replace") for t in texts]
    data = np.frombuffer(b"\n".join(encoded) + b"\n", dtype=np.uint8)
    bounds = np.cumsum([0] + [len(e) + 1 for e in encoded])
    starts, ends = run_edges(_IS_LETTER[data])
    # Beginnings are cut at characters.
    first_byte = (data & 0xC0) != 0x80
    place = np.flatnonzero(first_byte)
    number = np.cumsum(first_byte)
    first, last = number[starts] - 1, number[ends - 1]
    ended = np.cumsum(_IS_END[data])
    sentence = ended[starts]
    # The separator after a document ends its last sentence.
    before = np.concatenate([[0], ended[bounds[1:] - 1]])
    held = sentence[np.flatnonzero(np.diff(sentence, prepend=-1))]
    cells = []
    for letters in (None, *STEMS):
        if letters is None:
            own, found = np.arange(len(starts)), segment_hashes(data, starts, ends) * _WHOLE
        else:
            own = np.flatnonzero(last - first > letters)
            found = segment_hashes(data, starts[own], place[first[own] + letters])
        found = found >> np.uint64(64 - FEATURE_BITS)
        if known is not None:
            at = known.which(found)
            own, found = own[at], found[at]
        cells.append(sentence[own].astype(np.uint64) << np.uint64(FEATURE_BITS) | found)
    cells = np.unique(np.concatenate(cells))
    sentence = (cells >> np.uint64(FEATURE_BITS)).astype(np.int64)
    doc, held_doc = (np.searchsorted(before, s, side="right") - 1 for s in (sentence, held))
    return Sentences(doc, sentence - before[doc], (cells & np.uint64((1 << FEATURE_BITS) - 1)).astype(np.int64), held_doc, held - before[held_doc])


def softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0.0, z)


@dataclass
class SentenceModel:
    features: np.ndarray  # hashes of the features that have a weight, sorted
    weights: np.ndarray
    bias: float

    def sentence_scores(self, texts: list[str], known: Known) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, sentence, score logit) of every sentence with a word."""
        s = sentence_features(texts, known)
        z = np.full(len(s.held_doc), self.bias)
        if len(s.doc):
            held = s.held_doc << 32 | s.held_sentence
            np.add.at(z, np.searchsorted(held, s.doc << 32 | s.sentence), self.weights[np.searchsorted(self.features, s.feature)])
        return s.held_doc, s.held_sentence, z

    def documents(self, texts: list[str], known: Known) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Noisy-or score of every document, its worst sentence (-1: none) and that sentence's score."""
        doc, sentence, z = self.sentence_scores(texts, known)
        score = -np.expm1(-np.bincount(doc, weights=softplus(z), minlength=len(texts)))
        worst, worst_score = np.full(len(texts), -1, dtype=np.int64), np.zeros(len(texts))
        order = np.lexsort((-sentence, z, doc))  # the last of each document: largest score, first of equals
        last = order[np.flatnonzero(np.concatenate([np.diff(doc[order]) != 0, [True]]))] if len(order) else order
        worst[doc[last]], worst_score[doc[last]] = sentence[last], 1 / (1 + np.exp(-z[last]))
        return np.clip(score, 0.0, 1.0), worst, worst_score


def training_rows(docs: DataFrame, marks: DataFrame, eligible: Column, per_label: int) -> DataFrame:
    """(text, toxic, spare): about ``per_label`` documents of each label; a quarter is spared for choosing the penalty."""
    known = marks.where(eligible & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    totals = {r.toxic: r.rows for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("rows")).collect()}
    share = F.pmod(F.xxhash64(F.lit(7), "doc_id"), F.lit(1 << 40)) / float(1 << 40)
    kept = F.lit(False)
    for label, rows in totals.items():
        own = F.col("toxic") == label
        kept = kept | (own & (share < per_label / rows))
    # About per_label ids of each label: small enough to broadcast whatever the table's size.
    spare = F.pmod(F.xxhash64(F.lit(8), "doc_id"), F.lit(4)) == 0
    chosen = F.broadcast(known.where(kept).withColumn("spare", spare))
    return docs.select("doc_id", "text").join(chosen, "doc_id").select("text", F.col("toxic").cast("int").alias("toxic"), "spare")


def likelihood_ratio(a: Column, b: Column, n_a: int, n_b: int) -> Column:
    """Twice the log likelihood gained by two shares, a of n_a and b of n_b, over one."""

    def part(k: Column, n: int, share: Column) -> Column:
        return F.when(k > 0, k * F.log(share)).otherwise(0.0) + F.when(k < n, (F.lit(n) - k) * F.log(1 - share)).otherwise(0.0)

    both = (a + b) / (n_a + n_b)
    return 2 * (part(a, n_a, a / n_a) + part(b, n_b, b / n_b) - part(a, n_a, both) - part(b, n_b, both))


def candidates(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Features that toxic documents hold more often than others do, by all training documents and by those not spared."""

    def held(batch):
        toxic, spare = batch["toxic"].to_numpy(), batch["spare"].to_numpy(zero_copy_only=False)
        s = sentence_features(batch["text"].to_pylist())
        cells = np.unique(np.stack([s.feature, s.doc]), axis=1) if len(s.doc) else np.zeros((2, 0), dtype=np.int64)
        names, at = np.unique(cells[0], return_inverse=True)
        kind = 2 * toxic[cells[1]] + spare[cells[1]]
        return {"feature": names} | {n: np.bincount(at[kind == k], minlength=len(names)) for k, n in enumerate(("clean", "clean_spare", "toxic", "toxic_spare"))}

    kinds = {(r.toxic, r.spare): r.n for r in rows.groupBy("toxic", "spare").agg(F.count(F.lit(1)).alias("n")).collect()}
    clean, toxic = (kinds.get((t, False), 0) for t in (0, 1))
    all_clean, all_toxic = clean + kinds.get((0, True), 0), toxic + kinds.get((1, True), 0)
    if not clean or not toxic:
        return (np.zeros(0, dtype=np.int64),) * 2
    names = ("clean", "clean_spare", "toxic", "toxic_spare")
    # A batch's features are counted where they are found, so a word of every document is a row per batch.
    counts = map_batches(rows, held, "feature long, " + ", ".join(f"{n} long" for n in names), rows=256).groupBy("feature").agg(*[F.sum(n).alias(n) for n in names])
    of_all = F.col("toxic") + F.col("toxic_spare"), F.col("clean") + F.col("clean_spare")
    of_fit = F.col("toxic"), F.col("clean")
    scored = counts.select("feature", *[F.when(a * n_b > b * n_a, likelihood_ratio(a, b, n_a, n_b)).otherwise(0.0).alias(n) for n, (a, b), n_a, n_b in (
        ("whole", of_all, all_toxic, all_clean), ("part", of_fit, toxic, clean))])
    found = []
    for n in ("whole", "part"):
        best = scored.where(F.col(n) > LEAST_RATIO).orderBy(F.col(n).desc(), "feature").limit(MOST_FEATURES).select("feature").toPandas()
        found.append(np.sort(best["feature"].to_numpy(dtype=np.int64)))
    return found[0], found[1]


@dataclass
class Bags:
    """Training documents: sentences that hold features, and how many others each document has."""

    row: np.ndarray  # sentence and feature of every entry
    column: np.ndarray
    bag_doc: np.ndarray
    plain: np.ndarray
    toxic: np.ndarray

    def part(self, docs: np.ndarray, features: np.ndarray) -> "Bags":
        """The documents of a mask, and the features of another."""
        bags = docs[self.bag_doc]
        kept = bags[self.row] & features[self.column]
        new_bag, new_doc, new_feature = np.cumsum(bags) - 1, np.cumsum(docs) - 1, np.cumsum(features) - 1
        return Bags(new_bag[self.row[kept]], new_feature[self.column[kept]], new_doc[self.bag_doc[bags]], self.plain[docs], self.toxic[docs])

    def evidence(self, weights: np.ndarray, bias: float) -> np.ndarray:
        z = np.bincount(self.row, weights=weights[self.column], minlength=len(self.bag_doc)) + bias
        return np.bincount(self.bag_doc, weights=softplus(z), minlength=len(self.toxic)) + self.plain * softplus(np.array(bias))

    def weight(self) -> np.ndarray:
        """Both labels count alike in total."""
        share = np.where(self.toxic == 1, (self.toxic == 1).sum(), (self.toxic == 0).sum())
        return 0.5 / np.maximum(share, 1)

    def likelihood(self, weights: np.ndarray, bias: float) -> float:
        p = np.clip(-np.expm1(-self.evidence(weights, bias)), 1e-6, 1 - 1e-6)
        return float((self.weight() * np.where(self.toxic == 1, np.log(p), np.log1p(-p))).sum())


def train(bags: Bags, size: int, penalty: float) -> tuple[np.ndarray, float]:
    """Adagrad on the noisy-or likelihood: a lasso finds the features, and they are fitted again without it.

    Features can only add evidence: with negative weights, clean words that happen to surround toxic ones in training
    would hide them elsewhere.
    """
    w, b, found = np.zeros(size), FIRST_BIAS, np.ones(size, dtype=bool)
    count, weight = len(bags.toxic), bags.weight()
    for (steps, rate), lasso in ((STEPS, penalty), (REFIT, 0.0)):
        gw, gb = np.full(size, 1e-8), 1e-8
        for _ in range(steps):
            z = np.bincount(bags.row, weights=w[bags.column], minlength=len(bags.bag_doc)) + b
            evidence = np.bincount(bags.bag_doc, weights=softplus(z), minlength=count) + bags.plain * softplus(np.array(b))
            slope = np.where(bags.toxic == 1, -1.0 / np.expm1(np.clip(evidence, 1e-12, 50.0)), 1.0) * weight
            dz = slope[bags.bag_doc] / (1 + np.exp(-z))
            dw = np.bincount(bags.column, weights=dz[bags.row], minlength=size) + lasso
            db = float(dz.sum() + (slope * bags.plain).sum() / (1 + np.exp(-b)))
            gw += dw * dw
            gb += db * db
            w = np.where(found, np.maximum(w - rate / np.sqrt(gw) * dw, 0.0), 0.0)
            b -= 0.2 * rate / np.sqrt(gb) * db
        found = w > 0
    return w, b


def fit(docs: DataFrame, marks: DataFrame, eligible: Column, per_label: int = PER_LABEL) -> SentenceModel:
    nothing = SentenceModel(np.zeros(0, dtype=np.int64), np.zeros(0), -np.inf)
    sample = training_rows(docs, marks, eligible, per_label)
    whole, part = candidates(sample)
    names = np.union1d(whole, part)
    if not len(names):
        return nothing
    shared = docs.sparkSession.sparkContext.broadcast(names)

    def features(batch):
        known = Known(shared.value)
        out = {"sentence": [], "feature": [], "plain": []}
        for text in batch["text"].to_pylist():
            s = sentence_features([text], known)
            out["sentence"].append(s.sentence.astype(np.int32).tobytes())
            out["feature"].append(np.searchsorted(shared.value, s.feature).astype(np.int32).tobytes())
            out["plain"].append(len(s.held_sentence) - len(np.unique(s.sentence)))
        return out | {"toxic": batch["toxic"], "spare": batch["spare"]}

    rows = map_batches(sample, features, "sentence binary, feature binary, plain long, toxic int, spare boolean").collect()
    rows.sort(key=lambda r: (r.toxic, r.spare, r.feature, r.sentence, r.plain))
    spare = np.array([r.spare for r in rows])
    sentence = [np.frombuffer(r.sentence, dtype=np.int32) for r in rows]
    column = np.concatenate([np.frombuffer(r.feature, dtype=np.int32) for r in rows])
    doc = np.repeat(np.arange(len(rows)), [len(x) for x in sentence])
    new = np.concatenate([[True], (np.diff(doc) != 0) | (np.diff(np.concatenate(sentence)) != 0)])[:len(doc)]
    bags = Bags(np.cumsum(new) - 1, column, doc[new], np.array([r.plain for r in rows]), np.array([r.toxic for r in rows]))
    of_part, of_whole = np.isin(names, part), np.isin(names, whole)
    fitted, tested = bags.part(~spare, of_part), bags.part(spare, of_part)
    if len(part) and len(np.unique(tested.toxic)) == 2:
        tried = [(train(fitted, len(part), p), p) for p in PENALTIES]
        (w, b), penalty = max(tried, key=lambda t: tested.likelihood(*t[0]))
        shift = max(SHIFTS, key=lambda x: (tested.likelihood(w, b + x), -abs(x)))
    else:
        penalty, shift = PENALTIES[0], 0.0
    w, b = train(bags.part(np.ones(len(rows), dtype=bool), of_whole), len(whole), penalty)
    kept = np.flatnonzero(w > 0)
    return SentenceModel(whole[kept], w[kept], float(b + shift))


def score(docs: DataFrame, model: SentenceModel) -> DataFrame:
    """(doc_id, score, worst_sentence, worst_score) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast((model.features, model.weights))
    bias = model.bias

    def each(batch):
        texts = batch["text"].to_pylist()
        own, known = SentenceModel(*shared.value, bias), Known(shared.value[0])
        parts = [own.documents(texts[lo:hi], known) for lo, hi in text_groups(texts, GROUP_BYTES)]
        found, worst, worst_score = (np.concatenate(p) for p in zip(*parts))
        return {"doc_id": batch["doc_id"], "score": found, "worst_sentence": worst, "worst_score": worst_score}

    return map_batches(docs.select(F.col("doc_id").cast("long"), "text"), each,
                       "doc_id long, score double, worst_sentence long, worst_score double")


def offending_sentences(docs: DataFrame, model: SentenceModel, least: float = 0.5) -> DataFrame:
    """(doc_id, sentence, text, score) of the sentences that score at least ``least``."""
    shared = docs.sparkSession.sparkContext.broadcast((model.features, model.weights))
    bias = model.bias

    def each(batch):
        ids, texts = batch["doc_id"].to_pylist(), batch["text"].to_pylist()
        doc, sentence, z = SentenceModel(*shared.value, bias).sentence_scores(texts, Known(shared.value[0]))
        p = 1 / (1 + np.exp(-z))
        at = np.flatnonzero(p >= least)
        split = {i: _SENTENCE_END.split(texts[i]) for i in set(doc[at].tolist())}
        return {"doc_id": [ids[doc[k]] for k in at], "sentence": sentence[at],
                "text": [split[doc[k]][sentence[k]] for k in at], "score": p[at]}

    return map_batches(docs.select(F.col("doc_id").cast("long"), "text"), each, "doc_id long, sentence long, text string, score double")


def held_out() -> Column:
    return crc_bucket("doc_id", 3) == 1


def query(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    model = fit(docs, labels(spark, folder), F.coalesce(~held_out(), F.lit(False)))
    return score(docs, model).select(
        "doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "worst_sentence", "worst_score",
    )
