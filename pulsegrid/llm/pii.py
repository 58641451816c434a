"""Finds personal data: fixed rules give the base spans, boosted trees select further ones. Only DataFrame functions.

Generators with high recall propose spans that overlap each other and the base. Every candidate becomes a cell of
small features of its format and of what stands around it. Positive examples are the candidates that overlap a base span, and those
that pass their kind's own check once normalised: an address with (at) and (dot) written out, four octets, a card number or
9 to 15 digits, the last three next to a word for their kind. Gradient-boosted trees are fitted on the counts per
cell, over all documents, and become a column expression. The threshold of each kind is calibrated to the precision wanted on
the same counts. Candidates above it that touch no base span are added, whatever their share. Base spans always stay.

Positions come from splitting a text at the matches: gap and match lengths, summed up in order. Patterns are
possessive and start at the start of a run, so that they take time in proportion to the text.

Defined cases: a null text is empty; null ids and repeated rows are documents of their own. Without positive examples of a
kind nothing of it is added. An empty table gives an empty result. Columns besides the id and the text are not read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from pulsegrid.llm.common import documents
from pulsegrid.session import durable

#: Kinds in the order of the result.
KINDS = ("email", "ip", "card", "phone")
_LOCAL = "[A-Za-z0-9._%+-]"
_HOST = "[A-Za-z0-9-]+"
#: Base rules. A match may start where the last one ended or where its first run starts.
BASE = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@{_HOST}(?:\.{_HOST})++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Generators: looser forms of each kind.
LOOSE = {
    "email": rf"(?<!{_LOCAL}){_LOCAL}++\x20?(?:@|\(at\)|\[at\])\x20?{_HOST}(?:(?:\.|\x20?\(dot\)\x20?|\x20?\[dot\]\x20?){_HOST})++",
    "ip": r"(?<![0-9.])[0-9]{1,3}(?:[.,:-][0-9]{1,3}){3}(?![0-9])",
    "card": r"(?<![0-9])[0-9](?:[\x20.-]{0,2}[0-9]){11,18}(?![0-9])",
    "phone": r"(?<![0-9])\(?[0-9]{2,4}\)?[\x20.-]{1,2}[0-9]{3}[\x20.-]?[0-9]{4}(?![0-9])",
}
_OCTET = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
CONTEXT = 16
#: Words before a match that name its kind.
WORDS = {
    "email": "(?i)mail|contact|write|addr",
    "ip": r"(?i)\bip\b|ipv4|addr|host|server",
    "card": "(?i)card|visa|master|credit|pay",
    "phone": r"(?i)phone|\btel|call|fax|mobil|cell|[+][0-9]",
}
#: Trees, their learning rate, and the share of positive examples among what the threshold lets through.
TREES = 24
RATE = 0.4
PRECISION = 0.98


# ---- spans ------------------------------------------------------------------------------------------


def _matches(text: Column, rule: int, pattern: str) -> Column:
    """Array of (rule, nth, gap, found, left, right): each match, the length of the gap before it, and what is around it."""
    gaps = F.split(text, pattern, -1)
    zipped = F.arrays_zip(
        gaps.alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"), F.slice(gaps, 2, 2**31 - 1).alias("after"))
    return F.filter(F.transform(zipped, lambda x, i: F.struct(
        F.lit(rule).alias("rule"), i.alias("nth"), F.char_length(x["gap"]).cast("long").alias("gap"), x["found"].alias("found"),
        F.right(x["gap"], F.lit(CONTEXT)).alias("left"), F.left(x["after"], F.lit(1)).alias("right"),
    )), lambda x: x["found"].isNotNull())


def proposed(docs: DataFrame) -> DataFrame:
    """(row, doc_id, rule, nth, gap, found, left, right): a row for each match of each rule, and one without for a
    document that has none. Rules 0 to 3 are the base, 4 to 7 the generators."""
    text = F.col("text")
    rules = [*BASE.values(), *LOOSE.values()]
    # What a match of the rule must contain, by a quick search; most texts have neither.
    has_at, has_digit = F.lower(text).rlike(r"@|[(\[]at[)\]]"), text.rlike("[0-9]")
    nothing = "array<struct<rule:int,nth:int,gap:bigint,found:string,left:string,right:string>>"
    arrays = [F.when(has_at if i % 4 == 0 else has_digit, _matches(text, i, p)).otherwise(F.array().cast(nothing)) for i, p in enumerate(rules)]
    # Numbered before the explode, which would number its own rows.
    numbered = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return numbered.select("row", "doc_id", F.explode_outer(F.concat(*arrays)).alias("m")).select("row", "doc_id", "m.*")


def located(found: DataFrame) -> DataFrame:
    """Adds start and end in code points."""
    length = F.char_length("found").cast("long")
    so_far = W.partitionBy("row", "rule").orderBy("nth").rowsBetween(W.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + length).over(so_far)
    return found.where(F.col("found").isNotNull()).withColumn("end", end).withColumn("start", F.col("end") - length)


def digits_of(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def passes_luhn(digits: Column) -> Column:
    """Every second digit from the right counts double, less 9 if above 9; the sum is a multiple of 10."""
    def value(i: Column) -> Column:
        d = F.substr(digits, F.char_length(digits) - i, F.lit(1)).cast("int")
        return F.when(i % 2 == 0, d).otherwise(d * 2 - F.when(d > 4, 9).otherwise(0))

    total = F.aggregate(F.sequence(F.lit(0), F.char_length(digits) - 1), F.lit(0), lambda s, i: s + value(i))
    return F.when(F.char_length(digits).between(13, 19), total % 10 == 0).otherwise(False)


def valid(found: DataFrame) -> DataFrame:
    """The base matches that keep their rule's limits."""
    digits, ok = digits_of(F.col("found")), F.col("found").rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")
    return found.where(F.col("rule") < 4).where(
        (F.col("rule") == 0) | ((F.col("rule") == 1) & ok) | ((F.col("rule") == 2) & passes_luhn(digits))
        | ((F.col("rule") == 3) & F.char_length(digits).between(9, 15)))


# ---- candidates and their cells ---------------------------------------------------------------------


def _class(character: Column) -> Column:
    """0 none or white space, 1 letter, 2 digit, 3 plus, 4 other."""
    return (F.when(character.isNull() | (character == "") | character.rlike(r"^\s"), 0).when(character.rlike(r"^\p{L}"), 1)
            .when(character.rlike("^[0-9]"), 2).when(character == "+", 3).otherwise(4))


def by_kind(kind: Column, choices: dict[str, Column]) -> Column:
    out = F.lit(None)
    for number, name in enumerate(KINDS):
        out = F.when(kind == number, choices[name]).otherwise(out)
    return out


#: Features of a cell, each a small number: at most 4 * 7 * 2 * 2 * 5 * 5 * 4 * 2 cells reach the driver.
def cells(found: DataFrame) -> DataFrame:
    text, digits = F.col("found"), digits_of(F.col("found"))
    count, kind = F.char_length(digits), F.col("rule") - 4
    # With (at) and (dot) written as signs the generator's form is an address, but for spaces around a sign.
    address = ~F.contains(text, F.lit(" @")) & ~F.contains(text, F.lit("@ "))
    dotted = F.regexp_replace(text, "[,:-]", ".")
    form = by_kind(kind, {
        "email": address, "ip": dotted.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"),
        "card": F.coalesce(passes_luhn(digits), F.lit(False)), "phone": count.between(9, 15)})
    return found.where(F.col("rule") >= 4).withColumns({
        "f_kind": kind,
        "f_digits": sum(((count >= n).cast("int") for n in (1, 9, 11, 13, 16, 17)), F.lit(0)),
        "f_luhn": F.coalesce(passes_luhn(digits), F.lit(False)).cast("int"),
        "f_form": form.cast("int"),
        "f_left": _class(F.right("left", F.lit(1))),
        "f_right": _class(F.col("right")),
        "f_marks": sum((F.contains(text, F.lit(mark)).cast("int") for mark in ("-", " ", "(")), F.lit(0)),
        "f_word": by_kind(kind, {name: F.col("left").rlike(words) for name, words in WORDS.items()}).cast("int"),
    })


FEATURES = ("f_kind", "f_digits", "f_luhn", "f_form", "f_left", "f_right", "f_marks", "f_word")


def is_positive() -> Column:
    """A written address needs no word beside it; numbers do, as many numbers pass a check by chance."""
    return F.col("overlaps") | ((F.col("f_form") == 1) & ((F.col("f_kind") == 0) | (F.col("f_word") == 1)))


def with_overlap(candidates: DataFrame, base: DataFrame) -> DataFrame:
    """Adds whether a candidate overlaps a base span of its document, from running ends and starts; no pairs."""
    spans = candidates.withColumn("is_base", F.lit(False)).unionByName(
        base.select("row", "start", "end").withColumn("is_base", F.lit(True)), allowMissingColumns=True)
    forward = W.partitionBy("row").orderBy("start", F.col("is_base").desc()).rowsBetween(W.unboundedPreceding, 0)
    backward = W.partitionBy("row").orderBy(F.col("start").desc(), F.col("is_base").desc()).rowsBetween(W.unboundedPreceding, 0)
    reach = F.max(F.when(F.col("is_base"), F.col("end"))).over(forward)
    ahead = F.min(F.when(F.col("is_base"), F.col("start"))).over(backward)
    touched = F.coalesce(reach > F.col("start"), F.lit(False)) | F.coalesce(ahead < F.col("end"), F.lit(False))
    return spans.withColumn("overlaps", touched).where(~F.col("is_base")).drop("is_base")


# ---- boosted trees on cell counts -------------------------------------------------------------------


@dataclass(frozen=True)
class Split:
    feature: int
    most: int
    left: Split | float
    right: Split | float

    def value(self, x: tuple[int, ...]) -> float:
        branch = self.left if x[self.feature] <= self.most else self.right
        return branch.value(x) if isinstance(branch, Split) else branch

    def column(self) -> Column:
        left, right = (b.column() if isinstance(b, Split) else F.lit(b) for b in (self.left, self.right))
        return F.when(F.col(FEATURES[self.feature]) <= self.most, left).otherwise(right)


Cell = tuple[tuple[int, ...], float, float]  # features, candidates, positives


def _grow(rows: list[tuple[tuple[int, ...], float, float]], depth: int) -> Split | float:
    """A tree on (features, gradient, hessian) by the usual gain."""
    g, h = sum(r[1] for r in rows), sum(r[2] for r in rows)
    best, gain = None, 1e-9
    for f in range(len(FEATURES) if depth else 0):
        for v in sorted({r[0][f] for r in rows})[:-1]:
            gl, hl = sum(r[1] for r in rows if r[0][f] <= v), sum(r[2] for r in rows if r[0][f] <= v)
            found = gl * gl / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g * g / (h + 1)
            if found > gain:
                best, gain = (f, v), found
    if best is None:
        return RATE * g / (h + 1)
    f, v = best
    return Split(f, v, _grow([r for r in rows if r[0][f] <= v], depth - 1), _grow([r for r in rows if r[0][f] > v], depth - 1))


def boost(counts: list[Cell], depth: int = 3) -> list[Split | float]:
    score = [0.0] * len(counts)
    trees: list[Split | float] = []
    for _ in range(TREES):
        p = [1 / (1 + math.exp(-s)) for s in score]
        tree = _grow([(x, pos - n * q, n * q * (1 - q)) for (x, n, pos), q in zip(counts, p)], depth)
        trees.append(tree)
        score = [s + (tree.value(x) if isinstance(tree, Split) else tree) for s, (x, _, _) in zip(score, counts)]
    return trees


def calibrated(counts: list[Cell], trees: list[Split | float], precision: float) -> float:
    """The lowest score above which the share of positives is still ``precision``, and at least half at every score; infinite if
    none is."""
    levels: dict[float, list[float]] = {}
    for x, n, pos in counts:
        level = levels.setdefault(sum(t.value(x) if isinstance(t, Split) else t for t in trees), [0.0, 0.0])
        level[0], level[1] = level[0] + n, level[1] + pos
    best, seen, hits = math.inf, 0.0, 0.0
    for score, (n, pos) in sorted(levels.items(), reverse=True):
        seen, hits = seen + n, hits + pos
        if pos < n / 2:
            break
        if seen and hits >= precision * seen:
            best = score
    return best


def selected(candidates: DataFrame, precision: float) -> DataFrame:
    """The candidates to add: off the base spans, above the calibrated threshold, the leftmost of those that overlap."""
    off = ~F.col("overlaps")
    counted = candidates.groupBy(*FEATURES).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(is_positive()).alias("hits"), F.count_if(off).alias("off"), F.count_if(off & is_positive()).alias("off_hits")).collect()
    counts = sorted((tuple(r[f] for f in FEATURES), float(r.n), float(r.hits)) for r in counted)
    # What may be added lies off the base spans, so the thresholds are calibrated there.
    open_counts = sorted((tuple(r[f] for f in FEATURES), float(r.off), float(r.off_hits)) for r in counted if r.off)
    if not any(pos for _, _, pos in counts):
        return candidates.where(F.lit(False))
    trees = boost(counts)
    least = {name: F.lit(calibrated([c for c in open_counts if c[0][0] == number], trees, precision) - 1e-9) for number, name in enumerate(KINDS)}
    score = sum((t.column() if isinstance(t, Split) else F.lit(t) for t in trees), F.lit(0.0))
    # The sum in the plan may differ from the driver's in the last bits, hence the small allowance.
    added = candidates.where(~F.col("overlaps") & (score >= by_kind(F.col("f_kind"), least)))
    before = W.partitionBy("row").orderBy("start", F.col("end").desc(), "rule").rowsBetween(W.unboundedPreceding, -1)
    return added.withColumn("reach", F.max("end").over(before)).where(F.col("reach").isNull() | (F.col("reach") <= F.col("start"))).drop("reach")


def personal_data(docs: DataFrame, precision: float = PRECISION) -> tuple[DataFrame, DataFrame]:
    """(row, doc_id) of every document, and (row, kind, start, end, added, found) of every span."""
    found = durable(proposed(docs))
    spans = durable(located(found))
    base = valid(spans)
    candidates = durable(with_overlap(cells(spans), base))
    kind = F.element_at(F.array(*map(F.lit, KINDS)), F.pmod("rule", F.lit(4)) + 1)
    columns = ("row", F.pmod("rule", F.lit(4)).alias("order"), kind.alias("kind"), "start", "end", "found")
    both = base.select(*columns, F.lit(False).alias("added")).unionByName(selected(candidates, precision).select(*columns, F.lit(True).alias("added")))
    return found.select("row", "doc_id").distinct(), both


def query(spark: SparkSession, folder: str) -> DataFrame:
    rows, spans = personal_data(documents(spark, folder))
    listed = spans.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("order", "start", "end", "kind", "added"))).alias("s"))

    def joined(which: Column) -> Column:
        return F.coalesce(F.array_join(F.transform(which, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ","), F.lit(""))

    base = F.filter("s", lambda x: ~x["added"])

    def count(name: str) -> Column:
        own = F.filter("s", lambda x: ~x["added"] & (x["kind"] == name))
        return F.coalesce(F.array_size(own), F.lit(0)).cast("long").alias(f"n_{name}")

    return rows.join(listed, "row", "left").select(
        "doc_id", *map(count, KINDS), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("s")).alias("spans"),
        F.coalesce(F.array_size(F.filter("s", lambda x: x["added"])), F.lit(0)).cast("long").alias("n_added"))
