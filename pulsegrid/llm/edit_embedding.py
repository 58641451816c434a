"""Document fingerprints by a randomised edit embedding.

A random walk reads a text: at step j it puts out the current character and moves on if a random bit of (step,
character) is set. All texts share the bits, so after an insertion or deletion the walks of two texts soon meet again,
and the edit distance shows as Hamming distance between the outputs. A fingerprint keeps a random sample of
the steps, the same for every text of a length class and nested between classes: a class twice as long keeps half of
the steps, so fingerprints stay some hundred symbols of four bits for texts of any length and are compared on the
steps both kept. Bands of sampled steps find candidates (:func:`near_pairs`), fingerprints verify them.

Defined cases: a null text is empty; its fingerprint is ``00:``, which is like another empty one only. Rows in the order
of the query go by descending id, null ids last and equal ids by text; a single row's next row is itself. Characters
are code points. An empty table gives an empty result. Columns besides the id and the text are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from pulsegrid.llm.batches import arrow_schema, map_batches
from pulsegrid.llm.common import documents
from pulsegrid.llm.components import components
from pulsegrid.llm.hashing import mix64
from pulsegrid.session import durable

#: Sampled steps per 2^level characters of a text of this level.
SAMPLES = 64
#: Steps a walk may take for each character; it needs two on average.
STRETCH = 3
#: Two unrelated texts agree in about so many symbols: by equal letters and by equal four-bit hashes.
CHANCE = 0.125
#: Most symbols of a band, and bands for each extent of steps; extents grow by a quarter, a text has bands for its last two.
BAND_SYMBOLS = 8
BANDS = 32
#: Members of a band that meet in one task are at most about twice as many.
BAND_BLOCK = 256
ROWS_PER_BLOCK = 4000
MOST_BINS = 1 << 16
GROUP_CHARS = 12 << 20
CHUNK = 256

_END = 16
_SYMBOLS = "0123456789abcdef"


def _step_values(start: int, count: int, salt: int) -> np.ndarray:
    return mix64(np.arange(start, start + count, dtype=np.uint64) + np.uint64(salt << 40))


def step_levels(start: int, count: int) -> np.ndarray:
    """The highest level that samples each step; all levels below do as well."""
    u = (_step_values(start, count, 1) >> np.uint64(11)).astype(np.float64) / float(1 << 53)
    return np.floor(np.log2(SAMPLES / np.maximum(u, 1e-15))).astype(np.int64)


def text_level(chars: int) -> int:
    return max(chars, 1).bit_length() - 1


@cache
def sampled_steps(level: int) -> np.ndarray:
    """Steps that texts of a level sample, in order."""
    total, found = STRETCH << (level + 1), []
    for start in range(0, total, 1 << 20):
        levels = step_levels(start, min(1 << 20, total - start))
        found.append(np.flatnonzero(levels >= level) + start)
    return np.concatenate(found)


def code_points(text: str) -> np.ndarray:
    """Code points plus one, so that 0 can end a text."""
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32) + np.uint32(1)


def fingerprints(texts: list[str]) -> list[str]:
    """Walk all texts at once; each step is a few operations on the texts still being read."""
    order = sorted(range(len(texts)), key=lambda i: len(texts[i]))
    lengths = np.array([len(texts[i]) for i in order], dtype=np.int64)
    data = np.concatenate([part for i in order for part in (code_points(texts[i]), np.zeros(1, dtype=np.uint32))] or [np.zeros(1, dtype=np.uint32)])
    levels = np.array([text_level(n) for n in lengths.tolist()], dtype=np.int64)
    steps_of = {level: sampled_steps(level) for level in set(levels.tolist())}
    symbols = [np.full((int((levels == level).sum()), len(steps_of[level])), _END, dtype=np.uint8) for level in range(int(levels.max(initial=0)) + 1)
               if level in steps_of]
    table = dict(zip(sorted(steps_of), symbols))
    row = np.concatenate([np.arange(len(table[level])) for level in sorted(table)]) if len(order) else np.zeros(0, dtype=np.int64)
    position = np.cumsum(lengths + 1) - (lengths + 1)
    active = np.flatnonzero(lengths)
    position, limit = position[active], STRETCH * lengths[active]
    start = 0
    while len(active):
        multipliers = (_step_values(start, CHUNK, 2) | np.uint64(1)).astype(np.uint32)
        level_here = levels[active]
        due: dict[int, list[tuple[int, int, int, int]]] = {}
        for level in np.unique(level_here).tolist():
            lo, hi = np.searchsorted(level_here, [level, level + 1])
            first, last = np.searchsorted(steps_of[level], [start, start + CHUNK])
            for k in range(first, last):
                due.setdefault(int(steps_of[level][k]) - start, []).append((level, k, int(lo), int(hi)))
        own_row = row[active]
        character, bit = np.empty(len(active), dtype=np.uint32), np.empty(len(active), dtype=np.uint32)
        for j in range(CHUNK):
            np.take(data, position, out=character, mode="clip")
            for level, k, lo, hi in due.get(j, ()):
                seen = character[lo:hi]
                hashed = (seen * np.uint32(2654435761)) >> np.uint32(28)
                table[level][own_row[lo:hi], k] = np.where(seen == 0, _END, hashed)
            np.multiply(character, multipliers[j], out=bit)
            np.right_shift(bit, 31, out=bit)
            np.add(position, bit, out=position, casting="unsafe")
        start += CHUNK
        going = (data[position] != 0) & (limit > start)
        active, position, limit = active[going], position[going], limit[going]
    out = [""] * len(texts)
    at = {level: iter(rows) for level, rows in table.items()}
    for i, level in zip(order, levels.tolist()):
        own = next(at[level])
        kept = own[:np.flatnonzero(own != _END)[-1] + 1] if (own != _END).any() else own[:0]
        out[i] = f"{level:02x}:" + "".join([_SYMBOLS[s] if s < _END else "." for s in kept.tolist()])
    return out


def _symbols(fingerprint: str, level: int) -> np.ndarray:
    """The symbols on the steps that texts of ``level`` sample."""
    own = int(fingerprint[:2], 16)
    values = np.frombuffer(fingerprint[3:].encode(), dtype=np.uint8)
    return values if own == level else values[_nested(own, level)[:len(values)]]


@cache
def _nested(own: int, level: int) -> np.ndarray:
    steps = sampled_steps(own)
    return np.isin(steps, sampled_steps(level))


def likeness(a: str, b: str) -> float:
    """Share of the sampled steps on which two texts agree, without what chance explains."""
    if a == b:
        return 1.0
    level = max(int(a[:2], 16), int(b[:2], 16))
    x, y = _symbols(a, level), _symbols(b, level)
    total = max(len(x), len(y))
    if not total:
        return 0.0
    both = min(len(x), len(y))
    agree = np.count_nonzero(x[:both] == y[:both]) / total
    return float(min(1.0, max(0.0, (agree - CHANCE) / (1 - CHANCE))))


# ---- every document with the next ------------------------------------------------------------------


def _blocks(docs: DataFrame) -> tuple[DataFrame, int]:
    """Documents dealt to blocks of neighbouring ids; the first of a block is also a guest of the block before it.

    Blocks are cut from a histogram of at most MOST_BINS bins, which is what reaches the driver.
    """
    low, high, known, total = docs.agg(F.min("key"), F.max("key"), F.count("key"), F.count(F.lit(1))).first()
    wanted = max(1, min(MOST_BINS // 16, math.ceil(total / ROWS_PER_BLOCK)))
    if not known:
        return docs.select(F.lit(0).alias("block"), F.explode(F.array(F.lit(0), F.lit(1))).alias("guest"), "key", "text"), 1
    bins = 16 * wanted
    width = (high - low + 1) / bins
    bin_of = F.least(F.lit(bins - 1), F.floor((F.col("key") - F.lit(low)).cast("double") / F.lit(float(width)))).cast("int")
    counts = {r.bin: r.n for r in docs.where(F.col("key").isNotNull()).groupBy(bin_of.alias("bin")).agg(F.count(F.lit(1)).alias("n")).collect()}
    block_of, block, held = [0] * bins, 0, 0
    for b in range(bins - 1, -1, -1):  # descending ids
        if held >= known / wanted and counts.get(b):
            block, held = block + 1, 0
        block_of[b] = block
        held += counts.get(b, 0)
    last = block
    number = F.when(F.col("key").isNull(), F.lit(last)).otherwise(F.element_at(F.lit(block_of), bin_of + 1))
    placed = docs.withColumn("block", number)
    heads = {r.block: r.head for r in placed.groupBy("block").agg(F.max("key").alias("head")).collect()}
    is_head = F.col("key").eqNullSafe(F.element_at(F.lit([heads[b] for b in range(last + 1)]), F.col("block") + 1))
    before = F.when(F.col("block") == 0, F.lit(last)).otherwise(F.col("block") - 1)
    own = F.struct(F.col("block").alias("block"), F.lit(0).alias("guest"))
    guest = F.struct(before.alias("block"), F.lit(1).alias("guest"))
    return placed.select(F.explode(F.when(is_head, F.array(own, guest)).otherwise(F.array(own))).alias("to"), "key", "text").select(
        "to.block", "to.guest", "key", "text"), last + 1


def with_next(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, bands_edited)."""
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, bands_edited long"
    fields = arrow_schema(schema)

    def walk(rows: list[tuple[int, int, int | None, str]]) -> pa.RecordBatch:
        """Rows in order; all but the last have their next row behind them."""
        pairs = [(a, b) for a, b in zip(rows, rows[1:]) if not a[1] and a[0] == b[0]]
        half = [len(a[3]) // 2 for a, _ in pairs]
        edited = [a[3][:len(a[3]) - h] + b[3][:h] for (a, b), h in zip(pairs, half)]
        texts = list(dict.fromkeys([t for a, b in pairs for t in (a[3], b[3])] + edited))
        known = dict(zip(texts, fingerprints(texts)))
        out: dict[str, list] = {n: [] for n in fields.names}
        for (a, b), changed in zip(pairs, edited):
            own, other, after = known[a[3]], known[changed], known[b[3]]
            row = (a[2], len(a[3]), hashlib.sha256(changed.encode("utf-8", "replace")).hexdigest(), own, other,
                   likeness(own, other), likeness(own, after), len(set(bands(own)) & set(bands(other))))
            for name, value in zip(out, row):
                out[name].append(value)
        return pa.RecordBatch.from_pydict(out, schema=fields)

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, int | None, str]] = []
        size = 0
        for batch in batches:
            for row in zip(*(batch[n].to_pylist() for n in ("block", "guest", "key", "text"))):
                held.append(row)
                size += len(row[3])
                if size >= GROUP_CHARS:
                    yield walk(held)
                    held, size = held[-1:], len(row[3])
        if len(held) > 1:
            yield walk(held)

    rows, _ = _blocks(docs.select(F.col("doc_id").cast("long").alias("key"), F.coalesce("text", F.lit("")).alias("text")))
    dealt = rows.repartition("block").sortWithinPartitions("block", "guest", F.col("key").desc_nulls_last(), "text")
    return dealt.select("block", "guest", "key", "text").mapInArrow(over, schema)


# ---- candidates by bands ----------------------------------------------------------------------------


@cache
def _extents() -> list[int]:
    out = [1]
    while out[-1] < 4 * STRETCH * SAMPLES:
        out.append(out[-1] + max(1, out[-1] // 4))
    return out


@cache
def _spots(extent: int) -> np.ndarray:
    """(band, spot): distinct spots of each band among the first ``extent`` symbols, in order."""
    width = min(BAND_SYMBOLS, max(1, extent // 3))
    order = _step_values(extent * BANDS * 1024, BANDS * extent, 3).reshape(BANDS, extent).argsort(axis=1)
    return np.sort(order[:, :width], axis=1)


def bands(fingerprint: str) -> list[str]:
    """Keys of bands of sampled symbols at the text's level and the one above, so that neighbours in length meet.

    Spots lie anywhere in an extent; the last two extents that fit reach over four fifths of a text, and texts of which
    one is a fifth shorter share an extent.
    """
    own, keys = int(fingerprint[:2], 16), []
    for level in (own, own + 1):
        values = _symbols(fingerprint, level)
        for extent in [e for e in _extents() if e <= len(values)][-2:]:
            found = values[_spots(extent)].tobytes().decode()
            width = len(found) // BANDS
            keys += [f"{level}:{extent}:{band}:{found[band * width:(band + 1) * width]}" for band in range(BANDS)]
    return keys


def near_pairs(found: DataFrame, least: float = 0.8) -> DataFrame:
    """(a, b, likeness): links of like documents that share a band; their components are those of all such pairs.

    ``found`` has (doc_id, fingerprint). Equal fingerprints are one class, linked by its smallest id. The members of a band
    are compared with one of them first, those still in different components with each other, in blocks. Rows without id
    have no links.
    """
    known = found.where(F.col("doc_id").isNotNull()).select("doc_id", "fingerprint", F.xxhash64("fingerprint").alias("key"))
    classes = durable(known.groupBy("key").agg(F.min("doc_id").alias("rep"), F.first("fingerprint").alias("fingerprint")))
    copies = known.join(classes.select("key", "rep"), "key").where(F.col("doc_id") != F.col("rep")).select(
        F.col("rep").alias("a"), F.col("doc_id").alias("b"), F.lit(1.0).alias("likeness")).distinct()

    def keys(batch):
        rows = [(d, k) for d, f in zip(batch["key"].to_pylist(), batch["fingerprint"].to_pylist()) for k in bands(f)]
        return {"key": [r[0] for r in rows], "band": [r[1] for r in rows]}

    banded = map_batches(classes.select("key", "fingerprint"), keys, "key long, band string", CHUNK).select("key", F.xxhash64("band").alias("band"))
    banded = durable(banded)
    sets = banded.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("key")).alias("members"), F.min("key").alias("centre"))
    sets = sets.where("n > 1").groupBy("n", "members").agg(F.min(F.struct("band", "centre")).alias("one")).select("one.band", "one.centre")
    banded = durable(banded.join(sets, "band"))

    def verify(batch):
        return {"x": batch["x"], "y": batch["y"], "likeness": [likeness(a, b) for a, b in zip(batch["p"].to_pylist(), batch["q"].to_pylist())]}

    met = banded.where(F.col("key") != F.col("centre")).select(F.col("centre").alias("x"), F.col("key").alias("y")).distinct()
    prints = lambda k, p: classes.select(F.col("key").alias(k), F.col("fingerprint").alias(p))
    central = map_batches(met.join(prints("x", "p"), "x").join(prints("y", "q"), "y").select("x", "y", "p", "q"), verify, "x long, y long, likeness double")
    central = durable(central.where(F.col("likeness") >= least))
    placed = durable(banded.select("band", "key").join(components(central, "x", "y").withColumnRenamed("node", "key"), "key", "left").select(
        "band", "key", F.coalesce("component", "key").alias("component")))
    apart = placed.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.min("component").alias("low"), F.max("component").alias("high")).where("low < high")
    blocks = F.ceil(F.col("n") / BAND_BLOCK).cast("int")
    slot = F.pmod(F.xxhash64("key", F.lit(1)), blocks).cast("int")
    members = placed.join(apart.select("band", "n"), "band").join(classes.select("key", "fingerprint"), "key").select(
        "band", "key", "component", "fingerprint", slot.alias("slot"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))

    def across(table: pa.Table) -> pa.Table:
        """Pairs of two slots of a band, or within one, whose components differ."""
        rows = list(zip(*(table[c].to_pylist() for c in ("slot", "key", "component", "fingerprint"))))
        slots = {r[0] for r in rows}
        out = []
        for i, (s, x, c, p) in enumerate(rows):
            for t, y, d, q in rows[i + 1:]:
                if c != d and (s != t or len(slots) == 1):
                    alike = likeness(p, q)
                    if alike >= least:
                        out.append((min(x, y), max(x, y), alike))
        return pa.Table.from_pydict({n: [r[k] for r in out] for k, n in enumerate(fields.names)}, schema=fields)

    fields = arrow_schema("x long, y long, likeness double")
    pairs = members.groupBy("band", F.least("slot", "other").alias("low"), F.greatest("slot", "other").alias("high")).applyInArrow(
        across, "x long, y long, likeness double")
    links = central.unionByName(pairs).distinct()
    names = lambda k, r: classes.select(F.col("key").alias(k), F.col("rep").alias(r))
    named = links.join(names("x", "r"), "x").join(names("y", "s"), "y").where(F.col("r") != F.col("s"))
    return copies.unionByName(named.select(F.least("r", "s").alias("a"), F.greatest("r", "s").alias("b"), "likeness")).distinct()


def query(spark: SparkSession, folder: str) -> DataFrame:
    return with_next(documents(spark, folder))
