"""Token counts of whole texts by byte-level pair merging, all pre-tokens of a batch at once.

Pre-tokens are held as ragged arrays: the symbols of all of them one after the other, and where each begins. In every
round each sequence applies its own pair of lowest rank wherever it stands, from left to right, all sequences at the
same time; then the ranks next to a new symbol are looked up again, and sequences without a pair are done. What
remains are the tokens. Bytes that no token of the vocabulary holds side by side can never be merged, so a
pre-token is cut between them first, which makes long ones many short ones.

Texts are split into a space and what follows it up to the next white space, and into white space of its own; the
tokenizer's pattern never looks beyond these chunks. A chunk is counted once per worker (see ``PieceMemo``).

Special strings inside texts are one token each, as by the library's default, and what lies between two of them is split by
itself. Defined cases: a null or empty text has no byte and no token. Rows stand alone: repeated and null ids and
repeated rows are counted row by row. An empty table gives an empty result. Columns besides the id and the text are
not read. A text is counted whole, in memory that follows its length.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from pulsegrid.llm.common import documents
from pulsegrid.llm.text_buffers import PieceMemo, buffers
from pulsegrid.llm.tokens import tokenizer_path

LIMIT = 512
GROUP_BYTES = 4 << 20

#: Fixed value: the pattern of byte-level pair merging for ASCII; chunks hold no white space but a leading space, or nothing else.
_PRE_TOKENS = re.compile(rb"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+")
#: White space beyond ASCII in UTF-8, by lead byte, second byte and third byte where there is one.
_WHITE_ASCII = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_WHITE_TWO = (0xC2, (0x85, 0xA0))
_WHITE_THREE = ((0xE1, 0x9A, (0x80,)), (0xE2, 0x80, (*range(0x80, 0x8B), 0xA8, 0xA9, 0xAF)), (0xE2, 0x81, (0x9F,)), (0xE3, 0x80, (0x80,)))

_NONE = np.int32(2**31 - 1)


def byte_letters() -> list[str]:
    """The letter that stands for each byte in the vocabulary: itself where it can be seen, else the next of U+0100 on."""
    seen = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = iter(range(0x100, 0x200))
    return [chr(b) if b in set(seen) else chr(next(hidden)) for b in range(256)]


class PairMerges:
    """Vocabulary and merges as arrays."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            model = json.load(file)
        vocab, merges = model["model"]["vocab"], model["model"]["merges"]
        self.special = [t["content"].encode() for t in model["added_tokens"]]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in merges]
        letters = byte_letters()
        self.byte_symbol = np.array([vocab[c] for c in letters], dtype=np.int64)
        key = np.array([vocab[a] << 20 | vocab[b] for a, b in pairs], dtype=np.int64)
        order = np.argsort(key, kind="stable")
        self.key, self.rank = key[order], order.astype(np.int32)
        self.product = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        number = {c: i for i, c in enumerate(letters)}
        self.together = np.zeros((256, 256), dtype=bool)
        for a, b in pairs:
            self.together[number[a[-1]], number[b[0]]] = True

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        wanted = left << 20 | right
        at = np.searchsorted(self.key, wanted)
        at[at == len(self.key)] = 0
        return np.where(self.key[at] == wanted, self.rank[at], _NONE)

    def count(self, tokens: list[bytes]) -> np.ndarray:
        """Symbols left of each pre-token once no pair of it can be merged."""
        lengths = np.array([len(t) for t in tokens], dtype=np.int64)
        if not lengths.sum():
            return np.zeros(len(tokens), dtype=np.int64)
        data = np.frombuffer(b"".join(tokens), dtype=np.uint8)
        owner = np.repeat(np.arange(len(tokens)), lengths)
        first = np.concatenate([[True], (owner[1:] != owner[:-1]) | ~self.together[data[:-1], data[1:]]])
        symbol = self.byte_symbol[data]
        counts = np.zeros(len(tokens), dtype=np.int64)
        # rank[i] is that of the pair (i, i + 1) within a sequence.
        rank = np.full(len(symbol), _NONE, dtype=np.int32)
        inner = np.flatnonzero(~first) - 1
        rank[inner] = self.ranks(symbol[inner], symbol[inner + 1])
        while len(symbol):
            starts = np.flatnonzero(first)
            lowest = np.minimum.reduceat(rank, starts)
            size = np.diff(np.append(starts, len(symbol)))
            open_ = lowest < _NONE
            if not open_.all():  # finished sequences leave
                stay = np.repeat(open_, size)
                counts += np.bincount(owner[~stay], minlength=len(tokens))
                symbol, owner, first, rank = symbol[stay], owner[stay], first[stay], rank[stay]
                lowest, size = lowest[open_], size[open_]
                if not len(symbol):
                    break
            hit = np.flatnonzero(rank == np.repeat(lowest, size))
            # In a row of overlapping pairs every second one is applied, from the left.
            fresh = np.concatenate([[True], np.diff(hit) != 1])
            row_start = np.maximum.accumulate(np.where(fresh, np.arange(len(hit)), 0))
            hit = hit[(np.arange(len(hit)) - row_start) % 2 == 0]
            symbol[hit] = self.product[rank[hit]]
            stay = np.ones(len(symbol), dtype=bool)
            stay[hit + 1] = False
            at = hit - np.arange(len(hit))  # where the new symbols are after the others left
            symbol, owner, first, rank = symbol[stay], owner[stay], first[stay], rank[stay]
            beside = np.zeros(len(symbol), dtype=bool)
            beside[at] = True
            beside[at[~first[at]] - 1] = True
            changed = np.flatnonzero(beside)
            rank[changed] = _NONE
            inner = changed[:-1] if changed[-1] == len(symbol) - 1 else changed
            inner = inner[~first[inner + 1]]
            rank[inner] = self.ranks(symbol[inner], symbol[inner + 1])
        return counts


def chunk_edges(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends), in order, of the chunks of texts at ``bounds``: a space with the word after it, a word, or white
    space of its own (all of a run but its last character, and that one unless it is a space before a word)."""
    white = _WHITE_ASCII[data]
    back = np.ones(len(data), dtype=np.int64)  # bytes of the character that ends here, right for white space
    lead = np.flatnonzero(np.isin(data[:-1], (0xC2, 0xE1, 0xE2, 0xE3))) if len(data) else np.zeros(0, dtype=np.int64)
    two = lead[(data[lead] == _WHITE_TWO[0]) & np.isin(data[lead + 1], _WHITE_TWO[1])]
    white[two] = white[two + 1] = True
    back[two + 1] = 2
    lead = lead[lead + 2 < len(data)]
    for a, b, last in _WHITE_THREE:
        three = lead[(data[lead] == a) & (data[lead + 1] == b) & np.isin(data[lead + 2], last)]
        white[three] = white[three + 1] = white[three + 2] = True
        back[three + 2] = 3
    cut = np.unique(bounds)
    cut = cut[(cut > 0) & (cut < len(data))]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[0] = edge[-1] = True
    edge[1:-1] = white[1:] != white[:-1]
    edge[cut] = True
    text_end = np.zeros(len(data) + 1, dtype=bool)
    text_end[cut] = text_end[-1] = True
    at = np.flatnonzero(edge)
    if len(data) == 0:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    runs = at[:-1]
    ends = at[1:]
    # White runs before a word give their last character away: to the word if it is a space, else to itself.
    gives = white[runs] & ~text_end[ends]
    last = ends[gives] - back[ends[gives] - 1]
    edge[last] = True
    joins = data[last] == 32
    edge[ends[gives][joins]] = False
    at = np.flatnonzero(edge)
    return at[:-1], at[1:]


class TokenCounter:
    """Counts tokens of groups of texts; keeps what the chunks seen so far gave."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.merges = PairMerges(path)
        self.splitter = Tokenizer.from_file(path).pre_tokenizer
        self.memo = PieceMemo(self._count_chunks)
        self.special = re.compile(b"|".join(re.escape(s) for s in self.merges.special)) if self.merges.special else None

    def _count_chunks(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        split = [_PRE_TOKENS.findall(c) if c.isascii() else self._library_pre_tokens(c) for c in chunks]
        tokens = list(chain.from_iterable(split))
        number: dict[bytes, int] = {}
        at = np.fromiter((number.setdefault(t, len(number)) for t in tokens), dtype=np.int64, count=len(tokens))
        counted = self.merges.count(list(number))
        owner = np.repeat(np.arange(len(chunks)), np.fromiter(map(len, split), dtype=np.int64, count=len(split)))
        totals = np.bincount(owner, weights=counted[at], minlength=len(chunks))
        return totals.astype(np.uint32), np.ones(len(chunks), dtype=np.int64)

    def _library_pre_tokens(self, chunk: bytes) -> list[bytes]:
        """Which letters beyond ASCII are letters depends on the library's edition of Unicode: its own splitter says."""
        text = chunk.decode("utf-8", "replace")
        return [text[a:b].encode() for _, (a, b) in self.splitter.pre_tokenize_str(text)]

    def count(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Tokens of the texts data[bounds[i]:bounds[i + 1]]."""
        cuts, special = self._special_strings(data, bounds)
        starts, ends = chunk_edges(data, np.concatenate([bounds, *cuts]) if len(special) else bounds)
        if len(special):  # a special string is one chunk, and one token
            ordinary = ~np.isin(starts, special)
            inside = np.searchsorted(cuts[0], starts, side="right") - 1
            ordinary &= ~((inside >= 0) & (starts < cuts[1][np.maximum(inside, 0)]))
            starts, ends = starts[ordinary], ends[ordinary]
        values, first, _ = self.memo.look_up(data, starts, ends)
        summed = np.concatenate([[0], np.cumsum(values[first].astype(np.int64))])
        tokens = np.diff(summed[np.searchsorted(starts, bounds)])
        return tokens + np.diff(np.searchsorted(special, bounds))

    def _special_strings(self, data: np.ndarray, bounds: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray], np.ndarray]:
        """Starts and ends of special strings within texts."""
        none = np.zeros(0, dtype=np.int64)
        if self.special is None:
            return (none, none), none
        raw = data.tobytes()
        if not self.special.search(raw):
            return (none, none), none
        spans = [m.span() for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist()) for m in self.special.finditer(raw, lo, hi)]
        starts, ends = np.array([s for s, _ in spans], dtype=np.int64), np.array([e for _, e in spans], dtype=np.int64)
        return (starts, ends), starts


@cache
def counter(path: str) -> TokenCounter:
    """One counter and memo for each worker process."""
    return TokenCounter(path)


def token_counts(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens) of every row of ``docs``."""
    path = path or tokenizer_path("byte_bpe_50k.json")
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())])

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path).count
        for batch in batches:
            for lo, hi, data, bounds in buffers(batch["text"], GROUP_BYTES):
                yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(lo, hi - lo), pa.array(np.diff(bounds)), pa.array(count(data, bounds))], schema=schema)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(over, "doc_id long, n_bytes long, n_tokens long")


def query(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts(documents(spark, folder)).withColumn("over_limit", F.col("n_tokens") > LIMIT)
