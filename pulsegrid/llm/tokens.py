"""Token ids of whole texts by a public tokenizer, with a bounded memo of the pieces of texts.

The tokenizer's pattern drops white space, takes letters in runs, digits one by one and everything else in runs, so a text
can be cut at white space and, within a word, between such kinds, and its ids are those of the pieces in order. Kinds
are told by bytes: ASCII and the Latin letters of U+00C0 to U+00FF. Words are kept whole next to any other character, after an apostrophe
(it may begin a contraction), around a capital sigma (its lower case depends on what follows) and around special strings.
"""

from __future__ import annotations

import os
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa

from pulsegrid.llm.hashing import run_edges
from pulsegrid.llm.text_buffers import PieceMemo, buffers, ragged

_WHITE, _LETTER, _DIGIT, _SIGN, _OTHER = range(5)
_KIND = np.array([_WHITE if c in b"\t\n\x0b\x0c\r " else _DIGIT if 48 <= c <= 57 else _LETTER if chr(c).isalpha() and c < 128
                  else _SIGN if c < 128 else _OTHER for c in range(256)], dtype=np.uint8)
_LOWER = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], dtype=np.uint8)
#: UTF-8 lead of U+00C0 to U+00FF, and the second bytes of its two signs, times and division.
_LATIN, _LATIN_SIGNS = 0xC3, (0x97, 0xB7)


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pieces(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, starts, ends): what of the texts at ``bounds`` can be encoded piece by piece, A-Z lower-cased."""
    kind = _KIND[data]
    latin = np.flatnonzero(data[:-1] == _LATIN)
    latin = latin[~np.isin(data[latin + 1], _LATIN_SIGNS)]
    kind[latin] = kind[latin + 1] = _LETTER
    edge = np.zeros(len(data) + 1, dtype=bool)
    known = (kind > _WHITE) & (kind < _OTHER)
    edge[1:-1] = known[1:] & known[:-1] & ((kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)) & ((data[:-1] != 39) | (kind[1:] != _LETTER))
    lower = _LOWER[data]
    inside = kind != _WHITE
    starts, ends = run_edges(inside)
    cut = np.unique(bounds)
    cut = cut[(cut > 0) & (cut < len(data))]
    cut = cut[inside[cut] & inside[cut - 1]]
    starts, ends = np.sort(np.concatenate([starts, cut])), np.sort(np.concatenate([ends, cut]))
    odd = np.flatnonzero(((data[:-1] == 60) & (data[1:] == 124)) | ((data[:-1] == 0xCE) & (data[1:] == 0xA3)))
    for word in np.unique(np.searchsorted(starts, odd, side="right") - 1).tolist():
        a, b = starts[word], ends[word]
        edge[a + 1:b] = False
        lower[a:b] = data[a:b]
    inner = np.flatnonzero(edge)
    return lower, np.sort(np.concatenate([starts, inner])), np.sort(np.concatenate([ends, inner]))


class TextEncoder:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.memo = PieceMemo(self._encode)

    def _encode(self, found: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        ids = [e.ids for e in self.tokenizer.encode_batch_fast([p.decode("utf-8", "replace") for p in found], add_special_tokens=False)]
        counts = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
        return np.fromiter(chain.from_iterable(ids), dtype=np.uint32, count=int(counts.sum())), counts

    def group(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ends): the ids of all texts one after the other, and where those of each text end."""
        lower, starts, ends = pieces(data, bounds)
        values, first, count = self.memo.look_up(lower, starts, ends)
        ids = values[ragged(first, count)] if len(first) else np.zeros(0, dtype=np.uint32)
        upto = np.concatenate([[0], np.cumsum(count)])
        return ids, upto[np.searchsorted(starts, bounds[1:])]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        found = []
        for _, _, data, bounds in buffers(pa.array([t or "" for t in texts], pa.string()), 4 << 20):
            ids, ends = self.group(data, bounds)
            found.extend(ids[a:b].astype("<u4").tobytes() for a, b in zip([0, *ends[:-1].tolist()], ends.tolist()))
        return found


@cache
def encoder(path: str) -> TextEncoder:
    """One encoder and memo for each worker process."""
    return TextEncoder(path)
