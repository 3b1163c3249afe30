"""Vectorised word and n-gram hashes of many texts at once.

Words are maximal runs of alphanumeric characters of the lower-cased text. A word's hash is the
polynomial hash of its code points modulo 2^64 with an odd base: as the base has an inverse,
prefix sums give the hash of any slice, so no loop runs over words.
"""

from __future__ import annotations

from functools import cache

import numpy as np

BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
#: A text longer than this is hashed in slices cut at a space.
SLICE = 1 << 20


@cache
def alphanumeric() -> np.ndarray:
    """For each code point, whether it belongs to a word."""
    return np.fromiter((chr(i).isalnum() for i in range(0x110000)), bool, 0x110000)


_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base^0 ... base^(n-1) modulo 2^64."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        run = np.full(max(n, SLICE), base, np.uint64)
        run[0] = 1
        have = _POWERS[base] = np.multiply.accumulate(run)
    return have[:n]


def mix(h: np.ndarray, salt: int = 0) -> np.ndarray:
    """Finalizer that spreads every input bit over all output bits."""
    h = h ^ np.uint64(salt * 0xD1342543DE82EF95 & 0xFFFFFFFFFFFFFFFF)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def slice_hashes(codes: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of codes[start:end] for many slices."""
    sums = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * powers(BASE, len(codes)), out=sums[1:])
    back = powers(INVERSE, len(codes) + 1)
    return mix((sums[end] - sums[start]) * back[start] + (end - start).astype(np.uint64))


def _slices(text: str):
    at = 0
    while len(text) - at > SLICE:
        cut = text.find(" ", at + SLICE)
        if cut < 0:
            break
        yield text[at:cut]
        at = cut
    yield text[at:] if at else text


def _spans(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    inside = np.zeros(len(codes) + 2, np.int8)
    inside[1:-1] = alphanumeric()[codes]
    edge = np.diff(inside)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def word_hashes(texts: list[str | None], lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and offsets: text i has words offsets[i]:offsets[i + 1]."""
    parts, counts = [], np.zeros(len(texts) + 1, np.int64)
    pending: list[str] = []
    owner: list[int] = []
    size = 0

    def flush() -> None:
        nonlocal size
        if pending:
            ends = np.cumsum([len(p) + 1 for p in pending])
            codes = code_points("\n".join(pending) + "\n")
            start, end = _spans(codes)
            parts.append(slice_hashes(codes, start, end))
            np.add.at(counts, np.asarray(owner)[np.searchsorted(ends, start, "right")] + 1, 1)
        pending.clear()
        owner.clear()
        size = 0

    for i, text in enumerate(texts):
        if text:
            for piece in _slices(text.lower() if lower else text):
                if size + len(piece) > SLICE:
                    flush()
                pending.append(piece)
                owner.append(i)
                size += len(piece) + 1
    flush()
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint64)), np.cumsum(counts)


def ngrams_at(words: np.ndarray, offsets: np.ndarray, steps: tuple[int, ...]
              ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the words at i, i + steps[0], i + steps[1], ..., the text of each, and i.

    ``steps`` rise; (1, 2) gives three adjacent words, (2,) a pair with one word skipped.
    """
    span = steps[-1]
    lengths = np.diff(offsets)
    owner = np.repeat(np.arange(len(lengths)), lengths)
    if len(words) <= span:
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none, none
    fits = np.flatnonzero(owner[:-span] == owner[span:])
    h = words[fits] + np.uint64(span * 0x632BE59BD9B4E019 & 0xFFFFFFFFFFFFFFFF)
    for step in steps:
        h = mix(h * np.uint64(BASE) + words[fits + step])
    return h, owner[fits], fits


def ngrams(words: np.ndarray, offsets: np.ndarray, steps: tuple[int, ...]
           ) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and texts of ``ngrams_at``."""
    return ngrams_at(words, offsets, steps)[:2]
