"""Sets of five-word shingles as 64-bit hashes, computed with numpy."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np

from tallyline.llm.common import SHINGLE_WORDS

#: Bytes hashed at a time; numpy needs about 40 times as much memory.
SEGMENT_BYTES = 1 << 20
#: Words above this many bytes are hashed one by one.
LONG_WORD = 1 << 12

_rng = np.random.default_rng(20240521)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
_BYTE[0x41:0x5B] = _BYTE[0x61:0x7B]  # A-Z count as a-z
_PLACE = _rng.integers(1, 1 << 63, SHINGLE_WORDS + 1, dtype=np.uint64) | np.uint64(1)
_POWERS = np.cumprod(np.full(LONG_WORD, _rng.integers(1, 1 << 63, dtype=np.uint64) | np.uint64(1)), dtype=np.uint64)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_SPACE_RE = re.compile(rb"[\x20\x09-\x0D]")


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _words(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of each word."""
    raw = np.frombuffer(data, np.uint8)
    inside = ~_SPACE[raw]
    edges = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    starts, lengths = edges[::2], edges[1::2] - edges[::2]
    if not len(starts):
        return starts, np.zeros(0, np.uint64)
    letters = raw[inside]
    first = np.cumsum(lengths) - lengths
    at = np.arange(len(letters)) - np.repeat(first, lengths)
    hashes = np.add.reduceat(_BYTE[letters] * _POWERS[at % LONG_WORD], first)
    for i in np.flatnonzero(lengths > LONG_WORD):  # powers repeat: order the parts
        parts = [data[k : k + LONG_WORD] for k in range(starts[i], starts[i] + lengths[i], LONG_WORD)]
        total = np.uint64(0)
        for part in parts:
            codes = _BYTE[np.frombuffer(part, np.uint8)]
            total = _mixed(np.array([total + (codes * _POWERS[: len(codes)]).sum(dtype=np.uint64)]))[0]
        hashes[i] = total
    return starts, _mixed(hashes)


def _segments(data: bytes) -> Iterator[bytes]:
    """``data`` in parts, cut at white space."""
    at = 0
    while at < len(data):
        cut = _SPACE_RE.search(data, at + SEGMENT_BYTES)
        end = cut.start() if cut else len(data)
        yield data[at:end]
        at = end


def _shingles(words: np.ndarray) -> np.ndarray:
    """Distinct shingle hashes of a sequence of words, sorted, as int64."""
    size = min(SHINGLE_WORDS, len(words))
    if not size:
        return np.zeros(0, np.int64)
    total = np.full(len(words) - size + 1, np.uint64(size) * _PLACE[SHINGLE_WORDS], np.uint64)
    for k in range(size):
        total += words[k : len(words) - size + 1 + k] * _PLACE[k]
    return np.unique(_mixed(total).view(np.int64))


def shingle_sets(texts: list[str]) -> Iterator[np.ndarray]:
    """The shingle set of each text; texts are hashed together up to a segment's size."""
    with np.errstate(over="ignore"):
        waiting, size = [], 0
        for text in texts:
            data = text.encode("utf-8")
            if len(data) > SEGMENT_BYTES:
                yield from _together(waiting)
                waiting, size = [], 0
                yield _shingles(np.concatenate([_words(s)[1] for s in _segments(data)]))
                continue
            if size + len(data) > SEGMENT_BYTES:
                yield from _together(waiting)
                waiting, size = [], 0
            waiting.append(data)
            size += len(data)
        yield from _together(waiting)


def _together(parts: list[bytes]) -> Iterator[np.ndarray]:
    starts, hashes = _words(b" ".join(parts))
    ends = np.cumsum([len(p) + 1 for p in parts])
    at = 0
    for end in np.searchsorted(starts, ends):
        yield _shingles(hashes[at:end])
        at = end
