"""Hashes of the words of texts, for whole batches at a time."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np

from tidemark.llm.common import by_bytes

#: Bytes of text that are hashed at a time; a longer text is taken apart between words.
CHUNK = 1 << 20

_BYTES = np.arange(256, dtype=np.uint8)
_LOWER = np.where((_BYTES >= 65) & (_BYTES <= 90), _BYTES + 32, _BYTES).astype(np.uint8)
_INSIDE = ~((_BYTES == 32) | ((_BYTES >= 9) & (_BYTES <= 13)))
_GAP = re.compile(rb"[\x20\x09-\x0D]")
_TIMES = np.random.default_rng(5).integers(1, 1 << 63, 4096, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mixed(h: np.ndarray) -> np.ndarray:
    """64-bit values spread over all their bits; different values stay different."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def _words(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of ``data`` begin, and their hashes: sums of their bytes, A-Z in lower case, times a number for each place."""
    buf = np.frombuffer(data, np.uint8)
    inside = _INSIDE[buf]
    edges = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    starts, lengths = edges[::2], edges[1::2] - edges[::2]
    if not len(starts):
        return starts, np.zeros(0, np.uint64)
    first = np.cumsum(lengths) - lengths
    place = np.arange(int(lengths.sum())) - np.repeat(first, lengths)
    times = _TIMES[place & 4095]
    if lengths.max() > 4096:
        times = times + (place >> 12).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return starts, mixed(np.add.reduceat((_LOWER[buf[inside]].astype(np.uint64) + np.uint64(1)) * times, first))


def _pieces(text: bytes) -> Iterator[bytes]:
    at = 0
    while at < len(text):
        gap = _GAP.search(text, at + CHUNK)
        end = gap.start() if gap else len(text)
        yield text[at:end]
        at = end


def word_hashes(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each word of all ``texts`` in order, and how many words each text has. Words stand between SPACES; null has none."""
    hashes, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for part in by_bytes((t or b"" for t in texts), len, CHUNK):
        if len(part) == 1 and len(part[0]) > CHUNK:
            found = [_words(p)[1] for p in _pieces(part[0])]
            hashes += found
            counts.append(np.array([sum(map(len, found))]))
            continue
        starts, h = _words(b" ".join(part))
        begins = np.cumsum([0, *(len(t) + 1 for t in part)])
        hashes.append(h)
        counts.append(np.diff(np.searchsorted(starts, begins)))
    return np.concatenate(hashes), np.concatenate(counts)


def shingle_sets(texts: list[bytes | None], k: int = 5) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its runs of ``k`` words; of the whole sequence if it is shorter."""
    times = _TIMES[:k]
    for part in by_bytes((t or b"" for t in texts), len, CHUNK):
        h, counts = word_hashes(part)
        runs = np.zeros(max(0, len(h) - k + 1), np.uint64)
        for j in range(k):
            runs += h[j : j + len(runs)] * times[j]
        runs = mixed(runs + _TIMES[k])
        at = 0
        for n in counts.tolist():
            if n >= k:
                s = np.sort(runs[at : at + n - k + 1])
                yield s[np.concatenate([[True], s[1:] != s[:-1]])]
            elif n:
                yield mixed(np.array([np.append(h[at : at + n] * times[:n], _TIMES[k + n]).sum()], np.uint64))
            else:
                yield np.zeros(0, np.uint64)
            at += n
