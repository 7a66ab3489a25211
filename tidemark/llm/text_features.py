"""Statistics of whole texts, taken from their bytes for many texts at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes that are looked at together. A longer text is read in pieces of this size; a word or line across an edge counts in both.
PIECE = 1 << 22
SPACE, LOWER, UPPER, DIGIT, SYMBOL, STRESS, STOP, OTHER, WIDE, TAIL = range(10)

#: What each byte of UTF-8 is.
CLASS = np.full(256, OTHER, np.uint8)
for _chars, _kind in (
    (b" \t\n\x0b\x0c\r", SPACE), (bytes(range(97, 123)), LOWER), (bytes(range(65, 91)), UPPER), (b"0123456789", DIGIT),
    (b"#*$%&|<>", SYMBOL), (b"!?", STRESS), (b".,;:", STOP), (bytes(range(0xC0, 0x100)), WIDE), (bytes(range(0x80, 0xC0)), TAIL),
):
    CLASS[list(_chars)] = _kind

FEATURES = (
    "log_words", "word_length", "length_spread", "upper", "digits", "symbols", "stress", "stops", "other_marks", "wide", "doubled_marks",
    "marked_words", "loud_words", "lone_marks", "words_a_line", "distinct_lines", "same_as_before", "distinct_words", "distinct_pairs",
)
#: Sums that the statistics are made of; all add up over pieces.
_SUMS = ("bytes", "chars", "lower", "upper", "digit", "symbol", "stress", "stop", "other", "wide", "doubled", "words", "word_chars", "word_squares", "marked", "loud", "lone", "lines", "same")

_ODD = np.uint64(0x9E3779B97F4A7C15)
#: _ODD times this is 1 modulo 2^64.
_BACK = np.uint64(pow(int(_ODD), -1, 1 << 64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def _hashes(b: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit polynomial hash of each stretch of ``b``, from sums of all bytes before its ends."""
    upto = np.zeros(len(b) + 1, np.uint64)
    np.cumsum((b.astype(np.uint64) + np.uint64(1)) * _powers(_ODD, len(b)), out=upto[1:])
    return _mixed((upto[ends] - upto[starts]) * _powers(_BACK, len(b) + 1)[starts])


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def _distinct(doc: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The distinct (document, hash) pairs as one sorted number each: 20 bits of the first, 44 of the second."""
    return np.unique((doc.astype(np.uint64) << np.uint64(44)) | (h >> np.uint64(20)))


def _sums(b: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The sums of each text, ``b[edges[i]:edges[i + 1]]``, and the distinct lines, words and pairs of words of all."""
    n = len(edges) - 1
    doc = np.repeat(np.arange(n), np.diff(edges))
    kind = CLASS[b]
    first = np.zeros(len(b) + 1, bool)  # the first byte of a text
    first[edges[:-1]] = True
    count = np.bincount(doc * 10 + kind, minlength=10 * n).reshape(n, 10)
    mark = (kind >= SYMBOL) & (kind <= OTHER)
    doubled = np.zeros(len(b), bool)
    doubled[1:] = mark[1:] & (b[1:] == b[:-1]) & ~first[1:-1]
    # a space between texts ends each word; words are runs of other bytes
    word = kind != SPACE
    begins = word.copy()
    begins[1:] &= ~word[:-1] | first[1:-1]
    starts = np.flatnonzero(begins)
    stops = word.copy()
    stops[:-1] &= ~word[1:] | first[1:-1]
    ends = np.flatnonzero(stops) + 1
    of = doc[starts]
    chars = np.concatenate([[0], np.cumsum(kind != TAIL)])
    letters = np.concatenate([[0], np.cumsum(kind == UPPER)])
    marks = np.concatenate([[0], np.cumsum(mark)])
    size = chars[ends] - chars[starts]
    h = _hashes(b, starts, ends)
    same = np.zeros(len(starts), bool)
    same[1:] = (h[1:] == h[:-1]) & (of[1:] == of[:-1])
    pair = np.flatnonzero(of[1:] == of[:-1])
    each = lambda x: np.bincount(of, weights=x, minlength=n)
    newline = b == 10
    line_starts = np.flatnonzero(first[:-1] | np.concatenate([[False], newline[:-1]])[: len(b)]) if len(b) else np.zeros(0, np.int64)
    line_ends = np.concatenate([line_starts[1:], [len(b)]]) if len(b) else line_starts
    line_ends = line_ends - newline[line_ends - 1]
    line_of = doc[line_starts]
    lines = np.bincount(line_of, minlength=n)
    all_sums = [
        np.diff(edges), count.sum(axis=1) - count[:, TAIL], count[:, LOWER], count[:, UPPER], count[:, DIGIT], count[:, SYMBOL], count[:, STRESS], count[:, STOP],
        count[:, OTHER], count[:, WIDE], np.bincount(doc[doubled], minlength=n), np.bincount(of, minlength=n), each(size), each(size.astype(np.float64) ** 2),
        each(mark[ends - 1] & (kind[ends - 1] != STOP)), each(letters[ends] - letters[starts] >= 2), each(marks[ends] - marks[starts] == ends - starts), lines, each(same),
    ]
    pairs = _mixed(h[pair] * np.uint64(3) + h[pair + 1]) if len(pair) else np.zeros(0, np.uint64)
    return np.stack([np.asarray(s, np.float64) for s in all_sums], axis=1), [_distinct(line_of, _hashes(b, line_starts, line_ends)), _distinct(of, h), _distinct(of[pair], pairs)]


def _statistics(sums: np.ndarray, distinct: np.ndarray) -> np.ndarray:
    s = dict(zip(_SUMS, sums.T, strict=True))
    words, chars, lines = np.maximum(s["words"], 1), np.maximum(s["word_chars"], 1), np.maximum(s["lines"], 1)
    length = s["word_chars"] / words
    letters = np.maximum(s["lower"] + s["upper"] + s["wide"], 1)
    return np.stack([
        np.log1p(s["words"]), length, np.sqrt(np.maximum(s["word_squares"] / words - length**2, 0)), s["upper"] / letters, s["digit"] / chars, s["symbol"] / chars,
        s["stress"] / chars, s["stop"] / chars, s["other"] / chars, s["wide"] / chars, s["doubled"] / chars, s["marked"] / words, s["loud"] / words, s["lone"] / words,
        np.log1p(s["words"] / lines), distinct[:, 0] / lines, s["same"] / words, distinct[:, 1] / words, distinct[:, 2] / words,
    ], axis=1)


def _pieces(texts: list[bytes]) -> Iterator[tuple[list[int], list[bytes]]]:
    """(places, bytes) of texts that are looked at together: whole ones up to PIECE bytes in all, or the one piece of a longer one."""
    places: list[int] = []
    held: list[bytes] = []
    total = 0
    for i, t in enumerate(texts):
        for p in range(0, max(len(t), 1), PIECE):
            part = t[p : p + PIECE]
            if held and total + len(part) > PIECE:
                yield places, held
                places, held, total = [], [], 0
            places.append(i)
            held.append(part)
            total += len(part)
    if held:
        yield places, held


def text_features(texts: pa.Array) -> np.ndarray:
    """A row of FEATURES for each text of a column of strings. Null counts as empty, whose statistics are all 0.

    They depend on the text alone, not on its neighbours. A text beyond PIECE bytes takes no more memory than one piece and
    the hashes of its distinct lines, words and pairs."""
    raw = [x.as_buffer().to_pybytes() if x.is_valid else b"" for x in texts.cast(pa.large_binary())]
    sums, distinct = np.zeros((len(raw), len(_SUMS))), np.zeros((len(raw), 3))
    seen: dict[int, list[np.ndarray]] = {}
    for places, parts in _pieces(raw):
        b = np.frombuffer(b"".join(parts), np.uint8)
        own, sets = _sums(b, np.concatenate([[0], np.cumsum([len(p) for p in parts])]))
        np.add.at(sums, places, own)
        for c, keys in enumerate(sets):
            counts = np.bincount((keys >> np.uint64(44)).astype(np.int64), minlength=len(parts))
            distinct[places, c] = counts
        if len(raw[places[0]]) > PIECE or len(raw[places[-1]]) > PIECE:
            for k in {0, len(parts) - 1}:
                if len(raw[places[k]]) > PIECE:
                    mine = [s[(s >> np.uint64(44)) == k] & np.uint64((1 << 44) - 1) for s in sets]
                    before = seen.get(places[k])
                    seen[places[k]] = mine if before is None else [np.union1d(x, y) for x, y in zip(before, mine, strict=True)]
                    distinct[places[k]] = [len(s) for s in seen[places[k]]]
    return _statistics(sums, distinct)
