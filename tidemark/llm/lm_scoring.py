"""Documents scored by how much better a target language model predicts them than a background model."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch
from tidemark.llm.hashing import mixed, word_hashes

#: Bytes of text in a block of documents; bytes of text for each bucket of pairs, and of words.
BLOCK, PAIR_BYTES, WORD_BYTES = 4 << 20, 12 << 20, 96 << 20
#: Weights of the bigram, unigram and uniform parts, and what is added to a context's count before it has its full weight.
BIGRAM, UNIGRAM, UNIFORM, CONTEXT = 0.7, 0.25, 0.05, 5.0
#: Hashes of what stands before a text's first word and behind its last; kinds of entries.
START, END, WORDS, PAIRS = np.uint64(0x51A7), np.uint64(0xE4D), 0, 1


def _blocks(kind: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(block, keys, bytes, payload) for about each BLOCK bytes of texts: their lengths, -1 for null, and the texts, compressed."""
        number = TaskContext.get().partitionId() << 32
        keys, texts, held = [], [], 0

        def out() -> pa.RecordBatch:
            sizes = np.array([-1 if t is None else len(t) for t in texts], np.int64)
            raw = sizes.tobytes() + b"".join(t for t in texts if t)
            row = [number, pa.concat_arrays(keys).to_pylist(), len(raw), _squeeze(raw, 6)]
            keys.clear(), texts.clear()
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, (pa.int64(), pa.list_(kind), pa.int64(), pa.binary()), strict=True)], ["block", "keys", "bytes", "payload"])

        for b in batches:
            for i, t in enumerate(b.column(1).cast(pa.binary()).to_pylist()):
                if texts and held + len(t or b"") > BLOCK:
                    yield out()
                    number, held = number + 1, 0
                keys.append(b.column(0).slice(i, 1))
                texts.append(t)
                held += len(t or b"") + 16
        if texts:
            yield out()

    return run


class Events:
    """The events of a block: each word of a text after the word before it, and the end of each text that has words.

    ``doc``: whose event it is; ``words`` and ``pairs``: the sorted distinct hashes of words and of pairs with the word before;
    ``word``, ``before``, ``pair``: their places for each event. A text begins once and ends once, so what stands before
    its first word has the count of what stands behind its last.
    """

    def __init__(self, payload: bytes, n: int, bits: int):
        raw = _release(payload)
        sizes = np.frombuffer(raw, np.int64, n)
        ends = 8 * n + np.cumsum(np.maximum(sizes, 0))
        h, self.n_words = word_hashes([raw[e - max(s, 0) : e] for s, e in zip(sizes.tolist(), ends.tolist(), strict=True)])
        some = self.n_words > 0
        stops = np.cumsum(self.n_words)[some]
        own, prior = np.insert(h, stops, END), np.insert(h, stops - self.n_words[some], START)
        self.doc = np.repeat(np.arange(n), np.where(some, self.n_words + 1, 0))
        cut = np.uint64(64 - bits)
        self.words, self.word = np.unique(own >> cut, return_inverse=True)
        self.pairs, self.pair = np.unique(mixed(prior * np.uint64(0x9E3779B97F4A7C15) + own) >> cut, return_inverse=True)
        self.before = np.roll(self.word, 1)

    def own(self, entry: np.ndarray, of: int) -> np.ndarray:
        """How often each event's entry (one of ``of``) comes in its own document."""
        _, at, n = np.unique(self.doc * of + entry, return_inverse=True, return_counts=True)
        return n[at]


def _bucket(hashes: np.ndarray, buckets: int, bits: int) -> np.ndarray:
    """Rises with the hash."""
    return ((hashes >> np.uint64(bits - 24)) * np.uint64(buckets) >> np.uint64(24)).astype(np.int64)


def _squeeze(data: bytes, level: int = 1) -> bytes:
    """``data`` compressed, its size before it."""
    return np.int64(len(data)).tobytes() + pa.Codec("zstd", compression_level=level).compress(data, asbytes=True)


def _release(data: bytes) -> bytes:
    return pa.decompress(memoryview(data)[8:], int(np.frombuffer(data, np.int64, 1)[0]), codec="zstd", asbytes=True)


def _pack_counts(counts: np.ndarray) -> bytes:
    """How many there are, a byte for each count, and those that don't fit in one behind them."""
    large = counts >= 255
    return _squeeze(np.int64(len(counts)).tobytes() + np.where(large, 255, counts).astype(np.uint8).tobytes() + counts[large].astype(np.int64).tobytes())


def _unpack_counts(data: bytes) -> np.ndarray:
    data = _release(data)
    n = int(np.frombuffer(data, np.int64, 1)[0])
    counts = np.frombuffer(data, np.uint8, n, 8).astype(np.int64)
    counts[counts == 255] = np.frombuffer(data, np.int64, offset=8 + n)
    return counts


def _pack_hashes(hashes: np.ndarray) -> bytes:
    """Sorted hashes as their differences, first the lowest bytes of all; the highest ones are mostly zero."""
    return _squeeze(np.ascontiguousarray(np.diff(hashes, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T).tobytes())


def _unpack_hashes(data: bytes) -> np.ndarray:
    planes = np.frombuffer(_release(data), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def _flags(right: pa.Table, n: int) -> np.ndarray:
    target = np.zeros(n, bool)
    for places in right.column("places").to_pylist():
        target[places or []] = True
    return target


COUNTED = "kind int, bucket int, block long, keys binary, n binary, target_n binary"


def _count_block(buckets: tuple[int, int], bits: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        """The entries of a block and their counts, in all documents and in target documents, a row for each bucket."""
        out = []
        for block, keys, payload in zip(*(left.column(c).to_pylist() for c in ("block", "keys", "payload")), strict=True):
            e = Events(payload, len(keys), bits)
            target = _flags(right, len(keys))[e.doc]
            for kind, found, at in ((WORDS, e.words, e.word), (PAIRS, e.pairs, e.pair)):
                n, t = np.bincount(at, minlength=len(found)), np.bincount(at[target], minlength=len(found))
                edges = np.flatnonzero(np.diff(_bucket(found, buckets[kind], bits), prepend=-1)).tolist()
                for a, b in zip(edges, [*edges, len(found)][1:], strict=bool(edges)):
                    out.append((kind, int(_bucket(found[a : a + 1], buckets[kind], bits)[0]), block, _pack_hashes(found[a:b]), _pack_counts(n[a:b]), _pack_counts(t[a:b])))
        types = [pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
        return pa.table([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], [c.split()[0] for c in COUNTED.split(", ")])

    return run


SUMS = "block long, kind int, bucket int, entries long, total long, target_total long, n binary, target_n binary"


def _add_up(rows: pa.Table) -> pa.Table:
    """The counts of a bucket's entries over all blocks, returned to each block. Its first row tells how many are distinct, and their sums."""
    keys = list(map(_unpack_hashes, rows.column("keys").to_pylist()))
    found, at = np.unique(np.concatenate(keys), return_inverse=True)
    sums = [np.bincount(at, np.concatenate([_unpack_counts(x) for x in rows.column(c).to_pylist()]), len(found)).astype(np.int64) for c in ("n", "target_n")]
    ends = np.cumsum([0, *map(len, keys)])
    spread = [[_pack_counts(s[at[a:b]]) for a, b in zip(ends, ends[1:], strict=False)] for s in sums]
    once = [pa.array([int(x), *[0] * (len(keys) - 1)], pa.int64()) for x in (len(found), sums[0].sum(), sums[1].sum())]
    return pa.table([rows.column("block"), rows.column("kind"), rows.column("bucket"), *once, *(pa.array(s, pa.binary()) for s in spread)], [c.split()[0] for c in SUMS.split(", ")])


def _loss(pair: np.ndarray, before: np.ndarray, own: np.ndarray, total: np.ndarray, words: int, scale: float) -> np.ndarray:
    """Negative log probability of each event, from the counts of the pair, of the word before, of the word and of all events."""
    weight = BIGRAM * scale * before / (scale * before + CONTEXT)
    rest = (UNIGRAM * own / np.maximum(total, 1) + np.where(total > 0, UNIFORM, UNIGRAM + UNIFORM) / words) / (UNIGRAM + UNIFORM)
    return -np.log(weight * pair / np.maximum(before, 1) + (1 - weight) * rest)


def _score_block(key: str, kind: pa.DataType, words: int, total: int, target_total: int, bits: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        keys, losses, n_words = [], [[], []], []
        for own_keys, payload in zip(*(left.column(c).to_pylist() for c in ("keys", "payload")), strict=True):
            e, n = Events(payload, len(own_keys), bits), len(own_keys)
            target = _flags(right, n)
            rows = right.filter(pc.is_valid(right.column("kind"))).sort_by([("kind", "ascending"), ("bucket", "ascending")])
            at_kind = rows.column("kind").to_numpy()
            counts = {(k, c): np.concatenate([np.zeros(0, np.int64), *map(_unpack_counts, rows.filter(pa.array(at_kind == k)).column(c).to_pylist())]) for k in (WORDS, PAIRS) for c in ("n", "target_n")}
            own_word, own_pair = e.own(e.word, len(e.words)), e.own(e.pair, len(e.pairs))
            events = np.bincount(e.doc, minlength=n)[e.doc]
            for i, (c, all_events) in enumerate((("target_n", target_total), ("n", total))):
                less = target[e.doc].astype(np.int64) if i == 0 else 1
                pair, word = counts[PAIRS, c][e.pair] - less * own_pair, counts[WORDS, c][e.word] - less * own_word
                before = counts[WORDS, c][e.before] - less * np.roll(own_word, 1)
                scale = target_total / total if i == 1 and target_total else 1.0
                each = _loss(pair, before, word, all_events - less * events, words, scale)
                losses[i].append(np.bincount(e.doc, each, n) / np.maximum(e.n_words + 1, 1))
            keys += own_keys
            n_words.append(e.n_words)
        n = np.concatenate(n_words)
        t, b = (pa.array(np.concatenate(x), mask=n == 0) for x in losses)
        return pa.table([pa.array(keys, kind), pa.array(n), t, b, pc.subtract(t, b)], [key, "n_tokens", "target_loss", "background_loss", "score"])

    return run


def score_difference(docs: DataFrame, target_keys: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``n_tokens``, ``target_loss``, ``background_loss`` and ``score`` for each row of ``docs``.

    Losses are cross-entropies in nats for each event, a word or the text's end, under two bigram models interpolated with
    unigrams and a uniform part; ``score`` is target_loss minus background_loss, the mean of the per-event differences: the
    lower, the more a document is like the target. The target model counts the documents whose key is in the only column of
    ``target_keys``, the background model all documents. The models are matched: one vocabulary (all words of ``docs``), and
    the background's counts of contexts are scaled to the target's size, so both lean alike on their bigrams. A document's
    own counts are taken off before it is scored (repeated rows count for each other), so target documents are scored as
    others are. Words stand between SPACES, A-Z in lower case.

    1. Each task puts its documents into blocks of about BLOCK bytes, written once. Which of them are the target's is found
       by a join of keys alone.
    2. Each block sends its distinct words and pairs with their counts to buckets of hashes, whose number grows with the
       input; a bucket adds them up and returns the sums to the blocks. A hot word is one entry of each block. Words and
       pairs are told apart by hashes with 20 bits more than it takes to count the bytes of all texts (64 at most): of
       several million, one shares its counts with another.
    3. Each block meets its sums and scores its documents. No text but in compressed blocks is shuffled, nothing but
       totals goes through the driver, and all words and pairs count.

    Null and empty texts have no tokens, null losses and a null score. A very long text is a block of its own. Rows with
    null keys count in the background and are scored; null target keys match nothing, repeated ones count once. Without
    target rows the target model is uniform. An empty table gives an empty result. Only ``key`` and ``text`` are read.
    """
    scratch = Scratch(docs.sparkSession, "lm")
    kind = docs.schema[key].dataType.simpleString()
    arrow = docs.select(key).limit(0).toArrow().schema.field(0).type
    own = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    blocks = scratch.keep("blocks", own.mapInArrow(_blocks(arrow), f"block long, keys array<{kind}>, bytes long, payload binary"))
    size = blocks.agg(F.sum("bytes")).first()[0] or 0
    buckets, bits = (1 + size // WORD_BYTES, 1 + size // PAIR_BYTES), min(64, size.bit_length() + 20 if size >> 20 else 40)

    wanted = target_keys.select(F.col(target_keys.columns[0]).alias("key")).where("key IS NOT NULL").distinct()
    places = blocks.select("block", F.posexplode("keys").alias("place", "key")).join(wanted, "key", "left_semi")
    places = scratch.keep("places", places.groupBy("block").agg(F.collect_list("place").alias("places")))

    counted = blocks.groupBy("block").cogroup(places.groupBy("block")).applyInArrow(_count_block(buckets, bits), COUNTED)
    sums = scratch.keep("sums", counted.groupBy("kind", "bucket").applyInArrow(_add_up, SUMS))
    words, total, target_total = (x or 0 for x in sums.where(F.col("kind") == WORDS).agg(F.sum("entries"), F.sum("total"), F.sum("target_total")).first())

    back = sums.select("block", "kind", "bucket", "n", "target_n").unionByName(places, allowMissingColumns=True)
    scored = _score_block(key, arrow, words, total, target_total, bits)
    return blocks.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(scored, f"`{key}` {kind}, n_tokens long, target_loss double, background_loss double, score double")
