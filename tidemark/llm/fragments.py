"""Tokenizing by fragments: texts are cut where no token can cross, and equal fragments are encoded once."""

from __future__ import annotations

import re
from collections.abc import Callable

#: Fragments remembered by a worker, and the longest (characters) that is remembered.
REMEMBERED, LONGEST = 400_000, 48
#: Texts on which each worker compares both encoders of ByteEncoder before it uses the faster one.
PROBES = ["Hello, world! It's 2024-01-02.", "  two  spaces \n\n\ttab ", "naïve Straße Ñandú éà 中文 テスト 🙂 a\u0301", "x" * 300, "don't DON'T we'll 12345678 3.14", "a\u200bb \u00a0 c\r\nd", "#$%&***<|>|", "a\n b \n  c\t d", "runs of spaces at the end   ", " \n ", "next\u0085line \u2028 and\u2028 so", "x\u3000 y \u3000z", "\t \t"]


class Memo:
    """What ``encode`` gives for each fragment, in bounded space."""

    def __init__(self, encode: Callable[[list[str]], list]):
        self.encode, self.known = encode, {}

    def of(self, fragments: list[str]) -> Callable[[str], object]:
        """A lookup that knows every one of ``fragments`` until the next call."""
        known = self.known
        new = set(fragments).difference(known)
        if len(known) + len(new) > REMEMBERED:
            known.clear()
            new = set(fragments)
        new = list(new)
        known.update(zip(new, self.encode(new), strict=True))
        look = dict.__getitem__
        if long := [x for x in new if len(x) > LONGEST]:
            extra = {x: known.pop(x) for x in long}
            return lambda x: extra[x] if x in extra else look(known, x)
        return known.__getitem__


class PieceCounter:
    """Token counts of a sentencepiece BPE model.

    The model writes a space as U+2581 and puts one before the text. If no piece holds U+2581 after another character,
    no merge crosses a space that follows another character; the part behind it then gets the same leading U+2581 from
    the library as it had in the text. A model for which this doesn't hold gets whole texts.
    """

    _space = re.compile(r"(?<=[^ ▁]) (?!\Z)")

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        m = self.model
        pieces = [m.id_to_piece(i) for i in range(m.get_piece_size()) if not m.is_control(i)]
        plain = m.encode("a", out_type=str)[0].startswith("▁") and m.decode(m.encode(" a  b \n c ")) == " a  b \n c "
        self.safe = plain and not any(re.search("[^▁]▁", p) for p in pieces)
        self.memo = Memo(lambda xs: [len(x) for x in m.encode(xs, num_threads=1)] if xs else [])

    def split(self, text: str) -> list[str]:
        if not self.safe:
            return [text]
        if "  " in text or "▁" in text or text[:1] == " " or text[-1:] == " ":
            return self._space.split(text)
        return text.split(" ")

    def counts(self, texts: list[str]) -> list[int]:
        parts = [self.split(t) if t else [] for t in texts]
        look = self.memo.of([x for p in parts for x in p])
        return [sum(map(look, p)) for p in parts]


class ByteEncoder:
    """Ids of a byte-level BPE vocabulary as little-endian unsigned 32-bit bytes.

    The pre-tokenizer never joins what stands before a space with the space and the word behind it, unless white space
    stands before that space and white space or the end behind it. The file for tokenizers defines the ids; the ranks of the same vocabulary give
    them faster for ordinary text, and texts that hold a special token's string go to tokenizers whole.
    """

    _doubt = re.compile(r"\s (?:\s|\Z)")

    def __init__(self, path: str, ranks_path: str, pattern: str):
        import base64
        import struct

        import tiktoken
        from tokenizers import Tokenizer

        self.path = path
        self.whole = Tokenizer.from_file(path)
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        encode = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        pack = struct.pack
        self.memo = Memo(lambda xs: [pack(f"<{len(i)}I", *i) for i in map(encode, xs)])
        self.pack = pack
        for text in PROBES:
            if self.encode([text]) != [pack(f"<{len(ids)}I", *ids) for ids in [self.whole.encode(text, add_special_tokens=False).ids]]:
                raise ValueError(f"{ranks_path} doesn't give the ids of {path}, for example for {text!r}")
        self.whole = None  # few texts need it again

    def split(self, text: str) -> list[str]:
        if self._doubt.search(text):
            cut = re.split(r" (?=\w)", text)
        else:
            cut = text.split(" ")
        return [cut[0], *[" " + x for x in cut[1:]]]

    def encode(self, texts: list[str]) -> list[bytes]:
        plain = [not any(s in t for s in self.special) for t in texts]
        parts = [self.split(t) if t and p else [] for t, p in zip(texts, plain, strict=True)]
        look = self.memo.of([x for p in parts for x in p])
        out = []
        for t, p, ok in zip(texts, parts, plain, strict=True):
            if ok:
                out.append(b"".join(map(look, p)))
            else:
                if self.whole is None:
                    from tokenizers import Tokenizer

                    self.whole = Tokenizer.from_file(self.path)
                ids = self.whole.encode(t, add_special_tokens=False).ids
                out.append(self.pack(f"<{len(ids)}I", *ids))
        return out


_loaded: dict[tuple, object] = {}


def loaded(kind: type, *args: str):
    """One encoder for each worker process."""
    if (key := (kind.__name__, *args)) not in _loaded:
        _loaded[key] = kind(*args)
    return _loaded[key]
