"""Secrets in source, configuration and prose: fixed patterns, and literals assigned to sensitive names."""

from __future__ import annotations

import math
import re
from collections import Counter
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate, chain

import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm.literals import Reader

#: The base patterns, the kinds in the order of equal starts, and the least lengths.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "literal")
LEAST = {"assign": 8, "access": 16, "hex": 32}
STEMS = ("passw", "secret", "token", "apikey", "api_key")

#: How much each part of a name tells of a secret; parts are split at case changes and separators.
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "passwort": 1.0, "pass": 1.0, "pwd": 1.0, "passphrase": 1.0, "secret": 1.0, "token": 0.9, "apikey": 1.0,
    "credential": 0.8, "credentials": 0.8, "auth": 0.6, "authorization": 0.8, "bearer": 0.7, "private": 0.5, "signing": 0.4, "access": 0.4,
    "key": 0.5, "salt": 0.4, "api": 0.3, "client": 0.1, "master": 0.2, "encryption": 0.4, "ssh": 0.4, "license": 0.3,
}
#: A text without one of these holds no name of SENSITIVE.
NEEDED = re.compile("|".join(sorted(SENSITIVE)))
#: Quotes, and which are escaped.
QUOTES = re.compile(r"\\([\"'])|[\"'`]")
#: Parts that name something else than the secret itself.
HARMLESS = {"length", "len", "count", "limit", "min", "max", "name", "id", "type", "url", "uri", "path", "file", "field", "hint", "policy", "public", "expiry", "ttl", "label", "header"}
PLACEHOLDER = re.compile(r"(?i)^(?:x+|\*+|\.+|your.*|change.?me.*|example.*|placeholder.*|none|null|true|false|todo|test|dummy|<.*>|\$\{.*\})$")
PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")


def name_score(name: str) -> float:
    """0 to 1: how sure the parts of a name say that its value is secret."""
    parts = [p.lower() for p in PARTS.findall(name)]
    if HARMLESS.intersection(parts[-1:]) or "public" in parts:
        return 0.0
    pairs = ["".join(p) for p in zip(parts, parts[1:], strict=False)]
    return min(1.0, sum(SENSITIVE.get(p, 0.0) for p in {*parts, *pairs}))


def value_score(value: str, quoted: bool = True, phrase: bool = False) -> float:
    """0 to 1.3: how much a literal looks drawn at random; 0 for short ones, placeholders, plain words and names of other things.

    With ``phrase``, 2 to 8 quoted words of 12 characters and more count as a passphrase.
    """
    n = len(value)
    if n < 8 or PLACEHOLDER.match(value):
        return 0.0
    if any(c.isspace() for c in value):
        return 0.7 if phrase and quoted and n >= 12 and 2 <= len(value.split()) <= 8 and "\n" not in value else 0.0
    entropy = -sum(c / n * math.log2(c / n) for c in Counter(value).values())
    classes = sum(any(f(c) for c in value) for f in (str.islower, str.isupper, str.isdigit)) + any(not c.isalnum() for c in value)
    if not quoted and classes < 3 and not any(c.isdigit() for c in value):
        return 0.0
    return min(1.3 if n >= 16 and classes >= 3 else 1.0, entropy / 3 if n >= 16 and classes >= 3 else entropy / 4) * (0.4 if classes == 1 else 1.0)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, leftmost and non-overlapping for each kind."""
    found, low = [], text.lower()
    if any(s in low for s in STEMS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST["access"]]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def literal_spans(text: str, threshold: float) -> list[tuple[int, int, int]]:
    """(start, kind, end) of literals that reach a sensitive name.

    Name-literal pairs come from ``Reader``: assignments with or without types, mappings, elements, definitions, setters and
    what strings hold. A name given a literal is a constant from there on; a sensitive name given that name, or literals and
    names joined or put into a string, makes the literal of each secret where it stands.
    """
    if not NEEDED.search(text.lower()) or not any(c in text for c in "=:(") and "</" not in text and "#define" not in text:
        return []
    found = set()
    # strings inside of strings are read as well, one level down: there only escaped quotes open and close
    inner = [QUOTES.sub(lambda m: f" {m[1]}" if m[1] else " ", text)] if '\\"' in text or "\\'" in text else []
    for name, spans, quoted in chain.from_iterable(Reader(t).pairs() for t in (text, *inner)):
        spans = [(a, b - 1) if text.startswith(("\\\"", "\\'"), b - 1) else (a, b) for a, b in spans]  # without the backslash of the quote that closes it
        if (sure := name_score(name)) > 0:
            whole = "".join(text[a:b] for a, b in spans)
            if sure * value_score(whole, quoted, sure >= 1.0) >= threshold:
                found.update(spans)
    return sorted((a, 3, b) for a, b in found if b > a)


def scan_secrets(docs: DataFrame, *, key: str = "doc_id", text: str = "text", threshold: float = 0.6) -> DataFrame:
    """Every row of ``docs`` with ``key``, ``text`` and ``spans``, an array of (kind, start, end, base).

    Offsets are code points, ends exclusive; spans are ordered by start, then by kind as in KINDS. ``base`` marks those of the
    fixed patterns; the others are literals whose name's score times their own reaches ``threshold``. A literal that lies
    inside a base span adds nothing and is left out.

    A narrow pass of Arrow batches without a shuffle; a row needs its own text only. Null text is empty: no spans. Null or
    repeated keys are rows of their own; an empty table gives an empty result. Only ``key`` and ``text`` are read.
    """
    kind = docs.schema[key].dataType.simpleString()
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))

    def spans(t: str) -> list[dict]:
        base = base_spans(t)
        reach = list(accumulate((b[2] for b in base), max))  # the furthest end of those that begin so early
        begins = [b[0] for b in base]
        more = [x for x in literal_spans(t, threshold) if not (k := bisect_right(begins, x[0])) or reach[k - 1] < x[2]]
        return [{"kind": KINDS[k], "start": a, "end": b, "base": k < 3} for a, k, b in sorted(base + more)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = pa.array([spans(t or "") for t in b.column(1).to_pylist()], span)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), found], [key, text, "spans"])

    return docs.select(key, text).mapInArrow(run, f"{key} {kind}, {text} string, spans array<struct<kind:string,start:bigint,end:bigint,base:boolean>>")
