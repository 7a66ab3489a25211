"""Names and the literals that they are given, read from source, configuration and markup."""

from __future__ import annotations

import re
from collections.abc import Iterator

Span = tuple[int, int]

#: What opens a string, with prefixes such as r, b, f, $ or @; and what may follow up to its end, for each kind of quote.
OPEN = re.compile(r"""(?<![\w'"`])([rRbBuUfF]{1,2}|[$@]{1,2})?(?=["'`])""")
BODY = {
    '"' * 3: re.compile(r'(?:[^\\"]|\\.|"(?!""))*', re.DOTALL), "'" * 3: re.compile(r"(?:[^\\']|\\.|'(?!''))*", re.DOTALL),
    '"': re.compile(r'(?:[^"\\\n]|\\.)*', re.DOTALL), "'": re.compile(r"(?:[^'\\\n]|\\.)*", re.DOTALL), "`": re.compile(r"(?:[^`\\\n]|\\.|\n(?!\n))*", re.DOTALL),
}
NAME = r"[A-Za-z_$][\w$]*(?:(?:\.|->|::|-)[A-Za-z_][\w$]*)*"
GAP = r"(?:[ \t]|\\\r?\n)*"
WORD, SKIP = re.compile(NAME, re.ASCII), re.compile(GAP)
#: What the scan stops at, in this order: comments, strings, elements, definitions, names.
SITE = re.compile(
    "|".join([
        r"(?P<fence>```+\w*)", r"(?P<comment>(?:(?<![^\s;{}),])//|/\*|<!--|(?<!\S)--(?=\s)|(?<!\S)#(?!define\b|\{))[ \t*!-]*)", r"(?P<over>\*/|-->)",
        r"<(?P<element>[A-Za-z_][\w.-]*)>(?P<inside>[^<>\n]+)</(?P=element)>", r"#define[ \t]+(?P<define>[A-Za-z_]\w*)[ \t]+",
        r"(?P<string>(?<![\w'\"`])(?:[rRbBuUfF]{1,2}|[$@]{1,2})?(?=[\"'`]))", rf"(?<![\w$.-])(?P<name>{NAME})", r"(?P<line>\n)",
    ]),
    re.ASCII,
)
ASSIGN = re.compile(rf"{GAP}\]?{GAP}(?::=|=>|=(?![=~>])|:(?![:=/]))(?:[ \t]*&[\w-]+)?")
#: A type behind a name, up to its brackets; a bracket; and what may stand between a type and its =.
TYPE, BRACKET = re.compile(rf"{GAP}:{GAP}[A-Za-z_][\w.]*"), re.compile(r"[ \t]*[\[<]")
AFTER = re.compile(rf"[ \t]*[?!*&]*(?:[ \t]*\|[ \t]*\w+)*{GAP}=(?![=>])")
JOINED = re.compile(rf"(?:{GAP}|(?:\s*\\\r?\n\s*))(?:\+|\.\.|\.(?=\s*[\"'$])|\|\|)\s*|{GAP}(?=[rRbBuUfF]{{0,2}}[\"'])|\s*\n\s*(?=[\"'](?:[^\"'\n]*)[\"']\s*(?:[\n)]|$))", re.ASCII)
#: A word without quotes: up to three parts between colons, and padding at its end. No = inside, so chains of = are read once.
BARE = re.compile(r"""[A-Za-z0-9_$\{/+%!@~^*-][^\s,;"'`()\[\]<>=:]*(?::[^\s,;"'`()\[\]<>=:]+){0,2}(?:={1,2}(?![^\s,;"'`()\[\]<>]))?""")
#: Calls that are read inside each other, and pieces of which a value is put together; what goes beyond isn't followed further.
DEPTH, PIECES = 30, 1000
REFERENCE = re.compile(r"(?:\$\{|#\{|\$\(|%\()?[$]?([A-Za-z_][\w.-]*)[\})]?s?")
INSIDE = re.compile(r"\$\{([A-Za-z_][\w.]*)\}|#\{([A-Za-z_][\w.]*)\}|\{([A-Za-z_][\w.]*)\}|\$([A-Za-z_]\w*)")
SPACE, CALL, OPENED, CLOSED = re.compile(r"\s*"), re.compile(r"[ \t]*\("), re.compile(r"(?:\(\s*)+"), re.compile(r"(?:\s*\))*")
ARGUMENTS = re.compile(r"\s*,\s*")
SETTER = re.compile(r"(?i)(?:.*[.>:])?(?:set|with|put|add|define|register)[_A-Z]?\w*$")
REST = re.compile(r"[ \t]*([|>][+-]?\d?[ \t]*)?\r?(?:\n|\Z)")
FIELD = re.compile(r"(?:^|[;&?,\s])([A-Za-z_][\w .-]{0,40}?)\s*=\s*([^;&,\s\"']+)")
LOGIN = re.compile(r"[A-Za-z][A-Za-z0-9+.-]*://[^\s:/@]*:([^\s:/@]+)@")


class Reader:
    """One text. ``pairs`` gives each name with its literals, as the spans of the texts that make them when joined."""

    def __init__(self, text: str):
        self.text, self.depth = text, 0
        self.constants: dict[str, list[Span]] = {}
        #: For each quote, up to where none closes a string; the next =, from where it was looked for, and its type's last bracket; a place and its line's begin.
        self.dead: dict[str, int] = {}
        self.equals = (0, -1, -1)
        self.line = (0, 0)

    def bounds(self, at: int) -> tuple[str, int, int, int] | None:
        """(prefix, begin, end, end with quotes) of a string that begins at ``at``.

        A scan that meets no closing quote is remembered: what later opens before its end has none either, since escapes are
        read in the same pairs from there."""
        if not (m := OPEN.match(self.text, at)):
            return None
        begin = m.end()
        q = self.text[begin]
        for mark in (q * 3, q):
            if mark in BODY and self.text.startswith(mark, begin) and begin >= self.dead.get(mark, 0):
                end = BODY[mark].match(self.text, begin + len(mark)).end()
                if self.text.startswith(mark, end):
                    return m[1] or "", begin + len(mark), end, end + len(mark)
                self.dead[mark] = end
        return None

    def typed(self, at: int) -> int | None:
        """The end of a type and an = behind a name. What stands between the last bracket before the = and the = itself is looked at once for each =."""
        t = self.text
        if not (m := TYPE.match(t, at)):
            return None
        if sign := AFTER.match(t, m.end()):
            return sign.end()
        if not (b := BRACKET.match(t, m.end())):
            return None
        since, eq, closing = self.equals
        if not since <= b.end() <= eq:
            since, eq = b.end(), t.find("=", b.end())
            eq = len(t) if eq < 0 else eq
            low = max(t.rfind("\n", since, eq), since - 1)
            closing = max(t.rfind("]", low + 1, eq), t.rfind(">", low + 1, eq)) if eq < len(t) else -1
            sign = AFTER.match(t, closing + 1) if closing >= 0 else None
            if not sign or sign.end() != eq + 1 or low >= since:
                closing = -1
            self.equals = (since, eq, closing)
        return eq + 1 if closing >= b.end() else None

    def indent(self, start: int) -> int:
        """How far ``start`` is from its line's begin; places are asked in order."""
        seen, begin = self.line
        begin = max(begin, self.text.rfind("\n", seen, start) + 1) if start >= seen else self.text.rfind("\n", 0, start) + 1
        self.line = (start, begin)
        return start - begin

    def string(self, at: int) -> tuple[list[Span], int, bool] | None:
        """The spans of a string's content with the constants it names put in, its end, and whether it is a plain literal."""
        if (found := self.bounds(at)) is None:
            return None
        prefix, a, b, end = found
        if "r" in prefix.lower() and "f" not in prefix.lower():
            return [(a, b)], end, True
        spans, last = [], a
        for r in INSIDE.finditer(self.text, a, b):
            if len(spans) < PIECES and (known := self.constants.get(r[r.lastindex])):
                spans += [(last, r.start())] if r.start() > last else []
                spans += known
                last = r.end()
        spans += [(last, b)] if b > last or not spans else []
        return spans, end, len(spans) == 1

    def term(self, at: int) -> tuple[list[list[Span]], int] | None:
        """The values that a term may have, each as spans, and where it ends."""
        t = self.text
        if s := self.string(at):
            return [s[0]], s[1]
        if t[at : at + 1] == "[":
            if self.depth >= DEPTH:
                return None
            self.depth += 1
            found = self.arguments(at + 1, "]")
            self.depth -= 1
            return found
        if t[at : at + 1] == "(":
            inner = self.value(OPENED.match(t, at).end())
            return (inner[0], CLOSED.match(t, inner[1]).end()) if inner else None
        m = BARE.match(t, at)
        if not m:
            return None
        name = WORD.match(t, at)
        if name and (call := CALL.match(t, name.end())):
            if self.depth >= DEPTH:
                return None
            self.depth += 1
            values, end = self.arguments(call.end())
            self.depth -= 1
            return values, end
        if m.end() - at < 200 and (r := REFERENCE.fullmatch(m[0])) and r[1] in self.constants:
            return [self.constants[r[1]]], m.end()
        return [[m.span()]], m.end()

    def arguments(self, at: int, close: str = ")") -> tuple[list[list[Span]], int]:
        """The strings among the arguments of a call, or in a list, each a value of its own."""
        values, t = [], self.text
        while True:
            at = SPACE.match(t, at).end()
            if t[at : at + 1] == close:
                return values, at + 1
            got = self.value(at)
            if got is None:
                return values, at
            if self.bounds(at):
                values += got[0]
            at = got[1]
            step = ARGUMENTS.match(t, at)
            if not step:
                end = SPACE.match(t, at).end()
                return values, end + 1 if t[end : end + 1] == close else at
            at = step.end()

    def value(self, at: int) -> tuple[list[list[Span]], int] | None:
        """Terms joined by +, by adjacency or by a line's continuation."""
        got = self.term(at)
        if got is None:
            return None
        values, end = got
        while len(values) == 1 and len(values[0]) < PIECES and (j := JOINED.match(self.text, end)):
            more = self.term(j.end()) if j.end() > end or self.bounds(j.end()) else None
            if more is None or len(more[0]) != 1:
                break
            values, end = [values[0] + more[0][0]], more[1]
        return values, end

    def below(self, at: int, start: int) -> tuple[list[list[Span]], int] | None:
        """The value of a mapping's key that stands on the next lines, deeper than the key; not a mapping or a list."""
        t = self.text
        left, rest = self.indent(start), REST.match(t, at)
        if not rest:
            return None
        many, spans, at = rest[1] is not None, [], rest.end()
        while at < len(t):
            stop = t.find("\n", at)
            stop = len(t) if stop < 0 else stop
            row = t[at:stop].rstrip()
            body = row.lstrip()
            if not body or len(row) - len(body) <= left or body.startswith(("- ", "#")) or (not many and re.match(r"[\"']?[\w.-]+[\"']?\s*:(\s|$)", body)):
                break
            if not many:
                return self.value(at + len(row) - len(body))
            spans.append((at + len(row) - len(body), at + len(row)))
            at = stop + 1
        return ([spans], at) if spans else None

    def pairs(self) -> Iterator[tuple[str, list[Span], bool]]:
        """(name, spans of a literal, whether it was quoted), in the order of the text."""
        t, at, in_line, in_block = self.text, 0, False, False
        while m := SITE.search(t, at):
            at = m.end()
            if m["line"]:
                in_line = False
            elif m["comment"]:
                in_block = in_block or m["comment"].startswith(("/*", "<!--"))
                in_line = in_line or not in_block
            elif m["over"]:
                in_block = False
            elif m["element"]:
                yield from self.give(m["element"], [[m.span("inside")]], False, in_line or in_block)
            elif m["define"]:
                if got := self.value(at):
                    yield from self.give(m["define"], got[0], t[at] in "\"'", False)
                    at = got[1]
            elif m["string"] is not None or m["name"]:
                name, start = m["name"], m.start()
                if name is None:
                    s = self.string(start)
                    if s is None:
                        at = start + 1
                        continue
                    at, (a, b) = s[1], (s[0][0][0], s[0][-1][1])
                    yield from self.fields(s[0])
                    name = t[a:b] if len(s[0]) == 1 and b - a <= 80 and "\n" not in t[a:b] else None
                    if name is None:
                        continue
                elif SETTER.match(name) and (call := CALL.match(t, at)):
                    values, _ = self.arguments(call.end())
                    own = re.sub(r"(?i)^(?:.*[.>:])?(?:set|with|put|add|define|register)_?", "", name)
                    if len(values) >= 2 and len(values[0]) == 1:
                        yield from self.give(t[slice(*values[0][0])], values[1:2], True, True)
                    elif values and own:
                        yield from self.give(own, values[:1], True, True)
                    continue
                sign = self.typed(at) if m["name"] else None
                if sign is None:
                    if not (plain := ASSIGN.match(t, at)):
                        continue
                    sign = plain.end()
                begin = SKIP.match(t, sign).end()
                got = self.value(begin)
                if got is None and begin < len(t) and (t[begin] in "\n|>"):
                    got = self.below(begin, start)
                if got is None or not got[0]:
                    if not (in_line or in_block):
                        self.forget(name)
                    continue
                quoted = t[begin] in "\n|>([" or self.bounds(begin) is not None
                yield from self.give(name, got[0], quoted, in_line or in_block)
                for v in got[0]:
                    yield from self.fields(v)
                at = max(at, got[1]) if quoted else sign

    def give(self, name: str, values: list[list[Span]], quoted: bool, aside: bool) -> Iterator[tuple[str, list[Span], bool]]:
        """Pairs of ``name``; outside of comments and calls it is a constant from here on."""
        if not aside and len(values) == 1 and len(values[0]) <= PIECES:
            self.constants[name] = values[0]
            self.constants[name.rpartition(".")[2]] = values[0]
        elif not aside:
            self.forget(name)
        for v in values:
            yield name, v, quoted

    def forget(self, name: str) -> None:
        """``name`` was given something else than a literal."""
        self.constants.pop(name, None)
        self.constants.pop(name.rpartition(".")[2], None)

    def fields(self, spans: list[Span]) -> Iterator[tuple[str, list[Span], bool]]:
        """Names inside of a string: those of connection strings and queries, and passwords of addresses."""
        for a, b in spans:
            part = self.text[a:b]
            if "=" in part:
                for m in FIELD.finditer(part):
                    yield m[1], [(a + m.start(2), a + m.end(2))], False
            if "://" in part:
                for m in LOGIN.finditer(part):
                    yield "password", [(a + m.start(1), a + m.end(1))], False
