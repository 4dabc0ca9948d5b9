"""Secret scans: fixed patterns, and an assignment-aware lexer that adds spans to theirs.

The lexer reads lines that hold an operator as source or configuration syntax:
names, string and bare literals, ``=``, ``:``, ``:=``, ``=>`` and ``+``, values
in brackets and over several lines (after a backslash, an operator, in triple
quotes, as a YAML block), calls and their keyword arguments, subscripts,
elements and attributes, and name entries followed by value entries.  It
yields pairs of a target name and the literals of its value, follows names
that were given a literal earlier in the same text (also as ``$NAME``,
``${NAME}`` and in formatted strings), and scores a literal by how sensitive
the target's name is times how little the literal looks like a word or a
placeholder.  A name that is called or subscripted is no literal, nor is the
first argument of a call that reads settings.  A literal that
scores enough and overlaps no other span is added with kind ``literal``; if the
value came through a constant, the span is where the constant got it.

Positions are code points, ends exclusive.  Work is linear in a text's length:
quoted strings of any length are read without going back, and once a quote is
found to have no closing one, later quotes of its kind on the line aren't tried;
values that use other values share them.

Cases: a null or empty text has no spans; repeated rows are scanned as often
as they occur; an empty table gives an empty result; a null doc_id is carried
through; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import map_texts, ordered_documents

KINDS = ("assign", "access", "hex", "literal")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # runs shorter than that fail anyway
LEAST_ASSIGN, LEAST_ACCESS = 6, 20
LEAST_SCORE = 0.5
MASK = "[SECRET]"

STRING = {q: rf"{q}[^{q}\\\n]*+(?:\\.[^{q}\\\n]*+)*+{q}" for q in "\"'"}
REST = (
    r"""(?P<op>:=|=>|==|!=|<=|>=|[=:+])"""
    r"""|(?P<ref>\$\{?[A-Za-z_]\w*\}?)"""
    r"""|(?P<bare>[A-Za-z0-9_][\w./+=-]*)"""
    r"""|(?P<gap>[ \t\r]+)|(?P<open>[(\[{])|(?P<close>[)\]}])|(?P<comma>,)|(?P<other>.)"""
)
PREFIX = r"(?:(?<![\w])[rRbBuUfF]{1,2}(?=[\"']))?"
# by the kinds of quote that may still open a string on the line
TOKEN = {
    kinds: re.compile("|".join([r"(?P<triple>" + PREFIX + r"(?:\"\"\"|'''))", *([f"(?P<string>{PREFIX}(?:" + "|".join(STRING[q] for q in kinds) + "))"] if kinds else []), REST]), re.S)
    for kinds in ("\"'", '"', "'", "")
}
BLOCK = re.compile(r"(?P<indent>[ \t]*)(?:- +)*[\"']?(?P<name>[A-Za-z_][\w.-]*)[\"']?[ \t]*:[ \t]+[|>][+-]?[0-9]?[+-]?[ \t]*(?:#.*)?\r?$")
ELEMENT = re.compile(r"<([A-Za-z_][\w.:-]*)(?:[ \t\r\n][^<>]*+)?>([^<>]+)</([A-Za-z_][\w.:-]*)[ \t]*>")
WORDY = re.compile(r"[A-Za-z_]*[a-z_](?:[./][A-Za-z_]+)+\Z")  # a path of plain names: a reference, not a literal
NAME = re.compile(r"[A-Za-z_][\w.-]*\Z")
PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")

# fixed values: name parts that mark a sensitive target, alone or together, with how much they say
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "pwd": 1.0, "passphrase": 1.0, "pass": 0.7, "secret": 1.0, "token": 0.95, "apikey": 1.0,
    "credential": 0.9, "credentials": 0.9, "bearer": 0.9, "authorization": 0.8, "auth": 0.7, "cookie": 0.6, "session": 0.6, "salt": 0.6,
}
SENSITIVE_PAIRS = {("api", "key"): 1.0, ("access", "key"): 1.0, ("private", "key"): 1.0, ("secret", "key"): 1.0, ("signing", "key"): 1.0, ("encryption", "key"): 1.0, ("auth", "key"): 0.9, ("master", "key"): 0.9, ("connection", "string"): 0.8}
READERS = frozenset("get getenv env getproperty lookup fetch read load require config".split())  # calls whose first argument names what they read
NAMING, VALUING = frozenset(("name", "key", "id", "property")), frozenset(("value", "content", "default"))  # targets that hold a pair's name, and its value
PLACEHOLDER = re.compile(r"(?i)^(?:x+|\*+|\.+|null|none|nil|true|false|undefined|changeme|change_me|example\w*|sample\w*|your[\w.-]*|test|todo|redacted|secret|password|token|placeholder|dummy)$")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The fixed patterns' spans by start, then kind as listed."""
    found = []
    if ":" in text or "=" in text:
        found += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGN]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    found += [("hex", *m.span()) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def sensitivity(name: str) -> float:
    """How sensitive a target of this name is, 0 to 1."""
    parts = [p.lower() for p in PARTS.findall(name)]
    alone = max((SENSITIVE.get(p, 0.0) for p in [*parts, "".join(parts)]), default=0.0)
    return max(alone, max((SENSITIVE_PAIRS.get(p, 0.0) for p in zip(parts, parts[1:])), default=0.0))


def secrecy(literal: str, quoted: bool) -> float:
    """How much a literal looks like a secret rather than a word, number or placeholder, 0 to 1."""
    n = len(literal)
    if n < LEAST_ASSIGN or PLACEHOLDER.match(literal) or any(c.isspace() for c in literal):
        return 0.0
    bits = -sum(c / n * math.log2(c / n) for c in Counter(literal).values())
    digits, letters = any(c.isdigit() for c in literal), any(c.isalpha() for c in literal)
    mixed = literal.lower() != literal and literal.upper() != literal and not literal.istitle()
    score = min(1.0, bits / 3.0) * (0.4 + 0.4 * (digits and letters) + 0.2 * mixed + 0.2 * any(not c.isalnum() for c in literal) + 0.15 * quoted)
    return min(1.0, score)


class Value:
    """What a name was given: literals of its own as (start, end, quoted), and the values of names that it uses.

    Uses are shared, never copied, so that a chain of names takes room in
    proportion to its text.
    """

    __slots__ = ("literals", "uses")

    def __init__(self) -> None:
        self.literals: list[tuple[int, int, bool]] = []
        self.uses: list[Value] = []

    def __bool__(self) -> bool:
        return bool(self.literals or self.uses)


class Lexer:
    """Reads a text line by line into pairs of a target name and its value.

    A line's reading goes on to the next one inside brackets that belong to a
    value, after a backslash, and after an operator that lacks its right side;
    a blank line ends everything that is open.
    """

    def __init__(self, text: str):
        self.text, self.pairs, self.constants = text, [], {}
        self.no_triple: set[str] = set()
        self._reset()
        self.read()

    def _reset(self) -> None:
        self.name, self.target, self.value, self.joined = "", "", Value(), False
        self.stack: list[tuple[str, str, str, Value]] = []  # bracket, kind, outer target and value
        self.last: tuple[str, int, bool] = ("", 0, False)  # the token before, where it ends, whether it was taken as a literal
        self.fresh = False  # a new line began after a complete value
        self.named = ""  # what a naming target was given

    def close(self) -> None:
        if self.target and self.value:
            self.pair(self.target, self.value)
        self.target, self.value, self.joined = "", Value(), False

    def pair(self, target: str, value: Value) -> None:
        self.pairs.append((target, value))
        self.constants[target] = value
        part = target.rpartition(".")[2].lower()
        if part in NAMING and len(value.literals) == 1 and not value.uses:
            a, b, _ = value.literals[0]
            self.named = self.text[a:b] if b - a < 200 and NAME.match(self.text[a:b]) else ""
        elif part in VALUING and self.named:
            self.pairs.append((self.named, value))
            self.named = ""

    def read(self) -> None:
        text, at, n = self.text, 0, len(self.text)
        while at < n:
            end = text.find("\n", at)
            end = n if end < 0 else end
            open_ = bool(self.stack) or self.joined
            line = text[at:end]
            if "=" not in line and ":" not in line and not open_ and not (self.fresh and "+" in line):
                if self.fresh or self.named:
                    self.close()
                    self.fresh = False
                    if not line.strip():
                        self.named = ""
                at = end + 1
                continue
            if not line.strip():
                self.close()
                self._reset()
                at = end + 1
                continue
            if ":" in line and ("|" in line or ">" in line) and (m := BLOCK.match(line)):
                self.close()
                self._reset()
                at = self.block(m["name"], len(m["indent"]), end + 1)
                continue
            at = self.line(at, end)
        self.close()

    def block(self, name: str, indent: int, at: int) -> int:
        """A block scalar: the lines below that are deeper than its key; returns where the next line begins."""
        text, value = self.text, Value()
        while at < len(text):
            end = text.find("\n", at)
            end = len(text) if end < 0 else end
            line = text[at:end]
            body = line.strip()
            if body:
                if len(line) - len(line.lstrip(" \t")) <= indent:
                    break
                a = at + line.index(body)
                value.literals.append((a, a + len(body), True))
            at = end + 1
        if value:
            self.pair(name, value)
        return at

    def line(self, at: int, end: int) -> int:
        """Reads one line, and what a triple quote that opens on it takes up; returns where the next line begins."""
        text, kinds = self.text, "\"'"
        waiting = self.target if self.joined and not self.stack else None
        while at < end:
            restart = False
            for m in TOKEN[kinds].finditer(text, at, end):
                kind, at = m.lastgroup, m.end()
                if kind == "triple":
                    quote = m[0][-3:]
                    close = text.find(quote, at) if quote not in self.no_triple else -1
                    if close < 0:
                        self.no_triple.add(quote)
                        self.token("other", m[0], m.start(), at)
                        continue
                    if "\n" in text[at:close]:
                        self.lines(at, close)
                    else:
                        self.string(at, close, "f" in m[0].lower())
                    at = close + 3
                    if at > end:  # the rest of the line on which it ends
                        end = text.find("\n", at)
                        end = len(text) if end < 0 else end
                    restart = True
                    break
                if kind == "string":
                    prefix = len(m[0]) - len(m[0].lstrip("rRbBuUfF"))
                    self.string(m.start() + prefix + 1, at - 1, "f" in m[0][:prefix].lower())
                    continue
                if kind == "other" and m[0] == "\\" and not text[at:end].strip():
                    return end + 1  # goes on below, as it stands
                self.token(kind, m[0], m.start(), at)
                if kind == "other" and m[0] in kinds:  # unclosed: later quotes of its kind on the line were read as escaped
                    kinds = kinds.replace(m[0], "")
                    restart = True
                    break
            if not restart:
                break
        if not self.stack:
            self.name = ""
            if waiting is not None and self.joined and self.target == waiting and not self.value:
                self.close()  # nothing came
            self.fresh = not self.joined
        return end + 1

    def lines(self, a: int, b: int) -> None:
        """A string over several lines: each is a literal."""
        if self.target and self.joined:
            for line in self.text[a:b].split("\n"):
                body = line.strip(" \t\r\\")
                if body:
                    begin = a + line.index(body)
                    self.value.literals.append((begin, begin + len(body), True))
                a += len(line) + 1
        self.joined, self.name, self.last = False, "", ("", b, False)

    def string(self, a: int, b: int, formatted: bool) -> None:
        if not formatted or "{" not in self.text[a:b]:
            self.token("string", self.text[a:b], a, b)
            return
        if self.fresh:
            self.close()
            self.fresh = False
        if not (self.target and self.joined):
            return
        at = a
        while at < b:  # the literal parts between fields, and the constants that fields name
            begin = self.text.find("{", at, b)
            begin = b if begin < 0 else begin
            if begin > at:
                self.value.literals.append((at, begin, True))
            close = self.text.find("}", begin, b)
            close = b if close < 0 else close
            known = self.constants.get(self.text[begin + 1 : close].strip()) if close - begin < 200 else None
            if known is not None:
                self.value.uses.append(known)
            at = close + 1
        self.joined = False
        self.last = ("", b, False)

    def take(self, inner: str, a: int, b: int, quoted: bool, ref: bool) -> None:
        """A literal or a known name, as part of the open value."""
        known = self.constants.get(inner.strip("${}")) if ref or not quoted or inner.startswith("$") else None
        if known is not None:
            self.value.uses.append(known)
        elif inner and (quoted or not WORDY.match(inner)):
            self.value.literals.append((a, b, quoted))
            self.last = (inner, b, True)
        self.joined = False

    def token(self, kind: str, token: str, a: int, b: int) -> None:
        if kind == "gap":
            return
        if self.fresh:  # only a plus sign takes up the value of the line before
            if not (kind == "op" and token == "+"):
                self.close()
            self.fresh = False
        before, self.last = self.last, ("", b, False)
        if kind == "op":
            if token in ("=", ":", ":=", "=>"):
                if self.name:
                    name, self.name = self.name, ""
                    if before[2] and self.value.literals and self.value.literals[-1][1] == before[1] and before[0] == name:
                        self.value.literals.pop()  # what looked like a value is the next name
                    if self.stack and self.target == self.stack[-1][2] and self.value is self.stack[-1][3]:
                        self.target, self.value = "", Value()  # the outer value goes on when the bracket closes
                    else:
                        self.close()
                    self.target = name
                self.joined = bool(self.target)
            else:
                self.joined = token == "+" and bool(self.value)
            self.name = ""
        elif kind in ("string", "bare", "ref"):
            quoted, inner = kind == "string", token
            if quoted and self.stack and self.target and before[2] and self.value.literals and self.value.literals[-1][1:] == (before[1], True):
                self.joined = True  # strings side by side are one value
            if kind == "bare" and "=" in inner and not (self.target and self.joined):  # name=value without spaces
                left, _, right = inner.partition("=")
                if NAME.match(left):
                    if self.stack and self.value is self.stack[-1][3]:
                        self.target, self.value = "", Value()
                    else:
                        self.close()
                    self.target, self.joined, inner, a = left, True, right, a + len(left) + 1
                    if not inner:
                        self.name = ""
                        return
            self.last = (inner, b, False)
            if self.target and self.joined:
                self.take(inner, a, b, quoted, kind == "ref")
            elif not self.stack:
                self.close()
            self.name = inner if len(inner) < 200 and NAME.match(inner) else ""
        elif kind == "open":
            self.open(token, a, before)
        elif kind == "close":
            self.shut(token)
        elif kind == "comma" and self.stack:
            self.part()
        elif kind == "other" and self.stack:
            self.joined, self.name = False, ""
        else:
            self.close()
            self.name = ""

    def open(self, token: str, a: int, before: tuple[str, int, bool]) -> None:
        called = before[0] if before[0] and before[1] == a and token != "{" else ""  # a name right before the bracket
        kind = "map"
        if called:
            if before[2] and self.value.literals and self.value.literals[-1][1] == before[1]:
                self.value.literals.pop()  # that was no literal
            kind = "index" if token == "[" else "read" if re.split(r"[._]", called.lower())[-1] in READERS else "call"
        elif self.target and self.joined and token != "{":
            kind = "group"
        elif not self.stack and not (self.target and self.joined):
            self.name = ""
            return  # outside of any value brackets say nothing
        self.stack.append((token, kind, self.target, self.value))
        self.joined, self.name = kind in ("group", "call") and bool(self.target), ""
        if kind == "map":
            self.target, self.value = "", Value()

    def part(self) -> None:
        """After a comma inside brackets: back to what the bracket belongs to."""
        _, kind, target, value = self.stack[-1]
        if self.value is not value:
            self.close()
        self.name = ""
        if kind == "map":
            self.target, self.value, self.joined = "", Value(), False
        else:
            self.target, self.value, self.joined = target, value, bool(target) and kind != "index"

    def shut(self, token: str) -> None:
        name = self.name
        self.name = ""
        if not self.stack:
            return
        if "([{".index(self.stack[-1][0]) != ")]}".index(token):
            return  # unbalanced
        _, kind, target, value = self.stack.pop()
        if self.value is not value:
            self.close()
        self.target, self.value, self.joined = target, value, False
        if kind == "index":
            self.name = name  # config["password"] = ...


def assignments(text: str) -> list[tuple[str, Value]]:
    """(target name, its value) in order; elements come last."""
    pairs = Lexer(text).pairs
    if "</" in text:
        for m in ELEMENT.finditer(text):
            body = m[2].strip()
            if m[1] == m[3] and body:
                value = Value()
                a = m.start(2) + m[2].index(body)
                value.literals.append((a, a + len(body), True))
                pairs.append((m[1].rpartition(":")[2], value))
    return pairs


def sensitive_literals(text: str) -> dict[tuple[int, int, bool], float]:
    """Each literal that a sensitive name leads to, with the largest sensitivity; a value is gone through once for each of the few degrees there are."""
    found: dict[tuple[int, int, bool], float] = {}
    seen: set[int] = set()
    pairs = assignments(text)
    known = {name: sensitivity(name) for name in {n for n, _ in pairs}}
    for degree, value in sorted(((known[n], v) for n, v in pairs if known[n]), key=lambda p: -p[0]):
        waiting = [value]
        while waiting:
            v = waiting.pop()
            if id(v) not in seen:
                seen.add(id(v))
                for literal in v.literals:
                    found.setdefault(literal, degree)
                waiting += v.uses
    return found


def spans(text: str | None) -> list[tuple[str, int, int]]:
    """All spans by start, then kind as listed."""
    text = text or ""
    base = base_spans(text)
    if "=" not in text and ":" not in text:
        return base
    scored = {(a, b) for (a, b, quoted), degree in sensitive_literals(text).items() if degree * secrecy(text[a:b], quoted) >= LEAST_SCORE}
    if not scored:
        return base
    taken, added, k = sorted((a, b) for _, a, b in base), [], 0
    for a, b in sorted(scored):
        while k < len(taken) and taken[k][1] <= a:
            k += 1
        if not any(x < b and a < y for x, y in taken[k : k + 4]):
            added.append(("literal", a, b))
    return sorted(base + added, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def joined(found: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in found)


def scan(docs: DataFrame) -> DataFrame:
    """doc_id and spans (array of kind, start, end) of every row."""

    def run(texts: list, other: list) -> pa.RecordBatch:
        found = [[{"kind": k, "start": a, "end": b} for k, a, b in spans(t)] for t in texts]
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        return pa.RecordBatch.from_arrays([other[0], pa.array(found, kind)], ["doc_id", "spans"])

    return map_texts(ordered_documents(docs), run, "doc_id long, spans array<struct<kind: string, start: long, end: long>>")


def digests(scanned: DataFrame) -> DataFrame:
    """doc_id, counts of the fixed kinds, their spans' SHA-256 and all spans as text."""
    shown = lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])
    base = F.filter("spans", lambda s: s["kind"] != "literal")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return scanned.select(
        "doc_id", *map(count, ("assign", "access", "hex")),
        F.sha2(F.array_join(F.transform(base, shown), ","), 256).alias("base_sha256"),
        F.array_join(F.transform("spans", shown), ",").alias("spans"),
    )


def masked(text: str | None) -> str | None:
    """The text with each span, or run of overlapping spans, replaced by a mark."""
    found = spans(text)
    if not found:
        return text
    out, at, reach = [], 0, -1
    for _, a, b in found:
        if a >= reach:
            out += [text[at:a], MASK]
        reach = max(reach, b)
        at = reach
    return "".join([*out, text[at:]])


def mask_secrets(docs: DataFrame) -> DataFrame:
    """All rows with all columns, secrets in the text replaced by a mark and n_chars, if there, made to agree."""
    names = docs.columns
    plain = [f"c{k}" for k in range(len(names))]
    text = plain[names.index("text")]
    renamed = docs.toDF(*plain).withColumn(text, F.col(text).cast("string"))
    order = [text, *(c for c in plain if c != text)]

    def run(texts: list, other: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([masked(t) for t in texts], pa.string()), *other], order)

    out = map_texts(renamed, run, ", ".join(f"{c} {renamed.schema[c].dataType.simpleString()}" for c in order), text).select(*plain).toDF(*names)
    return out.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text")).cast(docs.schema["n_chars"].dataType)) if "n_chars" in names else out


def sha256_of(found: list[tuple[str, int, int]]) -> str:
    return hashlib.sha256(joined(found).encode()).hexdigest()
