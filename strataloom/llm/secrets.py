"""Secret scans by assignment-aware lexing.

Three base kinds come from fixed patterns. On top, each text is lexed into name-literal pairs (`name = "x"`, `name: x`,
`"name": "x"`, `name := x`, `export NAME=x`, `<name>x</name>`, `set name x`, triple quotes, YAML blocks under `name: |`); quotes
may be escaped inside quoted literals, and quoted literals joined by `+`, in one line or over several, are one. Constants are
propagated: a bare literal that is the name of an earlier pair, and `${name}` or `$name` bare or in double quotes, take that
pair's literal; any other quoted literal stands for itself. Each literal is scored by how sensitive its target name is and
how random it looks (line breaks, indentation and armour lines of blocks left out); those at or over the threshold are added
with kind `named`, unless a base span already covers them. A named span is the literal where it is written.

Spans count code points, end exclusive, and hold the whole match of a base pattern. Defined cases: null and empty texts
have no spans and the SHA-256 of the empty string; names, literals and lines of any length are lexed alike; repeated rows and
rows with a null id get their own result.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from collections import Counter
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame

from strataloom.llm.common import pick, table

# The three base patterns and their least lengths.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # the runs of [0-9a-f]+ of 24 characters or more
MIN_ASSIGN, MIN_ACCESS, MIN_HEX = 6, 20, 24
KINDS = ["assign", "access", "hex", "named"]

# Parts of names and how sensitive they are.
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "passphrase": 1.0, "pwd": 0.9, "secret": 1.0, "token": 0.9, "apikey": 1.0, "accesskey": 1.0, "privatekey": 1.0, "credential": 0.9,
    "credentials": 0.9, "bearer": 0.8, "auth": 0.6, "authorization": 0.7, "signature": 0.5, "salt": 0.5, "pin": 0.4, "key": 0.45, "dsn": 0.6, "connectionstring": 0.7, "webhook": 0.5, "session": 0.5, "cookie": 0.5,
}
HARMLESS = ["example", "placeholder", "changeme", "your", "none", "null", "true", "false", "undefined", "todo", "redacted", "xxxx", "****", "file", "path", "url", "length", "count"]

_NAME = r"[A-Za-z_][A-Za-z0-9_.\-]*+"
_DOUBLE, _SINGLE = r'"((?:[^"\\\n]|\\[^\n])++)"', r"'((?:[^'\\\n]|\\[^\n])++)'"
_TRIPLE = r'"""((?:[^"]|"(?!""))++)"""' + "|" + r"'''((?:[^']|'(?!''))++)'''"
_BARE = r"(\$?\{?[A-Za-z0-9+/_.=\-]++\}?)"
_BLOCK = r"([|>])[+\-]?[\x20\t]*(?=\n[\x20\t])"
#: Name, optional type, sign, then a literal: triple quotes (2, 3), double (4), single (5), bare (6) or, after a colon, the sign of a block (7).
PAIR = re.compile(rf"""(?<![A-Za-z0-9_.\-$])["']?({_NAME})["']?(?:[\x20\t]*:[\x20\t]*[A-Za-z_]+(?=[\x20\t]*=))?[\x20\t]*(?:(?::=|=>|[:=])[\x20\t]*(?:{_TRIPLE}|{_DOUBLE}|{_SINGLE}|{_BARE})|:[\x20\t]*{_BLOCK})""")
TAG = re.compile(rf"<({_NAME})>([^<\n]{{2,}}+)</\1>")
SET = re.compile(rf"(?m)^[\x20\t]*set[\x20\t]+({_NAME})[\x20\t]+([^\s;]++)")
_BREAK = r"[\x20\t]*(?:\\?\r?\n[\x20\t]*)?"
JOINED = re.compile(rf"{_BREAK}\+{_BREAK}(?:{_DOUBLE}|{_SINGLE})")
REFERENCE = re.compile(rf"\$(?:\{{({_NAME})\}}|({_NAME}))")
_INDENT = re.compile(r"[\x20\t]*")
_ESCAPE = re.compile(r"\\(.)")
_ARMOUR = re.compile(r"-----[A-Z0-9 ]+-----")
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")
_MAY = re.compile(r"[:=]|</|(?m:^[\x20\t]*set[\x20\t])")


def sensitivity(name: str) -> float:
    """Of a target name: the best of its parts, of neighbouring parts together, and of the whole."""
    parts = [p.lower() for p in _PARTS.findall(name)]
    pieces = [*parts, *(a + b for a, b in zip(parts, parts[1:], strict=False)), "".join(parts)]
    return max((SENSITIVE.get(p, SENSITIVE.get(p.removesuffix("s"), 0.0)) for p in pieces), default=0.0)


def randomness(literal: str) -> float:
    """0 to 1, from Shannon entropy, kinds of characters and length."""
    n = len(literal)
    if n < 6 or any(c.isspace() for c in literal):
        return 0.0
    low = literal.lower()
    if any(h in low for h in HARMLESS):
        return 0.0
    counts = Counter(literal)
    entropy = -sum(c / n * math.log2(c / n) for c in counts.values())
    kinds = sum(any(f(c) for c in literal) for f in (str.islower, str.isupper, str.isdigit, lambda c: not c.isalnum()))
    return min(1.0, 0.5 * min(entropy / 4.0, 1.0) + 0.15 * (kinds - 1) + 0.2 * min(n / 32, 1.0))


def _block(text: str, start: int, end: int) -> tuple[str, int, int]:
    """A literal over several lines: its lines without indentation, side by side, and where it starts and ends without outer white space."""
    body = text[start:end]
    start, end = start + len(body) - len(body.lstrip()), end - len(body) + len(body.rstrip())
    return "".join(line.strip() for line in _ARMOUR.sub("", body).split("\n")), start, end


def _indented(text: str, m: re.Match) -> tuple[int, int]:
    """Start and end of the lines after a pair that are indented further than its own."""
    own = m.start() - (text.rfind("\n", 0, m.start()) + 1)
    at = start = text.index("\n", m.end()) + 1
    while at < len(text) and _INDENT.match(text, at).end() - at > own:
        at = text.find("\n", at) + 1 or len(text)
    return start, at


def _literal(text: str, m: re.Match) -> tuple[str, str | None, int, int]:
    """Value, the name it refers to if it does, start and end."""
    kind = m.lastindex
    start, end = m.span(kind)
    if kind in (2, 3, 7):
        value, start, end = _block(text, *(_indented(text, m) if kind == 7 else (start, end)))
        return value, None, start, end
    if kind == 6:
        named = REFERENCE.fullmatch(m[6])
        return m[6], (named[1] or named[2]) if named else m[6], start, end
    named = REFERENCE.fullmatch(m[4]) if kind == 4 else None
    value, at = _ESCAPE.sub(r"\1", m[kind]), m.end()
    while j := JOINED.match(text, at):
        value, end, at = value + _ESCAPE.sub(r"\1", j[j.lastindex]), j.end(j.lastindex), j.end()
        named = None
    return value, (named[1] or named[2]) if named else None, start, end


def pairs(text: str) -> list[tuple[str, str, int, int]]:
    """(name, literal, start, end) in the order of the pairs; literal, start and end after propagation: where a constant was written."""
    if not _MAY.search(text):
        return []
    found = []
    for m in PAIR.finditer(text):
        value, refers, start, end = _literal(text, m)
        found.append((start, end, m[1], value, refers))
    if "</" in text:
        found += [(m.start(2), m.end(2), m[1], m[2], None) for m in TAG.finditer(text)]
    if "set" in text:
        found += [(m.start(2), m.end(2), m[1], m[2], m[2]) for m in SET.finditer(text)]
    known: dict[str, tuple[str, int, int]] = {}
    out = []
    for start, end, name, value, refers in sorted(found, key=lambda x: x[:2]):
        own = value, start, end
        known[name] = own = known.get(refers, own) if refers is not None else own
        out.append((name, *own))
    return out


def base_spans(text: str) -> list[tuple[int, int, str]]:
    found = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_ASSIGN]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return found


def scan(text: str | None, threshold: float = 0.5) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """Base spans, and all spans, as (start, end, kind) by start, then kind as listed."""
    text = text or ""
    order = lambda x: (x[0], KINDS.index(x[2]), x[1])
    base = sorted(base_spans(text), key=order)
    starts, reach = [x[0] for x in base], list(accumulate((x[1] for x in base), max))
    more = set()
    for name, literal, start, end in pairs(text):
        if sensitivity(name) * randomness(literal) >= threshold:
            before = bisect_right(starts, start)
            if not before or reach[before - 1] < end:
                more.add((start, end, "named"))
    return base, sorted({*base, *more}, key=order)


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """One row a document; a map without any shuffle."""

    def run(batches):
        for batch in batches:
            got = [scan(t.as_py(), threshold) for t in batch.column(1)]
            count = lambda kind: pa.array([sum(s[2] == kind for s in base) for base, _ in got], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), count("assign"), count("access"), count("hex"), pa.array([hashlib.sha256(joined(b).encode()).hexdigest() for b, _ in got]), pa.array([joined(a) for _, a in got], pa.string())],
                ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
            )

    return pick(docs, id=id_col, text=text_col).mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def op8(spark, sf_dir) -> DataFrame:
    return find(table(spark, sf_dir, "documents"))
