"""Secret scans: base patterns, and assignment-aware lexing.

Base patterns (assign, access, hex) are matched left to right without overlap; a
match that fails its length check is dropped.  The lexer adds spans of kind
``lexed``: it reads source and configuration syntax (``name = "..."``, ``name:
value``, ``"name": "..."``, ``name := ...``, ``name => ...``, ``export NAME=...``,
``key="name" value="..."``) into name-literal pairs in order, joins ``+`` parts,
follows names that stand for literals seen before (also ``${name}``), and scores a
literal by how sensitive the name is that finally holds it and by how much the
literal looks like a secret.  A literal inside a base span adds nothing.

One narrow pass, no shuffle.  Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from tidepool.llm.common import map_texts

KINDS = ("assign", "access", "hex", "lexed")
#: A lexed literal's score must reach this.
MIN_SCORE = 0.5
#: Counts of a constant are scaled down beyond so many bits (x = x + x doubles them).
COUNT_BITS = 512
#: First characters of a constant that are kept; longer than every placeholder word.
HEAD = 16

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                     re.ASCII | re.IGNORECASE)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
# A run of 16 or more is found exactly where a run of one or more would be.
_HEX = re.compile(r"[0-9a-f]{16,}")
_ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_IS_HEX = bytes(1 if c in b"0123456789abcdef" else 0 for c in range(256))
_HEX_RUN = b"\x01" * 16

# Sensitive name parts and their weights.
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "pwd": 0.9, "passphrase": 1.0, "secret": 1.0, "token": 0.9, "apikey": 1.0,
    "api_key": 1.0, "access_key": 1.0, "accesskey": 1.0, "secret_key": 1.0, "private_key": 1.0, "privatekey": 1.0,
    "signing_key": 0.9, "encryption_key": 0.9, "auth_key": 0.9, "credential": 0.9, "credentials": 0.9, "bearer": 0.8,
    "authorization": 0.8, "auth": 0.7, "client_secret": 1.0, "connection_string": 0.8, "key": 0.55,
}
# Every spelling that name_weight accepts holds one of these once its separators are taken out.
_JOINED = {name.replace("_", "") for name in SENSITIVE}
_STEMS = sorted(s for s in _JOINED if not any(o in s for o in _JOINED - {s}))
_PLACEHOLDER = re.compile(r"(?i)^(?:x+|\*+|\.+|none|null|nil|true|false|undefined|changeme|change_me|todo|test|example|"
                          r"placeholder|redacted|\[secret\]|your[_-].*|<.*>|\$\{.*\}|%.*%)$")

_LITERAL = r""""[^"\n]*"|'[^'\n]*'"""
_SEP = r"(?::=|=>|=(?!=)|:(?!:))"
# A name and a separator.  Names are tried once per run of name characters: at its
# first part (cut at dashes) that starts like a name.
_HEAD = re.compile(
    rf"""(?:(?<![\w.-])(?:(?![A-Za-z_])[A-Za-z0-9_.]*+-)*+|(?<=-)(?=["']))"""
    rf"""(?P<quote>["']?)(?P<name>[A-Za-z_][A-Za-z0-9_.-]*+)(?P=quote)[ \t]*+(?P<sep>{_SEP})[ \t]*+""", re.ASCII)
# The type of a declaration, up to its value: ``: str =``, ``: Option<String> =``,
# ``: string | null =``, ``: &'static str =``.  It holds no single colon, so no
# stretch of text is read twice.
_ATOM = r"""[&*]*+(?:'\w++[ \t]++)?(?:(?:mut|const|dyn)[ \t]++)?[A-Za-z_][\w.]*+(?:::\w++)*+(?:[<\[][\w \t.,<>\[\]|?&*]*+)?[?*]*+"""
_TYPE = re.compile(rf"""{_ATOM}(?:[ \t]*+\|[ \t]*+{_ATOM})*+[ \t]*+=(?![=>])[ \t]*+""", re.ASCII)
_BARE = re.compile(r"""[^\s"',;(){}\[\]<>+]+""", re.ASCII)
_QUOTED = re.compile(rf"""{_LITERAL}|\$\{{?\w+\}}?""", re.ASCII)
_TAIL = re.compile(rf"""(?:[ \t]*+\+[ \t]*+(?P<last>{_LITERAL}|[A-Za-z_]\w*+))*+""", re.ASCII)
_GOES_ON = re.compile(rf"""[ \t]*+{_SEP}""")
_KEY_VALUE = re.compile(
    r"""(?:key|name)[ \t]*+=[ \t]*+["'](?P<name>[A-Za-z_][A-Za-z0-9_.-]*)["'][ \t]++value[ \t]*+=[ \t]*+"""
    rf"""(?P<value>{_LITERAL})""", re.ASCII)
_PART = re.compile(rf"""{_LITERAL}|[A-Za-z_]\w*""", re.ASCII)
_CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")


def base_spans(text: str) -> list[tuple[int, int, str]]:
    out: list[tuple[int, int, str]] = []
    low = text.lower()
    if any(w in low for w in _ASSIGN_WORDS):
        out += [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text) if len(m[0]) >= 18]
    if _HEX_RUN in text.encode("utf-8").translate(_IS_HEX):
        out += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    return out


def name_weight(name: str) -> float:
    """How sensitive a target name is: its parts, and neighbours joined by ``_``."""
    parts = [p for p in re.split(r"[_.-]+", _CAMEL.sub("_", name).lower()) if p]
    runs = parts + ["_".join(p) for p in zip(parts, parts[1:])] + ["".join(p) for p in zip(parts, parts[1:])]
    return max((SENSITIVE.get(r, SENSITIVE.get(r.rstrip("s"), 0.0)) for r in runs), default=0.0)


class Constant:
    """What a right-hand side stands for, as far as its weight needs it: length and
    character counts (in units of 2 ** scale), both ends, and where its literals are
    (its own place, or those of its parts, which constants share)."""

    __slots__ = ("n", "counts", "head", "last", "place", "parts", "scale", "told")

    def __init__(self, n: int, counts: Counter, head: str, last: str, place: tuple | None = None, parts: tuple = (),
                 scale: int = 0):
        self.n, self.counts, self.head, self.last = n, counts, head, last
        self.place, self.parts, self.scale, self.told = place, parts, scale, False

    @classmethod
    def of(cls, text: str, start: int, end: int, counts: Counter | None = None) -> Constant:
        counts = Counter(text[start:end]) if counts is None else counts
        return cls(end - start, counts, text[start:min(end, start + HEAD)], text[max(start, end - 1):end], (start, end))

    def __add__(self, other: Constant) -> Constant:
        if not self.n or not other.n:
            return self if self.n else other
        scale = max(self.scale, other.scale)
        counts = _scaled(self.counts, scale - self.scale) + _scaled(other.counts, scale - other.scale)
        n = sum(counts.values())
        if n.bit_length() > COUNT_BITS:
            counts, scale = _scaled(counts, COUNT_BITS // 2), scale + COUNT_BITS // 2
            n = sum(counts.values())
        head = self.head if len(self.head) == HEAD else (self.head + other.head)[:HEAD]
        return Constant(n, counts, head, other.last, None, (self, other), scale)

    def tell(self, out: set) -> None:
        """Add its places to ``out``; those told before are there already."""
        todo = [self]
        while todo:
            value = todo.pop()
            if not value.told:
                value.told = True
                if value.place:
                    out.add((*value.place, "lexed"))
                todo += value.parts


def _scaled(counts: Counter, bits: int) -> Counter:
    return Counter({c: max(1, k >> bits) for c, k in counts.items()}) if bits else counts


def literal_weight(value: Constant) -> float:
    """How much a literal looks like a secret: length, entropy, character classes."""
    n, counts = value.n, value.counts
    if n < 8 or any(c.isspace() for c in counts) or _is_placeholder(value):
        return 0.0
    entropy = -sum(c / n * math.log2(c / n) for c in counts.values())
    classes = sum(any(t(c) for c in counts) for t in (str.islower, str.isupper, str.isdigit, lambda c: not c.isalnum()))
    if classes == 1 and n < 20 and not all(c.isdigit() for c in counts):
        return 0.0  # a plain word
    return min(1.0, entropy / 3.5) * min(1.0, 0.4 + 0.2 * classes) * (1.0 if n >= 12 else n / 12)


def _is_placeholder(value: Constant) -> bool:
    """The pattern looks at both ends, at the whole of a short value, or for one sign alone."""
    ends = value.head if value.n <= HEAD else value.head + value.last
    if not _PLACEHOLDER.match(ends):
        return False
    return value.n <= HEAD or ends[0] not in "xX*." or len({c.lower() for c in value.counts}) == 1


def _targets(text: str) -> dict[int, list[str]]:
    """Where values start, and the names that hold each.

    A bare value may be a name or NAME=value itself: it is scanned again, so inner
    pairs count too.  ``a = b = value`` and ``a: type = value`` give a the value.
    """
    out: dict[int, list[str]] = {}
    chain: list[str] = []
    at = run = 0  # run: end of the bare run last met
    while m := _HEAD.search(text, at):
        start = m.start("quote")
        if start != at:
            chain = []
        name, value = m["name"], m.end()
        out.setdefault(value, []).append(name)
        inner = _HEAD.match(text, value)
        if m["sep"] == ":" and (typed := _TYPE.match(text, value)):
            out.setdefault(typed.end(), []).append(name)
            if not inner:
                value = typed.end()
        if m["sep"] in ("=", ":=") and inner:
            chain.append(name)  # one list: the last value of a chain is everybody's
        elif chain:
            out[m.end()] += chain
            chain = []
        at = value
        if not inner and value >= run:
            if first := _QUOTED.match(text, value):
                at = first.end()
            elif first := _BARE.match(text, value):
                run = first.end()
                if "=" not in first[0] and ":" not in first[0] and not _GOES_ON.match(text, run):
                    at = run
            if at > value:
                tail = _TAIL.match(text, at)
                last = tail["last"]
                at = tail.end()
                if last and last[0] not in "\"'" and _GOES_ON.match(text, at):
                    at = tail.start("last")
    for m in _KEY_VALUE.finditer(text):
        out.setdefault(m.start("value"), []).append(m["name"])
    return out


def lexed_spans(text: str) -> list[tuple[int, int, str]]:
    if not ("=" in text or ":" in text):
        return []
    low = text.lower().replace("_", "").replace(".", "").replace("-", "")
    if not any(s in low for s in _STEMS):
        return []
    known: dict[str, Constant] = {}
    out: set[tuple[int, int, str]] = set()
    run = _Run()
    for at, names in sorted(_targets(text).items()):
        value = _evaluate(text, at, known, run)
        if value is None:
            continue
        known.update(dict.fromkeys(names, value))
        weight = max(map(name_weight, names))
        if weight and weight * literal_weight(value) >= MIN_SCORE:
            value.tell(out)
    return list(out)


class _Run:
    """The bare run last met.  Values that start inside it share its end and what
    follows; their counts are what is left of its counts."""

    def __init__(self):
        self.at = self.end = self.stop = 0
        self.counts: Counter = Counter()
        self.tail = Constant.of("", 0, 0)

    def open(self, text: str, at: int, end: int, tail: Constant) -> None:
        self.at, self.end, self.tail = at, end, tail
        self.stop = at + len(text[at:end].rstrip(".:!?"))
        self.counts = Counter(text[at:self.stop])

    def rest(self, text: str, at: int) -> Constant:
        stop = max(at, self.stop)
        self.counts -= Counter(text[self.at:min(at, self.stop)])
        self.at = at
        return Constant.of(text, at, stop, self.counts.copy()) + self.tail


def _evaluate(text: str, at: int, known: dict, run: _Run) -> Constant | None:
    """The constant a right-hand side stands for, and where its literals are."""
    if at < run.end:
        return run.rest(text, at)
    first = _QUOTED.match(text, at) or _BARE.match(text, at)
    if first is None:
        return None
    end = first.end()
    tail = Constant.of("", 0, 0)
    for p in _PART.finditer(text, end, _TAIL.match(text, end).end()):
        tail += _part(text, p, known)
    if first[0][0] in "\"'" or first[0].strip("${}").rstrip(".") in known or first.re is _QUOTED:
        return _part(text, first, known) + tail
    run.open(text, at, end, tail)
    return run.rest(text, at)


def _part(text: str, p: re.Match, known: dict) -> Constant:
    if p[0][0] in "\"'":
        return Constant.of(text, p.start() + 1, p.end() - 1)
    name = p[0].strip("${}").rstrip(".")
    return known[name] if name in known else Constant.of(text, p.start(), p.start() + len(p[0].rstrip(".:!?")))


def scan(text: str | None) -> list[tuple[int, int, str]]:
    """All spans (start, end, kind), by start, then kind as in KINDS, then end."""
    text = text or ""
    base = base_spans(text)
    lexed = [s for s in lexed_spans(text) if s[0] < s[1]]
    if lexed and base:
        ends, starts, far = [], sorted(base), 0
        for _, b, _ in starts:
            ends.append(far := max(far, b))
        firsts = [a for a, _, _ in starts]
        lexed = [s for s in lexed if not (i := bisect_right(firsts, s[0])) or ends[i - 1] < s[1]]
    return sorted(base + lexed, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans array<struct<kind, start, end>>), one row per row, spans in
    order; a null or empty text has none.  Ids, nulls and repeats are carried."""
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def spans(texts: list) -> dict:
        rows = [[{"kind": k, "start": a, "end": b} for a, b, k in scan(t)] for t in texts]
        return {"spans": pa.array(rows, kind)}

    return map_texts(docs, spans, "spans array<struct<kind: string, start: bigint, end: bigint>>", id_col, text_col)


def redact(text: Column, mask: str = "[SECRET]") -> Column:
    """The text with every found span, overlapping ones as one, replaced by a mask."""

    @pandas_udf("string")
    def masked(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: _masked(t, mask), na_action="ignore")

    return masked(text)


def _masked(text: str, mask: str) -> str:
    out, at, end = [], 0, -1
    for a, b, _ in scan(text):
        if a >= end:
            out += [text[at:a], mask]
        end = max(end, b)
        at = end
    return "".join([*out, text[at:]]) if out else text


def digests(found: DataFrame) -> DataFrame:
    """Counts per base kind, the SHA-256 of the base spans and all spans as text."""
    def text_of(spans: Column) -> Column:
        return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))

    def of(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    base = F.filter("spans", lambda s: s["kind"] != "lexed")
    return found.select("doc_id", of("assign").alias("n_assign"), of("access").alias("n_access"), of("hex").alias("n_hex"),
                        F.sha2(text_of(base), 256).alias("base_sha256"), text_of(F.col("spans")).alias("spans"))
