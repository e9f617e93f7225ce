"""Secret scan with multipart credential linking."""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The base patterns, in the order of their kinds.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # runs are maximal, so shorter ones can be left out at once
ASSIGN_LEAST, ACCESS_LEAST = 6, 20
KINDS = ("assign", "access", "hex", "identifier", "weak", "endpoint")

# The parts that are reported only together.
IDENTIFIER = re.compile(r"""(?<![A-Za-z0-9])(?:access_?key_?id|client_?id|account_?id|user_?name|user|login)["']?\x20*[:=]\x20*["']?([A-Za-z0-9@._+-]{3,})""", re.A | re.I)
IDENTIFIER_HINTS = ("client", "user", "login", "account", "access")
WEAK = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}={0,2}", re.A)
TARGET = re.compile(r"""[^\s"'<>]{4,}""", re.A)
ASSIGN_HINTS = ("password", "passwd", "secret", "token", "apikey", "api_key")
BREAK = re.compile(r"\n[\x20\t\r]*\n")

Span = tuple[int, int, int]  # kind's place in KINDS, start, end


def base_spans(text: str, low: str) -> list[Span]:
    """Spans of the base kinds; ``low`` is the text in lower case, to skip what cannot match."""
    out: list[Span] = []
    if any(h in low for h in ASSIGN_HINTS):
        out += [(0, m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if "AKIA" in text:
        out += [(1, m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    out += [(2, m.start(), m.end()) for m in HEX.finditer(text)]
    return out


def entropy(s: str) -> float:
    """Bits per character."""
    return -sum(n / len(s) * math.log2(n / len(s)) for n in Counter(s).values())


def looks_random(s: str) -> bool:
    """A string that words do not look like: digits among letters of both cases or many digits, and a high entropy."""
    digits = sum(c.isdigit() for c in s)
    letters = sum(c.isalpha() for c in s)
    return digits >= 2 and letters >= 2 and entropy(s) >= 3.25


def endpoints(text: str) -> list[Span]:
    """Endpoints: every ``://`` with something behind it, back to the first letter of the scheme before it."""
    out: list[Span] = []
    at, free = text.find("://"), 0
    while at >= 0:
        first = start = at
        while start > free and (c := text[start - 1]).isascii() and (c.isalnum() or c in "+.-"):
            start -= 1
            if c.isalpha():
                first = start
        m = TARGET.match(text, at + 3) if first < at else None
        if m:
            out.append((5, first, m.end()))
            free = m.end()
        at = text.find("://", free if m else at + 1)
    return out


def furthest(spans: list[Span], scopes: list[int]) -> list[int]:
    """For spans by start, the largest end so far within each one's scope."""
    out: list[int] = []
    for i, s in enumerate(spans):
        out.append(max(s[2], out[-1]) if i and scopes[i] == scopes[i - 1] else s[2])
    return out


def beside(parts: list[Span], others: list[Span], reach: int, breaks: list[int]) -> list[Span]:
    """The parts that have one of ``others`` within ``reach`` in their own scope; scopes end where ``breaks`` are."""
    others = sorted(others, key=lambda s: s[1])
    starts, scopes = [o[1] for o in others], [bisect_right(breaks, o[1]) for o in others]
    ends = furthest(others, scopes)
    out = []
    for p in parts:
        own = bisect_right(breaks, p[1])
        # The last of the others in the scope that starts early enough: the largest end up to there decides.
        i = min(bisect_right(starts, p[2] + reach), bisect_right(scopes, own)) - 1
        if i >= 0 and scopes[i] == own and ends[i] >= p[1] - reach:
            out.append(p)
    return out


def linked_spans(text: str, low: str, base: list[Span], reach: int = 200) -> list[Span]:
    """Weak parts with a complement in reach: an identifier or endpoint beside a secret, a weak secret beside either.

    A scope is a stretch without a blank line. Intervals are joined by binary search over sorted starts and running
    maxima of ends, so a text of many or long parts costs its length times a logarithm, and no list of pairs is made.
    """
    names: list[Span] = []
    if any(h in low for h in IDENTIFIER_HINTS):
        names = [(3, m.start(), m.end()) for m in IDENTIFIER.finditer(text)]
    ends = endpoints(text) if "://" in text else []
    access = [s for s in base if s[0] == 1]
    if not (names or ends or access):
        return []
    taken = sorted(base + names + ends, key=lambda s: s[1])
    begins, upto = [t[1] for t in taken], furthest(taken, [0] * len(taken))

    def free(a: int, b: int) -> bool:
        i = bisect_left(begins, b) - 1
        return i < 0 or upto[i] <= a

    weak = [(4, m.start(), m.end()) for m in WEAK.finditer(text) if looks_random(m[0]) and free(m.start(), m.end())]
    breaks = [m.start() for m in BREAK.finditer(text)]
    secrets = [s for s in base if s[0] != 1] + weak
    return beside(names + ends, secrets, reach, breaks) + beside(weak, names + ends + access, reach, breaks)


def spelled(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (s[1], s[0], s[2])))


SCANNED = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def _scanner(reach: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py() or ""
                low = text.lower()
                base = base_spans(text, low)
                kinds = Counter(s[0] for s in base)
                digest = hashlib.sha256(spelled(base).encode()).hexdigest()
                rows.append((doc_id, kinds[0], kinds[1], kinds[2], digest, spelled(base + linked_spans(text, low, base, reach))))
            cols = list(zip(*rows, strict=True)) or [()] * 6
            types = [pa.int64()] * 4 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types, strict=True)], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return run


def scan_secrets(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", reach: int = 200) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans), one row for each row of ``docs``.

    Base kinds (assign, access, hex) are reported wherever they match. Identifiers, endpoints and random-looking
    strings are reported only where complementary parts lie within ``reach`` code points and no blank line is between.
    Spans are kind:start:end in code points, end exclusive, by start and then kind.

    A null text is an empty one; ids may be null or repeat, and repeated rows are repeated; an empty table gives an empty
    table; other columns are not read. Very long texts, tokens and urls are scanned whole, one text at a time, in time
    about proportional to their length: no shuffle, and memory for a batch of texts. Spans that start together come by
    kind.
    """
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_scanner(reach), SCANNED)
