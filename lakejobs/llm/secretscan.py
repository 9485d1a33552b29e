"""Secrets: base patterns, and sliding-window entropy over candidate strings that adds to them.

The base patterns find assignments, access keys and long hexadecimal runs. Besides
these, every run of ``CANDIDATE`` characters is a candidate. A window of ``WINDOW``
characters slides over it; its counts per character change by one character in and
one out, and with them the sum that gives its Shannon entropy. Windows are judged by
the narrowest class of characters that holds them; those with the class's entropy or
more are joined to spans of kind ``entropy``. Candidates on the allow list are
suppressed, and spans that overlap a base span are left out.

Rows are judged one by one, whole texts and in time linear in their length, without
a shuffle; a lost task is run again.

Defined cases: a null or empty text has no spans. Null keys are kept. Repeated rows
give the same spans each time; an empty table gives no rows. Places are code points,
the end exclusive. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from math import log2

import pyarrow as pa
from pyspark.sql import DataFrame

KINDS = ["assign", "access", "hex"]
ADDED = "entropy"
# Without the ASCII flag, case folding would also take the long s and the Kelvin sign.
ASSIGN = re.compile(r"(?ai:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
WINDOW = 20

#: Least entropy of a window in bits, by class; a random window has about 0.3 more.
#: Digits alone are numbers, and never judged.
LEAST_BITS = {"hex": 3.0, "letters": 4.1, "mixed case": 3.85, "alphanumeric": 3.4, "base64": 3.85}

#: Candidates that are not secrets, whatever their entropy.
ALLOWED = [
    r"[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}",  # universally unique ids
    r"[+/_=-]*([A-Z]?[a-z]+|[A-Z]+|[0-9]+)([+/_=-]+([A-Z]?[a-z]+|[A-Z]+|[0-9]+))*[+/_=-]*",  # words, paths, dates
    r"sha(256|384|512)-[A-Za-z0-9+/]+={0,2}",  # hashes that pages publish for their scripts
    r".*(EXAMPLE|example|XXXX|xxxx).*",  # placeholders
]

Span = tuple[str, int, int]


@dataclass
class Rules:
    """What is judged a secret; the defaults are those of the registered query."""

    least_bits: dict[str, float] = field(default_factory=lambda: dict(LEAST_BITS))
    allowed: list[str] = field(default_factory=lambda: list(ALLOWED))
    window: int = WINDOW

    def suppresses(self, candidate: str) -> bool:
        if not hasattr(self, "_patterns"):
            self._patterns = [re.compile(x) for x in self.allowed]
        return any(x.fullmatch(candidate) for x in self._patterns) or _is_sequence(candidate)


def _is_sequence(candidate: str) -> bool:
    """Whether most characters follow their neighbour in code order, as in an alphabet."""
    steps = sum(abs(ord(b) - ord(a)) <= 1 for a, b in zip(candidate, candidate[1:]))
    return 2 * steps > len(candidate)


# Kinds of characters, by which a window's class is told.
DIGIT, LOW_HEX, LOW, UP_HEX, UP, SYMBOL = range(6)
CHARACTERS = {c: k for k, cs in enumerate(["0123456789", "abcdef", "ghijklmnopqrstuvwxyz", "ABCDEF", "GHIJKLMNOPQRSTUVWXYZ", "+/_=-"]) for c in cs}


def window_class(kinds: list[int]) -> str | None:
    """The narrowest class that holds a window with these counts per kind of character."""
    digits, low_hex, low, up_hex, up, symbols = kinds
    if symbols:
        return "base64"
    if not low_hex + low + up_hex + up:
        return None
    if not digits:
        return "mixed case" if low_hex + low and up_hex + up else "letters"
    if not (low or up) and not (low_hex and up_hex):
        return "hex"
    return "alphanumeric"


def high_windows(candidate: str, rules: Rules) -> Iterator[tuple[int, int]]:
    """The windows with their class's entropy, joined where they touch, as (start, end)."""
    w = rules.window
    # The entropy is log2(w) - weight / w, where weight sums c * log2(c) over the counts.
    cost = [0.0] + [c * log2(c) for c in range(1, w + 1)]
    counts: dict[str, int] = {}
    kinds = [0] * 6
    weight, open_at, end = 0.0, None, 0
    for i, c in enumerate(candidate):
        n = counts.get(c, 0)
        counts[c] = n + 1
        kinds[CHARACTERS[c]] += 1
        if i >= w:
            old = candidate[i - w]
            weight += cost[counts[c]] - cost[n] if n < w else 0.0
            m = counts[old]
            counts[old] = m - 1
            weight += cost[m - 1] - cost[m] if m <= w else 0.0
            kinds[CHARACTERS[old]] -= 1
        else:
            weight += cost[n + 1] - cost[n]
        if i >= w - 1:
            name = window_class(kinds)
            if name and log2(w) - weight / w >= rules.least_bits[name] - 1e-9:
                start = i - w + 1
                if open_at is None or start > end:
                    if open_at is not None:
                        yield open_at, end
                    open_at = start
                end = i + 1
    if open_at is not None:
        yield open_at, end


def base_spans(text: str) -> list[Span]:
    """(kind, start, end) by place, then kind; matches that fail their test are dropped."""
    out = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[1]) >= 6]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    out += [("hex", *m.span()) for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def added_spans(text: str, base: list[Span], rules: Rules) -> list[Span]:
    """The spans of high entropy that overlap no base span."""
    taken = sorted((start, end) for _, start, end in base)
    out, k, reach = [], 0, 0
    for m in CANDIDATE.finditer(text):
        if rules.suppresses(m[0]):
            continue
        for start, end in high_windows(m[0], rules):
            start, end = m.start() + start, m.start() + end
            # Base spans in order: those that begin before the end, and how far they reach.
            while k < len(taken) and taken[k][0] < end:
                reach = max(reach, taken[k][1])
                k += 1
            if reach <= start:
                out.append((ADDED, start, end))
    return out


def all_spans(text: str, rules: Rules) -> tuple[list[Span], list[Span]]:
    """(base spans, all spans), each by place, then kind."""
    base = base_spans(text)
    order = {kind: i for i, kind in enumerate([*KINDS, ADDED])}
    return base, sorted(base + added_spans(text, base, rules), key=lambda s: (s[1], order[s[0]]))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


def find(docs: DataFrame, key: str = "doc_id", text: str = "text", rules: Rules | None = None) -> DataFrame:
    """(key, n_assign, n_access, n_hex, n_entropy, base_sha256, spans) of every row."""
    rules = rules or Rules()
    kinds = [*KINDS, ADDED]
    names = ["key", *[f"n_{kind}" for kind in kinds], "base_sha256", "spans"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: list[list[int]] = [[] for _ in kinds]
            hashes, shown = [], []
            for value in batch.column("text"):
                base, every = all_spans(value.as_py() or "", rules)
                for c, kind in zip(counts, kinds):
                    c.append(sum(s[0] == kind for s in every))
                hashes.append(hashlib.sha256(joined(base).encode()).hexdigest())
                shown.append(joined(every))
            columns = [batch.column("key"), *[pa.array(c, pa.int64()) for c in counts], pa.array(hashes, pa.string()), pa.array(shown, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names)

    rows = docs.select(docs[key].cast("long").alias("key"), docs[text].alias("text"))
    return rows.mapInArrow(run, ", ".join(["key long", *[f"n_{kind} long" for kind in kinds], "base_sha256 string, spans string"]))
