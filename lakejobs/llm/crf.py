"""A skip-chain conditional random field over the tokens of one text that may be personal data.

Tokens with a digit, an ``@`` or a ``+`` are variables; all others are taken to be
outside. Neighbouring variables share chain potentials. Tokens that are repeated,
or alike (same digits at the end, same name before the ``@``), share skip
potentials, by which evidence for one reaches the others, wherever they stand.
Weights come from pseudo-likelihood, marginals from loopy belief propagation.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np

KINDS = ["email", "ip", "card", "phone"]
LABELS = ["outside", *KINDS, "secret"]
SECRET = re.compile(r"(?i)\b(?:token|secret|password|passwd|api[_-]?key)\b[\x20\t]*[:=][\x20\t]*[\"']?([A-Za-z0-9_-]{16,})")
ACTIVE = re.compile(r"[0-9@+]+")
EDGE = " \t\n\r\x0b\x0c"
PUNCTUATION = "\"'!?.,;:()[]{}<>|#*$%&="
CERTAIN = 30.0
ROUNDS = 12
#: A feature must come this often in the sample to get a weight.
MIN_COUNT = 5


@dataclass
class Token:
    start: int
    end: int
    text: str
    #: Whether the token before it, or after it, is a variable too.
    joined: bool = False
    features: list[str] = field(default_factory=list)
    label: int = 0


def luhn(digits: str) -> bool:
    twice = [2 * int(c) - 9 * (c > "4") for c in digits[-2::-2]]
    return (sum(map(int, digits[-1::-2])) + sum(twice)) % 10 == 0


def tokens(text: str) -> list[Token]:
    """The variables of a text, in order, with their features."""
    out: list[Token] = []
    last = 0
    for m in ACTIVE.finditer(text):
        if m.start() < last:
            continue
        # Not before the end of the last token, so that the text is walked once.
        start = max(last, max(text.rfind(c, last, m.start()) for c in EDGE) + 1)
        stop = m.end()
        while stop < len(text) and text[stop] not in EDGE:
            stop += 1
        joined = bool(out) and not text[last:start].strip()
        last = stop
        core = text[start:stop]
        left = len(core) - len(core.lstrip(PUNCTUATION))
        core = core.strip(PUNCTUATION)
        token = Token(start + left, start + left + len(core), core, joined)
        before = text[max(0, start - 40) : start].split()[-2:]
        token.features = _features(core, before)
        if core:
            out.append(token)
    return out


def _features(core: str, before: list[str]) -> list[str]:
    shape = re.sub(r"[0-9]+", lambda m: f"d{min(len(m[0]), 20)}", re.sub(r"[^\W\d_]+", "a", core))
    out = ["bias", f"shape={shape[:40]}", f"length={min(len(core) // 4, 12)}"]
    digits = re.sub(r"[^0-9]", "", core)
    if len(core) >= 16 and re.fullmatch(r"[0-9A-Fa-f]+", core) and digits != core:
        out = ["bias", "shape=hex", f"length={min(len(core) // 4, 12)}"]
    if 13 <= len(digits) <= 19:
        out.append(f"luhn={luhn(digits)}")
    if re.fullmatch(r"[0-9]+(\.[0-9]+){3}", core):
        out.append(f"octets={all(len(x) < 4 and int(x) < 256 for x in core.split('.'))}")
    if "@" in core:
        out.append("at")
    return out + [f"before={x.lower().strip(PUNCTUATION) or x}" for x in before]


def skips(found: list[Token]) -> list[tuple[int, int]]:
    """Edges between a token and the last one that is the same or alike."""
    last: dict[tuple, int] = {}
    edges = set()
    for i, t in enumerate(found):
        digits = re.sub(r"[^0-9]", "", t.text)
        keys = [("same", t.text.lower())] if len(t.text) > 3 else []
        if len(digits) >= 7:
            keys.append(("digits", digits[-7:]))
        name = t.text.partition("@")[0].lower()
        if len(name) > 3 and not name.isdigit():
            keys.append(("name", name))
        for key in keys:
            if key in last:
                edges.add((last[key], i))
            last[key] = i
    return sorted(edges)


@dataclass
class Model:
    """Weights by feature, and potentials of chain and skip edges."""

    weights: dict[str, np.ndarray]
    chain: np.ndarray
    skip: np.ndarray
    alone_left: np.ndarray
    alone_right: np.ndarray

    def marginals(self, found: list[Token], certain: dict[int, int]) -> np.ndarray:
        """Label probabilities per token; ``certain`` tokens keep the label given."""
        n, k = len(found), len(LABELS)
        unary = np.zeros((n, k))
        edges, kinds = [], []
        for i, t in enumerate(found):
            for f in t.features:
                if f in self.weights:
                    unary[i] += self.weights[f]
            if i and t.joined:
                edges.append((i - 1, i))
                kinds.append(self.chain)
            else:
                unary[i] += self.alone_left
            if i + 1 == n or not found[i + 1].joined:
                unary[i] += self.alone_right
        for i, label in certain.items():
            unary[i] = 0.0
            unary[i, label] = CERTAIN
        for a, b in skips(found):
            edges.append((a, b))
            kinds.append(self.skip)
        belief = unary
        if edges:
            one = np.array(edges)
            source, target = np.r_[one[:, 0], one[:, 1]], np.r_[one[:, 1], one[:, 0]]
            table = np.stack(kinds + [x.T for x in kinds])
            back = np.r_[np.arange(len(edges), 2 * len(edges)), np.arange(len(edges))]
            message = np.zeros((2 * len(edges), k))
            for _ in range(ROUNDS):
                belief = unary.copy()
                np.add.at(belief, target, message)
                given = (belief[source] - message[back])[:, :, None] + table
                top = given.max(axis=1)
                new = top + np.log(np.exp(given - top[:, None, :]).sum(axis=1))
                message = 0.5 * message + 0.5 * (new - new.max(axis=1, keepdims=True))
            belief = unary.copy()
            np.add.at(belief, target, message)
        p = np.exp(belief - belief.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)


def train(texts: list[list[Token]], rounds: int = 300, rate: float = 0.5, ridge: float = 1e-4) -> Model:
    """Weights by gradient ascent on the pseudo-likelihood of labelled tokens."""
    k = len(LABELS)
    rows, labels = [], []
    for found in texts:
        near: dict[int, list[str]] = {i: [] for i in range(len(found))}
        for a, b in skips(found):
            near[a].append(f"skip={found[b].label}")
            near[b].append(f"skip={found[a].label}")
        for i, t in enumerate(found):
            left = f"left={found[i - 1].label}" if i and t.joined else "left=none"
            right = f"right={found[i + 1].label}" if i + 1 < len(found) and found[i + 1].joined else "right=none"
            rows.append([*t.features, left, right, *near[i]])
            labels.append(t.label)
    counts: dict[str, int] = {}
    for row in rows:
        for f in row:
            counts[f] = counts.get(f, 0) + 1
    names = sorted(f for f, c in counts.items() if c >= MIN_COUNT)
    place = {f: j for j, f in enumerate(names)}
    w = np.zeros((len(names), k))
    if names:
        pairs = np.array([(i, place[f]) for i, row in enumerate(rows) for f in row if f in place])
        truth = np.eye(k)[labels]
        size = np.bincount(pairs[:, 1], minlength=len(names))[:, None]
        for _ in range(rounds):
            score = np.zeros((len(rows), k))
            np.add.at(score, pairs[:, 0], w[pairs[:, 1]])
            p = np.exp(score - score.max(axis=1, keepdims=True))
            off = truth - p / p.sum(axis=1, keepdims=True)
            step = np.zeros_like(w)
            np.add.at(step, pairs[:, 1], off[pairs[:, 0]])
            # Each feature follows its mean error, so that rare ones learn too.
            w += rate * (step / size - ridge * w)
    get = lambda f: w[place[f]] if f in place else np.zeros(k)
    left, right = np.stack([get(f"left={i}") for i in range(k)]), np.stack([get(f"right={i}") for i in range(k)])
    skip = np.stack([get(f"skip={i}") for i in range(k)])
    own = {f: w[j] for f, j in place.items() if not f.startswith(("left=", "right=", "skip="))}
    return Model(own, (left + right.T) / 2, (skip + skip.T) / 2, get("left=none"), get("right=none"))
