"""Plain Python versions of the operators, for small tables."""

import hashlib
import math
import re
import string
from collections import Counter, defaultdict

SPACE = re.compile(r"[\x20\x09-\x0D]+")
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def words(text):
    return [w for w in SPACE.split(text or "") if w]


class Groups:
    """Union-find whose label is the smallest member."""

    def __init__(self, members):
        self.of = {m: m for m in members}

    def find(self, x):
        while self.of[x] != x:
            x = self.of[x]
        return x

    def link(self, a, b):
        a, b = self.find(a), self.find(b)
        self.of[max(a, b)] = min(a, b)


def shingle_set(text, width):
    w = words((text or "").translate(LOWER))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1)))


def near_groups(docs, width, percent):
    """{id: (set size, smallest linked id)} by comparing every pair that shares a shingle."""
    sets = {k: shingle_set(t, width) for k, t in docs}
    groups, by_shingle = Groups(sets), defaultdict(list)
    for k, s in sets.items():
        shared = Counter(o for x in s for o in by_shingle[x])
        for o, n in shared.items():
            if 100 * n >= percent * (len(s) + len(sets[o]) - n):
                groups.link(k, o)
        for x in s:
            by_shingle[x].append(k)
    return {k: (len(s), groups.find(k)) for k, s in sets.items()}


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def line_removals(docs, most, least):
    """{id: numbers of removed lines} by comparing all pairs of distinct lines."""
    places = defaultdict(list)
    for k, text in docs:
        for no, line in enumerate((text or "").split("\n")):
            if len(line) >= least and k is not None:
                places[line].append((k, no))
    lines = sorted(places, key=len)
    groups, letters = Groups(lines), {x: Counter(x) for x in lines}
    for i, a in enumerate(lines):
        for b in lines[i + 1 :]:
            if len(b) - len(a) > most:
                break
            if sum(((letters[a] - letters[b]) + (letters[b] - letters[a])).values()) <= 2 * most and edits(a, b) <= most:
                groups.link(a, b)
    classes = defaultdict(list)
    for line in lines:
        classes[groups.find(line)] += places[line]
    out = defaultdict(set)
    for where in classes.values():
        for k, no in set(where) - {min(where)}:
            out[k].add(no)
    return out


def without_lines(docs, most, least):
    """[(id, text)] after line dedup; texts that lose all their words go."""
    gone, out = line_removals(docs, most, least), []
    for k, text in docs:
        left = "\n".join(x for no, x in enumerate((text or "").split("\n")) if no not in gone[k])
        if not gone[k]:
            out.append((k, text))
        elif left.strip(" \n"):
            out.append((k, left))
    return out


def best_match(pattern, text):
    """Fewest edits between the pattern and any part of the text."""
    row = [0] * (len(text) + 1)
    for i, x in enumerate(pattern, 1):
        last, row = row, [i]
        for j, y in enumerate(text, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return min(row)


def mixture(rows, cycle, share=1.5, most=2):
    """{id: (size, source size, target, taken)} of (id, text, source) rows."""
    size = {k: len(words(t)) for k, t, _ in rows}
    by_source = defaultdict(list)
    for k, _, s in rows:
        by_source[s].append(k)
    order = sorted(by_source, key=lambda s: (s is None, s or ""))
    weight = {s: float(cycle[i % len(cycle)]) for i, s in enumerate(order)}
    total = {s: sum(size[k] for k in by_source[s]) for s in order}
    target, active, left = {}, set(order), share * sum(total.values())
    while active:
        level = left / sum(weight[s] for s in active)
        over = [s for s in active if level * weight[s] > most * total[s]]
        if not over:
            target.update({s: level * weight[s] for s in active})
            break
        for s in over:
            target[s] = float(most * total[s])
            active.discard(s)
            left -= target[s]
    out = {}
    for s in order:
        whole = math.floor(target[s] / total[s]) if total[s] else 0
        rest, seen = target[s] - whole * total[s], 0
        for k in sorted(by_source[s], key=lambda k: (hashlib.md5(f"mix:{'' if k is None else k}".encode()).hexdigest(), size[k])):
            more = seen + size[k] / 2 < rest
            seen += size[k]
            out[k] = (size[k], total[s], target[s], size[k] * (whole + more))
    return out
