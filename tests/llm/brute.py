"""Plain versions of the corpus operators, for small tables."""

from __future__ import annotations

import collections
import hashlib
import re

WORD = re.compile("[^\x20\x09-\x0d]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


class Union(dict):
    def find(self, x):
        self.setdefault(x, x)
        while self[x] != x:
            x = self[x]
        return x

    def link(self, a, b):
        a, b = self.find(a), self.find(b)
        self[max(a, b)] = min(a, b)


def words(text):
    return WORD.findall(text or "")


def similar_pairs(sets, per_mille):
    """Pairs of ids of similar sets, by an inverted index."""
    owners = collections.defaultdict(list)
    for i, s in sets.items():
        for x in s:
            owners[x].append(i)
    inter = collections.Counter()
    for held in owners.values():
        held.sort()
        for k, a in enumerate(held):
            for b in held[k + 1 :]:
                inter[a, b] += 1
    return [(a, b) for (a, b), n in inter.items() if 1000 * n >= per_mille * (len(sets[a]) + len(sets[b]) - n)]


def shingles(text):
    w = words((text or "").translate(LOWER))
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def near_components(docs):
    """{doc_id: (n_shingles, component)} of {doc_id: text}."""
    sets = {i: shingles(t) for i, t in docs.items()}
    groups = Union()
    for a, b in similar_pairs(sets, 750):
        groups.link(a, b)
    return {i: (len(s), groups.find(i)) for i, s in sets.items()}


def removed_windows(docs, width=20):
    """{doc_id: (n_words, n_removed, sha256)} of {doc_id: text}."""
    seen, out = set(), {}
    for i in sorted(docs):
        w = words(docs[i])
        gone = [False] * len(w)
        for k in range(len(w) - width + 1):
            x = tuple(w[k : k + width])
            if x in seen:
                gone[k : k + width] = [True] * width
            seen.add(x)
        kept = " ".join(a for a, g in zip(w, gone, strict=True) if not g)
        out[i] = len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()
    return out


def removed_lines(docs, width=5, per_mille=800):
    """{doc_id: numbers of the lines to take out}."""
    places, known = [], {}
    for i in sorted(docs):
        for k, line in enumerate((docs[i] or "").split("\n")):
            line = line.strip(" \t\n\r\x0b\x0c").translate(LOWER)
            if line:
                places.append((i, k, known.setdefault(line, len(known))))
    sets = {n: frozenset(line[j : j + width] for j in range(max(1, len(line) - width + 1))) for line, n in known.items()}
    groups = Union()
    for a, b in similar_pairs(sets, per_mille):
        groups.link(a, b)
    first, out = set(), {i: [] for i in docs}
    for i, k, n in places:
        if (g := groups.find(n)) in first:
            out[i].append(k)
        first.add(g)
    return out


def base_counts(text):
    text = text or ""
    w = words(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    at = collections.defaultdict(list)
    for k in range(len(w) - 7):
        at[tuple(w[k : k + 8])].append(k)
    covered = {p for v in at.values() if len(v) > 1 for k in v for p in range(k, k + 8)}
    failed = len(w) < 20 or 100 * len(covered) > 30 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), failed


def edit_distance_within(pattern, text):
    """Least edit distance of pattern to any part of text."""
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        last, row = row, [i] + [0] * len(text)
        for j, c in enumerate(text, 1):
            row[j] = min(last[j - 1] + (p != c), last[j] + 1, row[j - 1] + 1)
    return min(row)
