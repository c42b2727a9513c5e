"""Jaccard components by inverted lists over plain Python sets."""

import re
from collections import Counter, defaultdict


def shingle_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return frozenset()
    if len(words) < 5:
        return frozenset([tuple(words)])
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def components(rows):
    """{doc_id: (n_shingles, component_id)} of (doc_id, text) rows."""
    sets = {d: shingle_set(t) for d, t in rows}
    where = defaultdict(list)
    for d, s in sets.items():
        for x in s:
            where[x].append(d)
    parent = {d: d for d in sets}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for d, s in sets.items():
        common = Counter(e for x in s for e in where[x] if e < d)
        for e, n in common.items():
            if 100 * n >= 75 * (len(s) + len(sets[e]) - n):
                a, b = sorted((top(d), top(e)))
                parent[b] = a
    return {d: (len(sets[d]), top(d)) for d in sets}
