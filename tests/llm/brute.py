"""Plain single-machine versions of the operators' contracts, for small fixtures."""

from __future__ import annotations

import re
from collections import defaultdict

SPACE_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def group(nodes, links):
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    return {n: root(n) for n in nodes}


def shingles(text, size):
    words = SPACE_WORD.findall(lower(text))
    if not words:
        return frozenset()
    if len(words) < size:
        return frozenset([tuple(words)])
    return frozenset(tuple(words[i : i + size]) for i in range(len(words) - size + 1))


def near_duplicates(docs, size, percent=80):
    sets = {i: shingles(t, size) for i, t in docs}
    by_shingle = defaultdict(set)
    for i, own in sets.items():
        for s in own:
            by_shingle[s].add(i)
    seen, links = set(), []
    for ids in by_shingle.values():
        for a in ids:
            for b in ids:
                if a < b and (a, b) not in seen:
                    seen.add((a, b))
                    common = len(sets[a] & sets[b])
                    if 100 * common >= percent * len(sets[a] | sets[b]):
                        links.append((a, b))
    found = group(sets, links)
    return {i: (len(sets[i]), found[i], found[i] == i) for i in sets}


ITEM_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def contamination(docs, items, window=10):
    windows = set()
    for i, text in items:
        words = ITEM_WORD.findall(lower(text))
        if words:
            size = min(window, len(words))
            windows |= {
                (tuple(words[p : p + size]), str(i)) for p in range(len(words) - size + 1)
            }
    found = []
    for i, text in docs:
        words, hit, ids = ITEM_WORD.findall(lower(text)), set(), set()
        for own, item in windows:
            for p in range(len(words) - len(own) + 1):
                if tuple(words[p : p + len(own)]) == own:
                    hit |= set(range(p, p + len(own)))
                    ids.add(item)
        found.append((i, len(words), len(hit), sorted(ids)))
    return found


def repeated_spans(docs, size):
    """Per row (doc_id, bytes, removed, spans, kept bytes)."""
    places = defaultdict(int)
    texts = [(i, (t or "").encode()) for i, t in docs]
    for _, t in texts:
        for p in range(len(t) - size + 1):
            places[t[p : p + size]] += 1
    found = []
    for i, t in texts:
        gone = bytearray(len(t))
        for p in range(len(t) - size + 1):
            if places[t[p : p + size]] > 1:
                gone[p : p + size] = b"\1" * size
        kept = bytes(b for b, g in zip(t, gone) if not g)
        spans = sum(g and not (p and gone[p - 1]) for p, g in enumerate(gone))
        found.append((i, len(t), sum(gone), spans, kept))
    return found


def line_components(docs, width, percent=80):
    """{(doc_id, line number): first line of its component}, for texts with distinct ids."""
    sets, where = {}, {}
    for i, text in docs:
        if text is None:
            continue
        for n, raw in enumerate(text.split("\n")):
            line = raw.strip(" \t\r").encode()
            where[i, n] = line
            if line:
                sets[line] = {line[p : p + width] for p in range(max(1, len(line) - width + 1))}
    lines = sorted(sets)
    links = [
        (a, b)
        for k, a in enumerate(lines)
        for b in lines[k + 1 :]
        if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])
    ]
    root = group(lines, links)
    first = {}
    for place in sorted(where):
        if where[place]:
            first.setdefault(root[where[place]], place)
    return {p: first[root[line]] if line else p for p, line in where.items()}
