"""Plain Python versions of the text operators, for comparison on small tables."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def repeats(rows, length=13):
    """id -> (n_words, n_removed, kept text) for rows (id, text) of distinct ids."""
    said = {i: words(t) for i, t in rows}
    first = {}
    for i, ws in said.items():
        for p in range(len(ws) - length + 1):
            passage = tuple(ws[p : p + length])
            first[passage] = min(first.get(passage, i), i)
    out = {}
    for i, ws in said.items():
        gone = set()
        for p in range(len(ws) - length + 1):
            if first[tuple(ws[p : p + length])] < i:
                gone.update(range(p, p + length))
        kept = [w for p, w in enumerate(ws) if p not in gone]
        out[i] = (len(ws), len(gone), " ".join(kept))
    return out


def similar(rows, n=5, threshold=0.8):
    """id -> (class_id, copy_of, n_links) by comparing all pairs that share an n-gram."""
    classes = defaultdict(list)
    for i, text in rows:
        classes[tuple(words(text))].append(i)
    texts = list(classes)
    sets = [set(zip(*[w[k:] for k in range(n)])) or ({w} if w else set()) for w in texts]
    index = defaultdict(list)
    for k, found in enumerate(sets):
        for gram in found:
            index[gram].append(k)
    common = Counter((a, b) for ks in index.values() for i, b in enumerate(ks) for a in ks[:i])
    parent = list(range(len(texts)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    links = [len(classes[w]) - 1 for w in texts]
    for (a, b), c in common.items():
        if c / (len(sets[a]) + len(sets[b]) - c) >= threshold - 1e-12:
            links[a] += len(classes[texts[b]])
            links[b] += len(classes[texts[a]])
            parent[root(a)] = root(b)
    least = {}
    for k, w in enumerate(texts):
        least[root(k)] = min(least.get(root(k), min(classes[w])), min(classes[w]))
    return {
        i: (least[root(k)], min(classes[w]), links[k])
        for k, w in enumerate(texts)
        for i in classes[w]
    }


def normal(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def copies(rows):
    """id -> (keep_id, group_size) for rows (id, text) of distinct ids."""
    groups = defaultdict(list)
    for i, text in rows:
        groups[normal(text)].append(i)
    return {i: (min(ids), len(ids)) for ids in groups.values() for i in ids}


def winnowed(text, piece=12, gram=4, window=8):
    """(hash, position) by trying every window; hashes as unsigned numbers."""
    mask = (1 << 64) - 1

    def turned(x, by):
        return ((x << by) | (x >> (64 - by))) & mask

    pieces = re.findall(r"[^\x20\x09-\x0D]{1,%d}" % piece, text or "")
    if not pieces:
        return []
    hashes = [xxhash.xxh64_intdigest(p.encode(), seed=42) for p in pieces]
    if len(pieces) < gram:
        grams = [xxhash.xxh64_intdigest(" ".join(pieces).encode(), seed=42)]
    else:
        grams = []
        for i in range(len(pieces) - gram + 1):
            value = 0
            for h in hashes[i : i + gram]:
                value = turned(value, 1) ^ h
            grams.append(value)
    chosen = []
    for i in range(max(1, len(grams) - window + 1)):
        inside = range(i, min(i + window, len(grams)))
        best = min(inside, key=lambda p: (grams[p] >> 32, -p))
        if best not in chosen:
            chosen.append(best)
    return [(grams[p], p) for p in chosen]
