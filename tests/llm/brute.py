"""Plain single-machine versions of the corpus operators, used as expected results."""

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import xxhash


def simhash(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(prints, radius=2):
    """Index of the first member by position for every fingerprint, all pairs compared."""
    values = np.array(prints, np.uint64)
    parent = list(range(len(values)))

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i in range(len(values)):
        for j in np.flatnonzero(np.bitwise_count(values[i + 1 :] ^ values[i]) <= radius):
            a, b = root(i), root(i + 1 + int(j))
            parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(values))]


def similar_classes(texts, k=5):
    """Index of the first member by position for every text: classes linked by k-word shingle sets alike by 0.8 or more."""
    split = [(t or "").lower().split() for t in texts]
    sets = [{tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set() for w in split]
    root = list(range(len(texts)))
    for j, b in enumerate(sets):
        for i, a in enumerate(sets[:j]):
            if 10 * len(a & b) >= 8 * len(a | b):
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    return root


def line_key(line):
    return re.sub("[A-Z]", lambda m: m.group().lower(), line.strip(" \t\n\x0b\x0c\r"))


def line_dedup(docs):
    """docs: [(doc_id, text)] with distinct ids -> {doc_id: (n_lines, n_dropped, kept text)}."""
    holders = defaultdict(set)
    for doc_id, text in docs:
        for line in (text or "").split("\n"):
            if len(line_key(line)) >= 40:
                holders[line_key(line)].add(doc_id)
    keeper = {k: max(ids) for k, ids in holders.items() if len(ids) >= 5}
    out = {}
    for doc_id, text in docs:
        lines = (text or "").split("\n")
        kept = [x for x in lines if keeper.get(line_key(x), doc_id) == doc_id]
        out[doc_id] = (len(lines), len(lines) - len(kept), "\n".join(kept))
    return out


def edited(docs):
    """[(doc_id, text)] with distinct ids -> {doc_id: (text, edited text, next text)}."""
    order = sorted(docs, key=lambda d: -d[0])
    out = {}
    for i, (doc_id, text) in enumerate(order):
        text, after = text or "", order[(i + 1) % len(order)][1] or ""
        third = len(text) // 3
        out[doc_id] = (text, text[: len(text) - third] + after[:third], after)
    return out


def overlap_likeness(a, b):
    longer, shorter = max(len(a), len(b)), min(len(a), len(b))
    if not longer:
        return 1.0
    head = next((i for i in range(shorter) if a[i] != b[i]), shorter)
    tail = next((i for i in range(shorter) if a[-1 - i] != b[-1 - i]), shorter)
    return min(head + tail, shorter) / longer


def rendezvous(doc_id, shards):
    import math

    first = xxhash.xxh64_intdigest(int(doc_id).to_bytes(8, "little", signed=True), 42)
    draws = []
    for s in range(shards):
        bits = xxhash.xxh64_intdigest(int(s).to_bytes(4, "little"), first) >> 11
        draws.append((-1.0 / math.log((float(bits) + 0.5) / 2.0**53), -s))
    return -max(draws)[1]


def sha256(text):
    return hashlib.sha256(text.encode()).hexdigest()


def crc32(data):
    return zlib.crc32(data)


