"""Plain-Python versions of the corpus operators, for small inputs."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter, defaultdict

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def simhash(text, shingle=3):
    words = WORD.findall(lowered(text))
    if not words:
        return 0
    k = min(shingle, len(words))
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i:i + k]).encode(), 42) for i in range(len(words) - k + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(rows, distance=2):
    """id of each row -> smallest id reachable; rows are (id, text)."""
    prints = [simhash(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= distance:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    groups = defaultdict(list)
    for i, (doc, _) in enumerate(rows):
        groups[find(i)].append(doc)
    return [(rows[i][0], f"{prints[i]:016x}", min(groups[find(i)])) for i in range(len(rows))]


def key(line):
    return re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "", line)


def line_dedup(rows, ratio=0.01, min_pages=5):
    """Cleaned text of each row (host, text)."""
    pages = defaultdict(set)
    for host, text in rows:
        pages[host].add(text or "")
    often = {}
    for host, texts in pages.items():
        counts = Counter(k for t in texts for k in {key(x) for x in t.split("\n")} if k)
        often[host] = {k for k, n in counts.items() if n >= min_pages and n > ratio * len(texts)}
    return [None if t is None else "\n".join(x for x in t.split("\n") if key(x) not in often[h]) for h, t in rows]


def mix(rows, cap=3):
    """(doc_id, size, source_size, target, taken) of each row (doc_id, source, text)."""
    sizes = [len(WORD.findall(t or "")) for _, _, t in rows]
    total = Counter()
    for (_, s, _), n in zip(rows, sizes):
        total[s] += n
    names = sorted(total, key=lambda s: (s is None, s or ""))
    weight = {s: 1 + i % 3 for i, s in enumerate(names)}
    target, left, open_ = {}, float(sum(sizes)), set(names)
    while True:  # what capped sources cannot give is shared again by weight
        share = left / max(1, sum(weight[s] for s in open_)) if open_ else 0
        over = {s for s in open_ if share * weight[s] > cap * total[s]}
        if not over:
            target.update({s: share * weight[s] for s in open_})
            break
        for s in over:
            target[s] = float(cap * total[s])
            left -= target[s]
        open_ -= over

    def draw(doc, text):
        own = "#" + hashlib.md5((text or "").encode()).hexdigest() if doc is None else doc
        u = (int(hashlib.md5(f"mix:{own}".encode()).hexdigest()[:12], 16) + 0.5) / 2 ** 48
        dense = len(re.sub(r"[\x20\x09-\x0D]+", "", text or ""))
        marks = len(re.sub(r"[^#*$%&|<>!]+", "", text or ""))
        return -math.log(u) / max(0.05, ((dense - marks) / dense) ** 2 if dense else 0)
    taken = {}
    for s in names:
        own = sorted((draw(d, t), d is not None, d or 0, n, i) for i, ((d, x, t), n) in enumerate(zip(rows, sizes)) if x == s)
        epochs = int(target[s] // total[s]) if total[s] else 0
        rest, before = target[s] - epochs * total[s], 0
        for *_, n, i in own:
            taken[i] = n * min(cap, epochs + (before + n / 2 <= rest))
            before += n
    return [(d, n, total[s], target[s], taken[i]) for i, ((d, s, _), n) in enumerate(zip(rows, sizes))]


def repeats(text, window=5):
    words = WORD.findall(text or "")
    times = Counter(tuple(words[i:i + window]) for i in range(len(words) - window + 1))
    return len({j for i in range(len(words) - window + 1) if times[tuple(words[i:i + window])] > 1
                for j in range(i, i + window)})


def rank(seeds, edges, damping=0.85, rounds=60):
    """Personalised PageRank without dangling mass: {host: score}."""
    out = Counter()
    for (a, _), n in edges.items():
        out[a] += n
    score = {h: s * (1 - damping) for h, s in seeds.items()}
    for _ in range(rounds):
        new = Counter({h: s * (1 - damping) for h, s in seeds.items()})
        for (a, b), n in edges.items():
            new[b] += damping * score.get(a, 0) * n / out[a]
        score = dict(new)
    return score
