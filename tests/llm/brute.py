"""Plain Python versions of the contracts, for small tables."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(FOLD))


def shingle_set(text, k):
    w = words(text)
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1)))


def components(nodes, links):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            root[n] = root[root[n]]
            n = root[n]
        return n

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def jaccard_components(docs, k, num, den):
    """docs: (id, text) with distinct ids. Returns {id: (size, component)}."""
    sets = {i: shingle_set(t, k) for i, t in docs}
    holders = defaultdict(list)
    for i, s in sets.items():
        for g in s:
            holders[g].append(i)
    shared = defaultdict(int)
    for own in holders.values():
        for x in range(len(own)):
            for y in range(x):
                shared[own[x], own[y]] += 1
    links = [(a, b) for (a, b), n in shared.items() if den * n >= num * (len(sets[a]) + len(sets[b]) - n)]
    comp = components(sets, links)
    return {i: (len(s), comp[i]) for i, s in sets.items()}


def vector_links(rows, threshold):
    """rows: (id, vector or None). {id: (links, component)}."""
    good = {}
    for i, v in rows:
        x = None if v is None else np.array([np.nan if c is None else c for c in v], dtype=float)
        if x is not None and len(x) and np.isfinite(x).all() and np.linalg.norm(x) > 0:
            good[i] = x / np.linalg.norm(x)
    ids = sorted(good)
    links = [(a, b) for n, a in enumerate(ids) for b in ids[:n] if len(good[a]) == len(good[b]) and good[a] @ good[b] >= threshold]
    count = defaultdict(int)
    for a, b in links:
        count[a] += 1
        count[b] += 1
    comp = components([i for i, _ in rows], links)
    return {i: (count[i], comp[i]) for i, _ in rows}


def contained(docs, items, k, num, den):
    out = {}
    for d, text in docs:
        own = words(text)
        for i, t in items:
            w = min(k, len(words(t)))
            asked = shingle_set(t, k)
            held = {tuple(own[j : j + w]) for j in range(len(own) - w + 1)}
            if asked and den * len(asked & held) >= num * len(asked):
                out[d, i] = (len(asked & held), len(asked))
    return out


def held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


def mix_targets(sizes, weights=(5, 2, 1), share=1.0, most=3.0):
    """sizes: {source: words}. Capped water filling."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    wanted, full = sum(sizes.values()) * share, set()
    while True:
        rest = [s for s in order if s not in full]
        left = wanted - sum(most * sizes[s] for s in full)
        total = sum(weight[s] for s in rest)
        target = {s: left * weight[s] / total for s in rest} | {s: most * sizes[s] for s in full}
        over = {s for s in rest if target[s] > most * sizes[s]}
        if not over:
            return target
        full |= over


def text_statistics(text, features):
    """The quality classifier's features, by name."""
    text, out = text or "", {}
    points, size = [ord(c) for c in text], max(1, len(text))
    marks = {f[5:] for f in features if f.startswith("mark ")}
    digits = [c for c in text if ord(c) < 0x3000 and c.isdigit() and c not in marks]
    blanks = [c for c in text if ord(c) < 0x3000 and c.isspace()]
    upper = [c for c in text if ord(c) < 0x3000 and c.isupper() and not c.isdigit()]
    small = [c for c in text if ord(c) >= 0x3000 or (c.isalpha() and not c.isupper() and not c.isdigit())]
    out["chars"], out["letters"] = np.log1p(len(text)), (len(upper) + len(small)) / size
    out["upper"] = len(upper) / max(1, len(upper) + len(small))
    out["digits"], out["space"] = len(digits) / size, len(blanks) / size
    for m in marks:
        out[f"mark {m}"] = text.count(m) / size
    known = len(digits) + len(blanks) + len(upper) + len(small) + sum(text.count(m) for m in marks)
    out["other"] = (len(points) - known) / size
    own = words(text)
    long = WORD.findall(text)
    n = len(own)
    pairs = {tuple(own[i : i + 2]) for i in range(max(1, n - 1))}
    out["words"] = np.log1p(n) if n else 0.0
    out["word length"] = sum(map(len, long)) / n if n else 0.0
    out["short words"] = sum(len(x) <= 3 for x in long) / n if n else 0.0
    out["long words"] = sum(len(x) >= 12 for x in long) / n if n else 0.0
    out["distinct words"] = len(set(own)) / n if n else 0.0
    out["distinct pairs"] = len(pairs) / max(1, n - 1) if n else 0.0
    out["top word"] = max(own.count(x) for x in set(own)) / n if n else 0.0
    lines = text.split("\n")
    out["lines"], out["line length"] = np.log1p(len(lines)), np.log1p(sum(map(len, lines)) / len(lines))
    out["distinct lines"], out["longest line"] = len(set(lines)) / len(lines), np.log1p(max(map(len, lines)))
    return [out[f] for f in features]


def trigrams(text):
    """Counts of letter trigrams: runs of other characters are one blank, and a trigram's middle is a letter."""
    low = "".join(c.lower()[0] if c.isalpha() else " " for c in text or "")
    low = re.sub(" +", " ", f" {low} ")
    out = defaultdict(int)
    for i in range(1, len(low) - 1):
        if low[i] != " ":
            out[low[i - 1 : i + 2]] += 1
    return out


def hyper_bundle(text, letters, number):
    """The bundle of a text's bound trigrams, one at a time. letters: a vector of each symbol; number: symbol of a character."""
    total = np.zeros(letters.shape[1])
    for gram, n in trigrams(text).items():
        a, b, c = (letters[number(x)] for x in gram)
        total += n * np.roll(a, 2) * np.roll(b, 1) * c
    norm = np.linalg.norm(total)
    return total / norm if norm else total


def prefix_trie(rows):
    """rows: (conv_id, turn, role, text). {(conv_id, depth): the other columns} of the rebuilt conversations' trie."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(v)] for c, v in own.items()}
    rebuilt = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        rebuilt[c] = tuple(own.get(c - int(np.fmod(c, 20)), [])[:h] + turns[h:])
    members = defaultdict(list)
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    out, leaves, saved = {}, {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in children[p]) or 1
        words_of = len(WORD.findall(p[-1][1])) if p else 0
        saved[p] = (len(members[p]) - 1) * words_of + sum(saved[k] for k in children[p])
        ended = ",".join(str(c) for c in sorted(c for c in members[p] if len(rebuilt[c]) == len(p)))
        parent = min(members[p[:-1]]) if p else None
        out[min(members[p]), len(p)] = (parent, len(members[p]), len(children[p]), leaves[p], saved[p], hashlib.sha256(ended.encode()).hexdigest())
    return out
