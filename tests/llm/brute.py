"""Plain versions of the operators, for small inputs."""

import hashlib
import math
import re
import zlib
from collections import Counter
from itertools import combinations

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ITEM_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def components(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {n: find(n) for n in nodes}


def shingles(text, size=5):
    w = WORD.findall(low(text))
    if not w:
        return set()
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))}


def near_copies(rows, percent=80):
    sets = {}
    for d, t in rows:
        if d is not None:
            sets.setdefault(d, []).append(shingles(t))
    links = [
        (a, b)
        for (a, xs), (b, ys) in combinations(sets.items(), 2)
        if any(x and y and 100 * len(x & y) >= percent * len(x | y) for x in xs for y in ys)
    ]
    comp = components(sets, links)
    return sorted(
        ((d, len(shingles(t)), comp.get(d), d is not None and comp[d] == d) for d, t in rows), key=repr
    )


def contaminated(rows, items, size=10):
    windows = {}
    for i, t in items:
        w = ITEM_WORD.findall(low(t))
        if w:
            for k in range(max(1, len(w) - size + 1)):
                windows.setdefault(tuple(w[k : k + size]), set()).add("" if i is None else str(i))
    out = []
    for d, t in rows:
        w = ITEM_WORD.findall(low(t))
        hit, found = set(), set()
        for win, own in windows.items():
            n = len(win)
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) == win:
                    hit.update(range(k, k + n))
                    found |= own
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((d, len(w), len(hit), len(found), digest, bool(hit)))
    return sorted(out, key=repr)


RULES = [
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 8),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 16),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 32),
]


def secrets(text):
    out = [(m.start(), k, m.end()) for k, (_, p, g, n) in enumerate(RULES) for m in p.finditer(text or "") if len(m[g]) >= n]
    return [f"{RULES[k][0]}:{a}:{b}" for a, k, b in sorted(out)]


def base_scores(rows):
    held = lambda d: zlib.crc32(b"" if d is None else str(d).encode()) % 10 == 0
    tokens = lambda t: [*WORD.findall(low(t)), "\n"]
    c = Counter(x for d, t in rows if not held(d) for x in tokens(t))
    n, v = sum(c.values()), len(c)
    return sorted(
        ((d, held(d), len(tokens(t)), sum(x in c for x in tokens(t)), n, round(sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in tokens(t)), 6)) for d, t in rows),
        key=repr,
    )


def cosine_links(rows, threshold):
    def good(r):
        return r[0] is not None and r[2] is not None and r[1] and all(x is not None and math.isfinite(x) for x in r[1]) and any(r[1])

    def cos(x, y):
        return sum(a * b for a, b in zip(x, y)) / math.sqrt(sum(a * a for a in x) * sum(b * b for b in y))

    links, n = [], [0] * len(rows)
    for (i, a), (j, b) in combinations(enumerate(rows), 2):
        if good(a) and good(b) and a[2] == b[2] and len(a[1]) == len(b[1]) and cos(a[1], b[1]) >= threshold:
            links.append((a[0], b[0]))
            n[i] += 1
            n[j] += 1
    comp = components({r[0] for r in rows if r[0] is not None}, links)
    return sorted(((r[0], k, comp.get(r[0]), r[0] is not None and comp[r[0]] == r[0]) for r, k in zip(rows, n)), key=repr)
