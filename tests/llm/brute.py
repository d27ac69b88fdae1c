"""Plain Python versions of the operators, for small inputs."""

import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def words(text):
    return WORD.findall(lower(text or ""))


def shingle_set(text, n=5):
    w = words(text)
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def components(ids, linked):
    """Smallest id reachable, by all pairs."""
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(ids)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            if linked(a, b):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


def jaccard_at_least(x, y, per_cent):
    n = len(x & y)
    return bool(x and y) and 100 * n >= per_cent * (len(x) + len(y) - n)


def lines_left(rows):
    """rows: (id, text) -> {id: (lines removed, text left)}; by all pairs of lines."""
    places = {}
    for i, t in sorted(rows):
        for k, line in enumerate((t or "").split("\n")):
            if line.strip(" \t\n\x0b\x0c\r"):
                places.setdefault(line, (i, k))
    names = list(places)
    sets = [{k: frozenset(x[i : i + k] for i in range(len(x) - k + 1)) for k, low, high in ((5, 5, 130), (8, 104, 10**9)) if low <= len(x) <= high} for x in names]

    def linked(a, b):
        return any(k in sets[a] and k in sets[b] and jaccard_at_least(sets[a][k], sets[b][k], p) for k, p in ((5, 65), (8, 80)))

    root = {names[i]: r for i, r in components(range(len(names)), linked).items()}
    best = {}
    for line, p in places.items():
        best[root[line]] = min(best.get(root[line], p), p)
    out = {}
    for i, t in rows:
        ls = (t or "").split("\n")
        keep = [x for k, x in enumerate(ls) if not x.strip(" \t\n\x0b\x0c\r") or best[root[x]] == (i, k)]
        out[i] = (len(ls) - len(keep), "\n".join(keep))
    return out


# benchmark passages
MASKS = ("11011011", "11100111", "10110111", "11111000", "11010101", "10011011")


def plain_words(text):
    return [w.lower().strip(".,;:!?\"'()[]{}*#$%&|<>") for w in WORD.findall(text or "")]


def best_run(equal):
    """(equal words, start, end) of the run with most equal less unequal words; the longest of equals, the last, the first start."""
    best = (0, 0, 0)
    for e in range(1, len(equal) + 1):
        for s in range(e):
            gain = sum(1 if x else -1 for x in equal[s:e])
            if gain > 0 and (gain, e, -s) > best:
                best = (gain, e, -s)
    return (sum(equal[-best[2] : best[1]]), -best[2], best[1])


def contaminations(texts, items):
    """(document, item) of every document that holds an item, by all diagonals that a mask hits; both: {id: text}."""
    words_of = {i: plain_words(t) for i, t in items.items()}
    tables = {}
    for i, w in words_of.items():
        masks = (MASKS if len(w) >= 8 else ()) + (tuple("1" * k + "0" + "1" * (len(w) - k - 1) for k in range(len(w))) if len(w) <= 8 else ())
        for mask in masks if len(w) >= 5 else ():
            at = [k for k, c in enumerate(mask) if c == "1"]
            for p in range(len(w) - len(mask) + 1):
                tables.setdefault(mask, {}).setdefault(tuple(w[p + k] for k in at), []).append((i, p))
    out = set()
    for name, text in texts.items():
        d, hits = plain_words(text), {}
        for mask, table in tables.items():
            at = [k for k, c in enumerate(mask) if c == "1"]
            for q in range(len(d) - len(mask) + 1):
                for i, p in table.get(tuple(d[q + k] for k in at), ()):
                    hits.setdefault(i, set()).add(q - p)
        for i, diagonals in hits.items():
            w, runs = words_of[i], []
            for g in diagonals:
                a, b = max(0, g), min(len(d), g + len(w))
                n, s, e = best_run([d[k] == w[k - g] for k in range(a, b)])
                if e > s:
                    runs.append((g, a + s, a + e, n))
            best = max(runs, key=lambda r: (r[3], -r[1]), default=None)
            chosen = []
            for r in sorted(runs, key=lambda r: -r[3]):
                if abs(r[0] - best[0]) <= 4 and abs(r[1] - best[1]) <= 2 * len(w) and all(r[2] <= c[1] or r[1] >= c[2] for c in chosen):
                    chosen.append(r)
            if chosen and sum(r[3] for r in chosen) >= min(10, -(-4 * len(w) // 5)):
                out.add((name, i))
    return out
