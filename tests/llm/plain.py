"""Plain-Python versions that the tests compare with."""

import collections
import math
import re
import zlib

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})


def words(text):
    return WORDS.findall((text or "").translate(LOWER))


def shingles(text, size):
    found = words(text)
    width = min(size, len(found))
    return frozenset(tuple(found[i:i + width]) for i in range(len(found) - width + 1)) if found else frozenset()


def components(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def jaccard_components(rows, size, percent):
    """{id: (set size, smallest id reached)} of (id, text) rows by comparing all pairs."""
    sets = {i: shingles(t, size) for i, t in rows}
    ids = sorted(sets)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[:k]
             if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    roots = components(ids, links)
    return {i: (len(sets[i]), roots[i]) for i in ids}


def base_spans(text):
    """(kind, start, end) of the base patterns, with plain patterns and checks."""
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((m.start(), 0, m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = [int(c) for c in m[0] if c.isdigit()]
        total = sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(reversed(digits)))
        if 14 <= len(digits) <= 19 and total % 10 == 0:
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def backoff_scores(rows, word_share, arc_share, discount):
    """{id: (tokens, known, training tokens, base score, score)} by dictionaries and recursion."""
    texts = {i: words(t) + [None] for i, t in rows}
    train = {i: ws for i, ws in texts.items() if zlib.crc32(str(i).encode()) % 7 != 2}
    one = collections.Counter(w for ws in train.values() for w in ws)
    n, kinds = sum(one.values()), len(one)
    states = {w for w, c in one.items() if c >= max(1, word_share * n)}
    often = {w for w in states if one[w] >= max(2, arc_share * n)}

    def frequent(size, use):
        counts = collections.Counter()
        for ws in train.values():
            run = [None, *ws]
            counts.update(g for g in zip(*(run[k:] for k in range(size))) if use(g))
        return {g: c for g, c in counts.items() if c >= max(2, arc_share * n)}

    two = frequent(2, lambda g: set(g) <= often)
    three = frequent(3, lambda g: g[:2] in two and g[1:] in two)

    def p1(w):
        return (one[w] + 1) / (n + kinds + 1)

    def p2(a, b):
        return (two[a, b] - discount) / one[a]

    left, left_lower, deep, deep_lower = (collections.Counter() for _ in range(4))
    for a, b in two:
        left[a] += p2(a, b)
        left_lower[a] += p1(b)
    for g, c in three.items():
        deep[g[:2]] += (c - discount) / two[g[:2]]
        deep_lower[g[:2]] += p2(*g[1:])

    def p(history, w):
        if len(history) == 2:
            if history not in two:
                return p(history[1:], w)
            if (*history, w) in three:
                return (three[(*history, w)] - discount) / two[history]
            return max(1 - deep[history], 1e-12) / max(1 - deep_lower[history], 1e-12) * p(history[1:], w)
        (a,) = history
        if (a, w) in two:
            return p2(a, w)
        return (max(1 - left[a], 1e-12) / max(1 - left_lower[a], 1e-12) if a in states else 1) * p1(w)

    out = {}
    for i, ws in texts.items():
        run = [None, *ws]
        base = sum(math.log10(p1(w)) for w in ws)
        score = sum(math.log10(p(tuple(run[max(0, k - 1):k + 1]), w)) for k, w in enumerate(ws))
        out[i] = (len(ws), sum(one[w] > 0 for w in ws), n, base, score)
    return out


def density_sums(tags: list[str], parents: list[int], doubts: list[bool], texts: list[tuple[int, str]], named: float) -> list[float]:
    """Sum of the composite densities of each node's children and of its own text, by recursion from the definition."""
    children = {n: [c for c, p in enumerate(parents) if p == n] for n in range(len(tags))}
    own = [sum(len("".join(t.split())) for n, t in texts if n == node) for node in range(len(tags))]

    def measures(node):
        inner = [measures(c) for c in children[node] if not doubts[c]]
        c, t, lc, lt = (sum(m[k] for m in inner) for k in range(4))
        c, t = c + own[node], t + len(inner)
        return (c, t, c, lt + 1) if tags[node] == "a" else (c, t, lc, lt)

    c0, _, l0, _ = measures(0)

    def density(c, t, lc, lt):
        if lc >= c:
            return 0.0
        outer = math.log(c / (c - lc) * lc + (l0 / c0 if c0 else 0.0) * c + math.e)
        return max(0.0, c / max(1, t) * math.log(c / max(1, lc) * (max(1, t) / max(1, lt))) / outer)

    def above(node):
        return [node, *(above(parents[node]) if parents[node] >= 0 else [])]

    out = []
    for node in range(len(tags)):
        found = [density(*measures(c)) for c in children[node] if not doubts[c]]
        if not any(tags[n] == "a" for n in above(node)):
            found.append(density(own[node], 1, 0, 0))
        out.append(sum(found) * named ** sum(doubts[n] for n in above(node)))
    return out
