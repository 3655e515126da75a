"""Plain versions of the operators, for small tables."""

import hashlib
import re
from collections import defaultdict

PLAIN = re.compile("[!-/:-@\\[-`{-~]")


def words(text):
    return (text or "").encode().split()


def remove_repeats(rows, window):
    first, docs = {}, [(d, words(t)) for d, t in rows]
    for d, w in docs:
        for p in range(len(w) - window + 1):
            k = tuple(w[p : p + window])
            first[k] = min(first.get(k, d), d)
    out = []
    for d, w in docs:
        gone = [False] * len(w)
        for p in range(len(w) - window + 1):
            if first[tuple(w[p : p + window])] < d:
                gone[p : p + window] = [True] * window
        kept = [x for x, g in zip(w, gone) if not g]
        out.append((d, len(w), len(w) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return sorted(out)


def shingles(text, n=5):
    w = words(text)
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def classes(rows, threshold=0.8):
    """{doc_id: (class, links)} for rows with unique ids."""
    sets, texts, inverted = {d: shingles(t) for d, t in rows}, dict(rows), defaultdict(list)
    for d, s in sets.items():
        for x in s:
            inverted[x].append(d)
    links = defaultdict(set)
    for d, s in sets.items():
        shared = defaultdict(int)
        for x in s:
            for e in inverted[x]:
                shared[e] += 1
        for e, k in shared.items():
            if e != d and k >= threshold * (len(s) + len(sets[e]) - k) - 1e-9:
                links[d].add(e)
    by_text = defaultdict(list)
    for d, t in texts.items():
        if t is not None:
            by_text[t].append(d)
    for own in by_text.values():
        for d in own:
            links[d] |= set(own) - {d}
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for d, own in links.items():
        for e in own:
            a, b = find(d), find(e)
            parent[max(a, b)] = min(a, b)
    return {d: (find(d), len(links[d])) for d in sets}


def row_classes(rows, threshold=0.8):
    """[(doc_id, class, links)] by row; ids may be null or shared by texts. A class is named by its least id."""
    got = classes([(i, t) for i, (_, t) in enumerate(rows)], threshold)
    least = {}
    for i, (c, _) in got.items():
        if rows[i][0] is not None:
            least[c] = min(least.get(c, rows[i][0]), rows[i][0])
    return [(d, least.get(got[i][0]), got[i][1]) for i, (d, _) in enumerate(rows)]


def leaks(rows, items, containment=0.8):
    plain = lambda t: shingles_plain(PLAIN.sub(" ", (t or "").lower()))
    docs, out = [(d, plain(t)) for d, t in rows], []
    for i, t in items:
        own = plain(t)
        out += [(d, i) for d, s in docs if own and len(own & s) >= containment * len(own) - 1e-9]
    return sorted(out)


def shingles_plain(text, n=5):
    w = text.encode().split()
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def measures(text):
    text = text or ""
    w = re.findall("[^\x20\x09-\x0d]+", text)
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    hit = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(3)}
    return [len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for x in w for c in x), len(lines) - len(set(lines)), len(hit)]


def fill(sizes, weights, share, most):
    """Targets by source: capped, with the excess reshared by weight until none is above its cap."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, capped, left = {}, set(), share * sum(sizes.values())
    while True:
        free = [s for s in order if s not in capped]
        over = [s for s in free if left * w[s] / sum(w[x] for x in free) > most * sizes[s] + 1e-9]
        if not over:
            return target | {s: left * w[s] / sum(w[x] for x in free) for s in free}
        for s in over:
            target[s] = most * sizes[s]
            capped.add(s)
            left -= most * sizes[s]
