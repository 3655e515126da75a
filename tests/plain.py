"""Plain Python versions of the 84 features, straight from their definitions, for comparison."""

import math
import re
import statistics
from collections import Counter

from textloom.functions import lexicons as L


def words(t):
    return re.findall(r"\w+", t.lower())


def cut(t, p):
    return [x.strip() for x in re.split(p, t.strip()) if x.strip()]


def sents(t):
    return cut(t, r"(?<=[.!?])\s+")


def paras(t):
    return cut(t, r"\n\s*\n")


def mean(x):
    return sum(x) / len(x) if x else 0.0


def dev(x):
    return statistics.stdev(x) if len(x) > 1 else 0.0


def entropy(xs):
    c, n = Counter(xs), len(xs)
    return -sum(v / n * math.log2(v / n) for v in c.values()) if n else 0.0


def again(xs):
    c = Counter(xs)
    return sum(v > 1 for v in c.values()) / len(c) if c else 0.0


def grams(w, n):
    return [tuple(w[i : i + n]) for i in range(len(w) - n + 1)]


def walk(w):
    factors, start, seen = 0.0, 0, set()
    for i, x in enumerate(w):
        seen.add(x)
        if len(seen) / (i + 1 - start) <= 0.72:
            factors, start, seen = factors + 1, i + 1, set()
    if start < len(w):
        factors += (1 - len(seen) / (len(w) - start)) / (1 - 0.72)
    return len(w) / factors if factors > 0 else len(w)


def first_word(s, strip=True):
    w = s.split()[0].lower() if s.split() else ""
    return w.rstrip(".,!?:;") if strip else w


def stylometry(t):
    w, s, p = words(t), sents(t), paras(t)
    if not w:
        return [0.0] * 33
    c, n = Counter(w), len(w)
    sl, wl = [len(words(x)) for x in s], [len(x) for x in w]
    hdd = sum(1 - math.exp(math.lgamma(n - k + 1) - math.lgamma(n - k - 41) - math.lgamma(n + 1) + math.lgamma(n - 41)) if n - k >= 42 else 1.0 for k in c.values()) if n >= 42 else 0.0
    share = lambda ws: sum(x in ws for x in w) / n
    marks = lambda cs: sum(t.count(x) for x in cs) / len(t)
    found = sum(m in t.lower() for m in L.DISCOURSE_MARKERS)
    return [
        len(c) / n, (walk(w) + walk(w[::-1])) / 2 if n >= 10 else 0.0, hdd, sum(v == 1 for v in c.values()) / n, n, len(c), mean(wl), dev(wl), max(wl),
        len(s), mean(sl), dev(sl), max(sl, default=0), min(sl, default=0), len(p), n / len(p) if p else 0.0, share(L.FUNCTION_WORDS),
        *[marks(x) for x in [",", ".", "?", "!", ";", ":", "-—", "\"'“”"]], share(L.PRONOUNS_FIRST), share(L.PRONOUNS_SECOND), share(L.PRONOUNS_THIRD),
        share(L.MODAL_VERBS), share(L.CONJUNCTIONS), found, found / len(s) if s else 0.0, len(re.findall(r"\b\w+'\w+\b", t)) / n,
    ]


def structural(t):
    s, p = sents(t), paras(t)
    if not s:
        return [0.0] * 24
    lines = [x.strip() for x in t.split("\n")]
    heads = sum(bool(re.match(r"#{1,6}\s+", x)) or (x.isupper() and len(x) < 80 and len(x.split()) < 10) for x in lines)
    pw, ps, sl = [len(x.split()) for x in p], [len(sents(x)) for x in p], [len(x.split()) for x in s]
    tr = [sum(m in t.lower() for m in ms) for ms in L.TRANSITIONS.values()]
    st = [first_word(x) for x in s]
    n = len(sl)
    trend = sum((i - (n - 1) / 2) * (x - mean(sl)) for i, x in enumerate(sl)) / sum((i - (n - 1) / 2) ** 2 for i in range(n)) if n > 1 else 0.0
    return [
        len(p), mean(pw), dev(pw), min(pw, default=0), max(pw, default=0), max(pw) / min(pw) if pw and min(pw) else 0.0, mean(ps), dev(ps), heads, int(heads > 0), *tr, sum(tr), sum(tr) / n,
        len(set(st)) / n, again(st), again([first_word(x) for x in p]), mean([abs(a - b) for a, b in zip(sl, sl[1:])]), trend,
        2 * (heads > 0) + min(len(p), 10) + min(sum(tr), 20) / 2 + 5 * len(set(st)) / n,
    ]


def predictability(t):
    w, s = words(t), sents(t)
    if not w:
        return [0.0] * 18
    n, c = len(w), Counter(w)
    last, gaps = {}, []
    for i, x in enumerate(w):
        if x in last:
            gaps.append(i - last[x])
        last[x] = i
    burst = (dev(gaps) - mean(gaps)) / (dev(gaps) + mean(gaps)) if n >= 10 and len(gaps) >= 2 else 0.0
    order = [x for x, _ in c.most_common()]
    rank = {x: i for i, x in enumerate(order)}
    r = [rank[x] for x in w]
    growth = mean([len(set(w[i : i + 50])) / 50 for i in range(0, n - 50, 50)]) if n >= 100 else 0.0
    sl = [len(x.split()) for x in s]
    h1, h2, h3 = (entropy(grams(w, k)) for k in (1, 2, 3))
    chars = Counter(t.lower())
    return [
        h1, h2, h3, -sum(v / len(t) * math.log2(v / len(t)) for v in chars.values()), burst, 0.0, again(grams(w, 2)), again(grams(w, 3)), again([" ".join(x.lower().split()) for x in s]),
        mean(r), math.sqrt(sum((x - mean(r)) ** 2 for x in r) / max(n - 1, 1)), sum(c[x] for x in order[:10]) / n, sum(c[x] for x in order[:50]) / n, len(c) / n, growth,
        dev(sl) / mean(sl) if mean(sl) else 0.0, entropy([first_word(x, False) for x in s]), max(0.0, h2 - h1),
    ]


def semantic(t):
    w = [x for x in words(t) if re.fullmatch("[a-z]+", x)]
    out = []
    for n in (2, 3):
        g = grams(w, n)
        if not g:
            out += [0.0, 0.0]
            continue
        full, pre, v = Counter(g), Counter(x[:-1] for x in g), max(len(set(w)), 10)
        h = -sum(math.log2((full[x] + 0.1) / (pre[x[:-1]] + 0.1 * v)) for x in g) / len(g)
        out += [h, min(2**h, 10000.0)]
    sets = [{x for x in words(s) if re.fullmatch("[a-z]+", x)} for s in sents(t)]
    sims = [len(a & b) / len(a | b) if a | b else 0.0 for a, b in zip(sets, sets[1:])]
    m, d = mean(sims), statistics.pstdev(sims) if sims else 0.0
    rep = [max(0.0, 1 - len(set(grams(w, n))) / len(grams(w, n))) if len(w) >= 6 else 0.0 for n in (3, 4)]
    return [*out, m, d, m / (d + 0.05) if sims else 0.0, *rep]


def features(t):
    t = t or ""
    return [*stylometry(t), *structural(t), *predictability(t), *semantic(t)]
