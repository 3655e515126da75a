"""The 84 features of features.assemble() in Arrow batches, for what needs them of many texts: a text takes a quarter of the time.

Array expressions with lambdas are interpreted token by token; here counts are hash tables of Python. Values are those of
features.assemble() up to the last bits of entropies of bigrams and trigrams, whose sums have another order. Java's and Python's word characters are the same but for
letters that Unicode got after the version of the one and before that of the other.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import lru_cache
from math import ceil, sqrt
from struct import pack, unpack

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import lexicons as L
from .features import FEATURES, base

#: Rows of a batch: texts and features of a batch are held at once.
ROWS = 256
#: White space as Java's (?U)\s has it; Python's \s has four more.
WHITE = "".join(map(chr, (*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
_WORD, _GAP, _SOLID = re.compile(r"\w+"), re.compile(rf"(?<=[.!?])[{WHITE}]+"), re.compile(rf"[^{WHITE}]+")
_BLANK, _HEADING, _CONTRACTED = re.compile(r"\n[ \t\n\x0b\f\r]*\n"), re.compile(rf"^#{{1,6}}[{WHITE}]+"), re.compile(r"\w+'\w+")
_LISTS = {"function_word_ratio": L.FUNCTION_WORDS, "first_person_ratio": L.PRONOUNS_FIRST, "second_person_ratio": L.PRONOUNS_SECOND, "third_person_ratio": L.PRONOUNS_THIRD, "modal_ratio": L.MODAL_VERBS, "conjunction_ratio": L.CONJUNCTIONS}
_LISTS = {k: frozenset(v) for k, v in _LISTS.items()}
_MARKS = {"comma": ",", "period": ".", "question": "?", "exclamation": "!", "semicolon": ";", "colon": ":", "dash": "-—", "quote": "\"'“”"}
_LG = (6.666666666666735130e-01, 3.999999999940941908e-01, 2.857142874366239149e-01, 2.222219843214978396e-01, 1.818357216161805012e-01, 1.531383769920937332e-01, 1.479819860511658591e-01)


def _log(x: float) -> float:
    """The logarithm of a positive normal number as Java's StrictMath has it (fdlibm), which Python's differs from in the last bit for some."""
    bits = unpack(">q", pack(">d", x))[0]
    k, high = (bits >> 52) - 1023, bits >> 32 & 0xFFFFF
    up = high + 0x95F64 & 0x100000
    k += up >> 20
    f = unpack(">d", pack(">q", bits & 0xFFFFFFFF | (high | up ^ 0x3FF00000) << 32))[0] - 1.0
    big, small = k * 6.93147180369123816490e-01, k * 1.90821492927058770002e-10
    if (2 + high & 0xFFFFF) < 3:
        r = f * f * (0.5 - 0.33333333333333333 * f)
        return big + small if f == 0 else big - ((r - small) - f) if k else f - r
    s = f / (2.0 + f)
    z = s * s
    w = z * z
    r = z * (_LG[0] + w * (_LG[2] + w * (_LG[4] + w * _LG[6]))) + w * (_LG[1] + w * (_LG[3] + w * _LG[5]))
    if (high - 0x6147A) | (0x6B851 - high) > 0:
        half = 0.5 * f * f
        return big - ((half - (s * (half + r) + small)) - f) if k else f - (half - s * (half + r))
    return big - ((s * (f - r) - small) - f) if k else f - s * (f - r)


@lru_cache(1 << 16)
def _log2(x: float) -> float:
    return _log(float(x)) / _LN2


_LN2 = _log(2.0)


def _pieces(text: str, cut: re.Pattern) -> list[str]:
    return [s for s in (x.strip(WHITE) for x in cut.split(text.strip(WHITE))) if s]


def _ratio(a: float, b: float) -> float:
    return a / b if b else 0.0


def _total(xs) -> float:
    """Added one by one; sum() of doubles carries what rounding loses, which Spark doesn't."""
    t = 0.0
    for x in xs:
        t += x
    return t


def _mean(xs: list) -> float:
    return _ratio(_total(xs), len(xs))


def _deviation(xs: list, less: int = 1) -> float:
    """As functions.text.deviation(), step by step."""
    n = m = q = 0.0
    for x in xs:
        mean = m + (x - m) / (n + 1)
        n, m, q = n + 1, mean, q + (x - mean) * (x - m)
    return sqrt(q / (n - less)) if n > 1 else 0.0


def _entropy(counts, total: int) -> float:
    return max(_log2(total) - _total(c * _log2(c) for c in counts if c > 1) / total, 0.0) if total > 0 else 0.0


def _tally(counts) -> list[tuple[int, int]]:
    """(count, how many keys have it), greatest first."""
    return sorted(Counter(counts).items(), reverse=True)


def _again(counts) -> float:
    return _ratio(sum(c > 1 for c in counts), len(counts))


def _grams(t: list[str], n: int) -> Counter:
    return Counter(zip(*(t[k:] for k in range(n)), strict=False))


def _starter(solid: list[str], cut: str = ".,!?:;") -> str:
    return solid[0].lower().rstrip(cut)


def _factors(seen: list[int], limit: float = 0.72) -> float:
    """As features._factors(); seen: where each word stood last, -1 for nowhere."""
    factors, start, types, at = 0.0, 0, 0, 0
    for s in seen:
        types += s < start
        at += 1
        if types / (at - start) <= limit:
            factors, start, types = factors + 1, at, 0
    if at > start:
        factors += (1 - types / (at - start)) / (1 - limit)
    return at / factors if factors > 0 else float(at)


def _last_seen(tok: list[str]) -> list[int]:
    last, out = {}, []
    for i, w in enumerate(tok):
        out.append(last.get(w, -1))
        last[w] = i
    return out


def _word_features(tok: list[str], c1: list[int], c2: list[int], c3: list[int]) -> dict[str, float]:
    """What features.gram_features() and position_features() give; c1, c2, c3: counts of grams, those of words greatest first."""
    n = len(tok)
    s, r, q = 0, 0, 0
    for c in c1:
        s, r, q = s + 1, r + c * s, q + c * s * s
    hdd = 0.0
    if n >= 42:
        for c, k in _tally(c1):
            missed = 1.0
            for i in range(42):
                missed = missed * max(n - c - i, 0) / (n - i)
            hdd += k * (1 - missed)
    mean = _ratio(r, n)
    h1, h2, h3 = _entropy(c1, n), _entropy(c2, n - 1), _entropy(c3, n - 2)
    prev = _last_seen(tok)
    gaps = [i - p for i, p in enumerate(prev) if p >= 0]
    k, whole, squares = len(gaps), sum(gaps), sum(x * x for x in gaps)
    gap = _ratio(whole, k)
    burst = growth = mtld = 0.0
    if n >= 10:
        back = [-1] * n
        for i, p in enumerate(prev):
            if p >= 0:
                back[n - 1 - p] = n - 1 - i
        mtld = (_factors(prev) + _factors(back)) / 2
        if k >= 2:
            spread = sqrt(max(squares - k * gap * gap, 0.0) / (k - 1))
            burst = _ratio(spread - gap, spread + gap)
    if n >= 100:
        fresh = sum(p < i - i % 50 for i, p in enumerate(prev) if i - i % 50 < n - 50)
        growth = fresh / 50.0 / ceil((n - 50) / 50)
    ttr = _ratio(len(c1), n)
    return {
        "sty_ttr": ttr, "sty_mtld_score": mtld, "sty_hd_d_score": hdd, "sty_hapax": _ratio(sum(c == 1 for c in c1), n), "sty_unique_word_count": len(c1),
        "prd_unigram_entropy": h1, "prd_bigram_entropy": h2, "prd_trigram_entropy": h3, "prd_bigram_repeat_rate": _again(c2), "prd_trigram_repeat_rate": _again(c3),
        "prd_avg_word_rank": mean, "prd_std_word_rank": sqrt(max(q - n * mean * mean, 0.0) / max(n - 1, 1)), "prd_top10_coverage": _ratio(sum(c1[:10]), n), "prd_top50_coverage": _ratio(sum(c1[:50]), n),
        "prd_new_word_rate": ttr, "prd_conditional_entropy": max(h2 - h1, 0.0), "prd_burstiness": burst, "prd_vocab_growth_rate": growth, "prd_vocab_burstiness": 0.0,
    }


def _style(text: str, lower: str, tok: list[str], counts: Counter, sents: list[list[str]], paras: int) -> dict[str, float]:
    """What features.stylometry_scalars() gives of a text with words."""
    n, lengths, slen = len(tok), [len(w) for w in tok], [len(s) for s in sents]
    found = sum(w in lower for w in L.DISCOURSE_MARKERS)
    out = {
        "word_count": n, "avg_word_length": _mean(lengths), "std_word_length": _deviation(lengths), "max_word_length": max(lengths),
        "sentence_count": len(sents), "avg_sentence_length": _mean(slen), "std_sentence_length": _deviation(slen), "max_sentence_length": max(slen, default=0), "min_sentence_length": min(slen, default=0),
        "paragraph_count": paras, "avg_paragraph_length": _ratio(n, paras),
        **{k: sum(c for w, c in counts.items() if w in v) / n for k, v in _LISTS.items()},
        **{f"{k}_ratio": sum(map(text.count, v)) / len(text) for k, v in _MARKS.items()},
        "discourse_marker_count": found, "discourse_marker_ratio": _ratio(found, len(sents)), "contraction_ratio": len(_CONTRACTED.findall(text)) / n if "'" in text else 0.0,
    }
    return {f"sty_{k}": v for k, v in out.items()}


def _structure(text: str, lower: str, para: list[str], plen: list[int], slen: list[int], starts: list[str]) -> dict[str, float]:
    """What features.structural_scalars() gives of a text with sentences."""
    n = len(slen)
    psent = [n] if len(para) == 1 else [len(_pieces(p, _GAP)) for p in para]
    capital = lambda s: s.upper() == s and s.lower() != s and len(s) < 80 and len(_SOLID.findall(s)) < 10
    heads = sum(bool(_HEADING.match(s)) or capital(s) for s in (x.strip(WHITE) for x in text.split("\n")))
    marks = {f"transition_{k}_count": sum(w in lower for w in words) for k, words in L.TRANSITIONS.items()}
    transitions, diversity = sum(marks.values()), len(set(starts)) / n
    product = float(sum(i * x for i, x in enumerate(slen))) - (n - 1) / 2.0 * sum(slen)
    out = {
        "paragraph_count": len(para), "avg_paragraph_word_count": _mean(plen), "std_paragraph_word_count": _deviation(plen), "min_paragraph_word_count": min(plen, default=0), "max_paragraph_word_count": max(plen, default=0),
        "paragraph_length_ratio": _ratio(max(plen, default=0), min(plen, default=0)), "avg_sentences_per_paragraph": _mean(psent), "std_sentences_per_paragraph": _deviation(psent),
        "heading_count": heads, "has_headings": int(heads > 0), **marks, "total_transitions": transitions, "transition_density": transitions / n, "starter_diversity": diversity,
        "avg_sentence_position_similarity": _mean([abs(a - b) for a, b in zip(slen[1:], slen, strict=False)]), "sentence_length_trend": _ratio(product, n * (float(n) * n - 1) / 12.0) if n >= 2 else 0.0,
        "structure_score": 2.0 * (heads > 0) + min(len(para), 10) + min(transitions, 20) / 2.0 + 5.0 * diversity,
    }
    return {f"str_{k}": v for k, v in out.items()}


def _meaning(w: list[str], sets: list[set[str]], c1: Counter, c2: Counter, c3: Counter, alpha: float = 0.1) -> dict[str, float]:
    """What features.semantic_scalars() and cross_entropies() give, before rounding; w: words of ASCII letters; c1, c2, c3: their grams."""
    m = len(w)
    sims = [_ratio(len(a & b), len(a | b)) for a, b in zip(sets, sets[1:], strict=False)]
    mean, spread = _mean(sims), _deviation(sims, 0)
    out = {"inter_sentence_jaccard_mean": mean, "inter_sentence_jaccard_std": spread, "semantic_monotony_index": mean / (spread + 0.05) if len(sets) >= 2 else 0.0}
    for name, k, distinct in (("trigram", 3, c3), ("quadgram", 4, set(zip(w, w[1:], w[2:], w[3:], strict=False)))):
        out[f"{name}_repetition_rate"] = max(1 - _ratio(len(distinct), m - (k - 1)), 0.0) if m >= 6 else 0.0
    smooth = alpha * max(len(c1), 10)
    for n, grams, prefixes in ((2, c2, c1), (3, c3, c2)):
        h = p = 0.0
        if m >= n:
            prefixes = prefixes.copy()  # the last gram is no prefix
            prefixes[w[-1] if n == 2 else tuple(w[-2:])] -= 1
            own = _total(c * _log2(c + alpha) * k for c, k in _tally(grams.values()))
            of = _total(c * _log2(c + smooth) * k for c, k in _tally(prefixes.values()) if c)
            h = -(own - of) / (m - (n - 1))
            p = min(2.0**h, 10000.0)
        out |= {f"word_{n}gram_cross_entropy": h, f"word_{n}gram_perplexity": p}
    return {f"sem_{k}": v for k, v in out.items()}


def features(text: str) -> list[float]:
    """FEATURES of a text; those of the family `sem` aren't rounded yet."""
    lower = text.lower()
    tok, sent, para = _WORD.findall(lower), _pieces(text, _GAP), _pieces(text, _BLANK)
    solid, blocks, words = [_SOLID.findall(s) for s in sent], [_SOLID.findall(p) for p in para], [_WORD.findall(s.lower()) for s in sent]
    grams = Counter(tok), _grams(tok, 2), _grams(tok, 3)
    plain = {x for x in grams[0] if x.isascii() and x.isalpha()}
    w = tok if len(plain) == len(grams[0]) else [x for x in tok if x in plain]
    out = _word_features(tok, sorted(grams[0].values(), reverse=True), list(grams[1].values()), list(grams[2].values()))
    out |= _meaning(w, [plain.intersection(s) for s in words], *(grams if w is tok else (Counter(w), _grams(w, 2), _grams(w, 3))))
    slen = [len(s) for s in solid]
    if tok:
        n = len(text)
        out |= _style(text, lower, tok, grams[0], words, len(para))
        out["prd_char_entropy"] = 0.0 - _total(c / n * _log2(c / n) for c in (lower.count(x) for x in sorted(set(lower))))
        out["prd_sentence_length_cv"] = _ratio(_deviation(slen), _mean(slen))
    if sent:
        starts = [_starter(s) for s in solid]
        out |= _structure(text, lower, para, [len(p) for p in blocks], slen, starts)
        out["str_repeated_starter_ratio"] = _again(Counter(starts).values())
        out["str_paragraph_start_repetition"] = _again(Counter(map(_starter, blocks)).values())
        out["prd_exact_sentence_repeat_rate"] = _again(Counter(" ".join(s).lower() for s in solid).values())
        out["prd_sentence_start_entropy"] = _entropy([c for _, c in sorted(Counter(_starter(s, "") for s in solid).items())], len(sent))
    return [float(out.get(c, 0.0)) for c in FEATURES]


def _run(batches):
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            rows = np.array([features(x.as_py()) for x in part.column(1)])
            yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(rows[:, k]) for k in range(len(FEATURES))]], ["doc_id", *FEATURES])


def assemble(docs: DataFrame) -> DataFrame:
    """features.assemble(docs) of all families."""
    rows = base(docs)
    made = rows.mapInArrow(_run, ", ".join([f"doc_id {dict(rows.dtypes)['doc_id']}", *[f"{c} double" for c in FEATURES]]))
    return made.select("doc_id", *[F.round(c, 4).alias(c) if c.startswith("sem_") else F.col(c) for c in FEATURES])
