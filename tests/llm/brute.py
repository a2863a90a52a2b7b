"""Plain versions of the queries' contracts, for small inputs."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from zlib import crc32

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(x: str | bytes) -> str:
    return hashlib.sha256(x.encode() if isinstance(x, str) else x).hexdigest()


def op1_levels(calls: list[tuple]) -> dict:
    """(conv_id, call_id): the longest chain of calls (conv_id, call_id, name, arguments, position, after) before it."""
    known = {(c[0], c[1]): [(c[0], x) for x in c[5] or ()] for c in calls}
    level: dict = {}
    for _ in known:  # as many rounds as there are calls settle whatever can be settled
        for call, after in known.items():
            waits = [level.get(x) for x in after if x in known]
            if call not in level and None not in waits:
                level[call] = max((w + 1 for w in waits), default=0)
    return {call: level.get(call) for call in known}


def op3(docs: list[tuple[int, str | None]], size: int = 200) -> list[tuple]:
    texts = [(t or "").encode() for _, t in docs]
    seen = Counter(t[i : i + size] for t in texts for i in range(len(t) - size + 1))
    out = []
    for (doc_id, _), t in zip(docs, texts, strict=True):
        gone = [False] * len(t)
        for i in range(len(t) - size + 1):
            if seen[t[i : i + size]] > 1:
                gone[i : i + size] = [True] * size
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((doc_id, len(t), sum(gone), spans, sha(bytes(b for b, g in zip(t, gone, strict=True) if not g))))
    return out


def op5_base(text: str | None) -> tuple[int, int, int, int, int, bool]:
    text = text or ""
    words = WORD.findall(text)
    lines, dup, seen = [x for x in text.split("\n") if WORD.search(x)], 0, set()
    for x in lines:
        dup += x in seen
        seen.add(x)
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    n = Counter(grams)
    repeat = {j for i, g in enumerate(grams) if n[g] > 1 for j in range(i, i + 5)}
    failed = len(words) < 10 or 100 * len(repeat) > 20 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(repeat), failed


def op4(docs: list[tuple], hashes: dict[str, int], per_label: int = 800) -> list[tuple]:
    """TF-IDF over hashed n-grams, FTRL-proximal one row at a time and a temperature, written over dicts and lists."""
    import numpy as np

    mult, dims, mask = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D), 1 << 16, (1 << 32) - 1

    def grams(text: str) -> Counter:
        found: Counter = Counter()
        codes = [ord(c) for c in text.lower()]
        for n in (1, 2, 3):
            for i in range(len(codes) - n + 1):
                h = n
                for j in range(n):
                    h = (h ^ codes[i + j]) * mult[j] & mask
                    h ^= h >> 15
                found[h % dims] += 1
        return found

    held = lambda i: crc32(("" if i is None else str(i)).encode()) % 5 == 0
    train = [(t, lang) for i, t, lang in docs if not held(i) and t is not None and lang is not None]
    df = Counter(g for t, _ in train for g in grams(t))
    n_docs = sum(1 for t, _ in train if grams(t))
    idf = lambda g: math.log((1 + n_docs) / (1 + df[g])) + 1

    def vector(text: str) -> dict[int, float]:
        x = {g: (1 + math.log(c)) * idf(g) for g, c in sorted(grams(text).items())}
        norm = math.sqrt(sum(v * v for v in x.values())) or 1.0
        return {g: v / norm for g, v in x.items()}

    labels = sorted({lang for t, lang in train if any(map(str.isalpha, t))})
    sample = []
    for lang in labels:
        sample += sorted({(lang, hashes[t], t) for t, x in train if x == lang and any(map(str.isalpha, t))})[:per_label]
    fitted = [i for i in range(len(sample)) if (i + 1) % 4]
    z, n = ({k: Counter() for k in range(len(labels))} for _ in range(2))
    alpha, beta, l1, l2 = 2.0, 1.0, 0.02, 0.05

    def weight(k: int, g: int) -> float:
        s = z[k][g]
        return 0.0 if abs(s) <= l1 else (math.copysign(l1, s) - s) / ((beta + math.sqrt(n[k][g])) / alpha + l2)

    def logits(x: dict[int, float]) -> list[float]:
        return [sum(v * weight(k, g) for g, v in x.items()) + weight(k, dims) for k in range(len(labels))]

    def softmax(s: list[float]) -> list[float]:
        e = [math.exp(v - max(s)) for v in s]
        return [v / sum(e) for v in e]

    order = np.random.default_rng(7)
    for _ in range(3):
        for i in order.permutation(len(fitted)):
            lang, _, text = sample[fitted[i]]
            x = vector(text)
            p = softmax(logits(x))
            for k in range(len(labels)):
                miss = p[k] - (labels[k] == lang)
                for g, v in [*x.items(), (dims, 1.0)]:
                    d, w = miss * v, weight(k, g)
                    z[k][g] += d - (math.sqrt(n[k][g] + d * d) - math.sqrt(n[k][g])) / alpha * w
                    n[k][g] += d * d
    rest = [(logits(vector(t)), labels.index(lang)) for i, (lang, _, t) in enumerate(sample) if not (i + 1) % 4]
    loss = lambda t: sum(-math.log(max(1e-300, softmax([v / t for v in s])[y])) for s, y in rest)
    lo, hi, r = math.log(0.05), math.log(20.0), (5**0.5 - 1) / 2
    for _ in range(60 if rest else 0):  # golden section
        a, b = hi - r * (hi - lo), lo + r * (hi - lo)
        lo, hi = (lo, b) if loss(math.exp(a)) < loss(math.exp(b)) else (a, hi)
    temperature = math.exp((lo + hi) / 2) if rest else 1.0
    out = []
    for i, t, _ in docs:
        if not labels or not t or not any(map(str.isalpha, t)):
            out.append((i, held(i), "und", 0.0))
            continue
        p = softmax([v / temperature for v in logits(vector(t))])
        out.append((i, held(i), labels[p.index(max(p))], max(p)))
    return out


def shingle_set(text: str | None, k: int) -> frozenset:
    words = WORD.findall((text or "").translate(LOWER))
    if len(words) < k:
        return frozenset([tuple(words)]) if words else frozenset()
    return frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1))


def op6(docs: list[tuple[int, str | None]], k: int = 3, percent: int = 90) -> list[tuple[int, int, int]]:
    sets = [shingle_set(t, k) for _, t in docs]
    root = list(range(len(docs)))

    def find(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and (both := len(a & b)) and 100 * both >= percent * (len(a) + len(b) - both):
                root[find(i)] = find(j)
    least: dict[int, int] = {}
    for i, (doc_id, _) in enumerate(docs):
        least[find(i)] = min(doc_id, least.get(find(i), doc_id))
    return [(doc_id, len(sets[i]), least[find(i)]) for i, (doc_id, _) in enumerate(docs)]


def op7(docs: list[tuple[int, str | None]], items: list[tuple[int, str | None]], size: int = 10) -> list[tuple]:
    find = lambda t: ALNUM.findall((t or "").translate(LOWER))
    windows: dict[tuple, set[str]] = {}
    for item_id, t in items:
        w = find(t)
        for i in range(max(1, len(w) - size + 1) if w else 0):
            windows.setdefault(tuple(w[i : i + size]), set()).add(str(item_id))
    lengths = {len(w) for w in windows}
    out = []
    for doc_id, t in docs:
        w = find(t)
        hit, ids = set(), set()
        for n in lengths:
            for i in range(len(w) - n + 1):
                if owners := windows.get(tuple(w[i : i + n])):
                    hit.update(range(i, i + n))
                    ids |= owners
        out.append((doc_id, len(w), len(hit), len(ids), sha(",".join(sorted(ids))), bool(hit)))
    return out


PII = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def _luhn(x: str) -> bool:
    return sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(map(int, reversed(x)))) % 10 == 0


def op8_base(text: str | None) -> tuple:
    digits = lambda x: re.sub("[^0-9]", "", x)
    ok = {
        "email": lambda x: True,
        "ip": lambda x: all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or "0") <= 255 for p in x.split(".")),
        "card": lambda x: 16 <= len(digits(x)) <= 19 and _luhn(digits(x)),
        "phone": lambda x: 8 <= len(digits(x)) <= 15,
    }
    found = {k: [m.span() for m in re.finditer(p, text or "") if ok[k](m[0])] for k, p in PII.items()}
    return (*(len(v) for v in found.values()), sha(",".join(f"{k}:{s}:{e}" for k, v in found.items() for s, e in v)))


def op9_base(docs: list[tuple[int, str | None]]) -> list[tuple]:
    bags = [[*WORD.findall((t or "").translate(LOWER)), None] for _, t in docs]
    c = Counter(w for (d, _), b in zip(docs, bags, strict=True) if crc32(str(d).encode()) % 7 != 2 for w in b)
    n, v = sum(c.values()), len(c)
    return [
        (d, crc32(str(d).encode()) % 7 == 2, len(b), sum(c[w] > 0 for w in b), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in b))
        for (d, _), b in zip(docs, bags, strict=True)
    ]
