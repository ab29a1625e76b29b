"""The operators once more in plain Python, by brute force, for small tables."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import defaultdict
from fractions import Fraction

import numpy as np
import xxhash

# One text per kind of trouble: none, no word, white space of all kinds, marks of the tokenizers, other scripts.
ODD = [
    None, "", " ", "   ", "\t\n", "one", "two words", "  a  b   c ", "x\n  word \n y\r\n\r\n z", "I'm it's 's don't",
    "a <|endoftext|> b<|endoftext|><|startoftext|>", "x  y　z", "日本語 テキスト 🙂 🙂", "é é ŉ ΣΑΣ İi", "á ́b",
    "x " + "ab" * 9000, "same text here", "same text here", "<s> </s> <unk> <0x0A> ▁ a▁b", "w " * 30000 + "end",
]


def table(spark, texts, first: int = 0):
    """Documents with these texts, a null key, a repeated row, and columns whose names operators use themselves."""
    rows = [(first + i, t, "en", "src0", 1, True, i) for i, t in enumerate(texts)]
    rows += [(None, "no key", "en", None, None, None, None), rows[-1]]
    schema = "doc_id long, text string, lang string, source string, n_words long, kept boolean, id long"
    return spark.createDataFrame(rows, schema)


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


def words(text, fold: bool = False) -> list[str]:
    text = text or ""
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text) if fold else text
    return [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]


def grams(text, n: int) -> frozenset:
    w = words(text, True)
    return frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()


def joined(rows, n: int = 3, percent: int = 90):
    """Size and component of every row with a key."""
    sets = [grams(t, n) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    first, holders = {}, defaultdict(list)
    for j, (key, _) in enumerate(rows):
        parent[root(j)] = root(first.setdefault(key, j))
    for j, s in enumerate(sets):
        both = defaultdict(int)
        for g in s:
            for other in holders[g]:
                both[other] += 1
            holders[g].append(j)
        for other, c in both.items():
            if 100 * c >= percent * (len(s) + len(sets[other]) - c):
                parent[root(j)] = root(other)
    low = {}
    for j, (key, _) in enumerate(rows):
        low[root(j)] = min(low.get(root(j), key), key)
    return sorted((key, len(sets[j]), low[root(j)]) for j, (key, _) in enumerate(rows))


def simhash(text) -> int:
    w = words(text)
    if not w:
        return 0
    terms = []
    for i in range(max(len(w) - 2, 1)):
        seed = 42
        for word in w[i : i + 3]:
            seed = xxhash.xxh64(word.encode(), seed=seed).intdigest()
        terms.append(seed)
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in terms) > len(terms))


def fingerprints(rows):
    rows = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), (r[1] or "").encode()))
    prints = [simhash(t) for _, t in rows]
    far = lambda a, b: bin(a ^ b).count("1")
    out = []
    for j, (key, text) in enumerate(rows):
        text, after, k = text or "", rows[(j + 1) % len(rows)][1] or "", len(rows[j][1] or "") // 2
        edited = text[: len(text) - k] + after[:k]
        own, other, following = prints[j], simhash(edited), prints[(j + 1) % len(rows)]
        within = sum(far(own, p) <= 3 for p in prints) if key is not None and key % 50 == 0 else None
        digest = hashlib.sha256(edited.encode()).hexdigest()
        out.append((key, len(text), digest, f"{own:016x}", f"{other:016x}", 1 - far(own, other) / 64, 1 - far(own, following) / 64, within))
    return sorted(out, key=str)


def measures(text) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text, w = text or "", words(text)
    lines = [x for x in text.split("\n") if words(x)]
    where = defaultdict(list)
    for i in range(len(w) - 7):
        where[tuple(w[i : i + 8])].append(i)
    covered = {i + k for places in where.values() if len(places) > 1 for i in places for k in range(8)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def changed(key, w: list[str]) -> list[str]:
    """The words with the period that the key plants."""
    h = zlib.crc32(str(key).encode()) if key is not None else 1
    if h % 10 or not w:
        return w
    a = h // 10 % len(w)
    p = 1 + (len(w) - a) // (3 + h // 10 % 8)
    return [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]


def runs(w: list[str]) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs: every period, every maximal stretch, smallest period of each."""
    n, spans = len(w), {}
    ids = np.unique(np.array(w, object), return_inverse=True)[1] if w else np.zeros(0, int)
    for q in range(1, n // 4 + 1):
        same = np.concatenate([[0], (ids[:-q] == ids[q:]).astype(int), [0]])
        starts, ends = np.flatnonzero(np.diff(same) == 1), np.flatnonzero(np.diff(same) == -1)
        for s, e in zip(starts.tolist(), ends.tolist()):
            if e - s + q >= max(6, 4 * q):
                spans.setdefault((s, e - s + q), q)
    return sorted((s, m, q) for (s, m), q in spans.items())


def periodic(rows):
    out = []
    for key, text in rows:
        w = changed(key, words(text))
        found = sorted(runs(w), key=lambda r: (r[0], r[2]))
        top = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
        gone = {i for s, m, q in found for i in range(s + q, s + m)}
        listed = "".join(f"{s},{m},{q}\n" for s, m, q in found)
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        head = (top[0], top[1], top[2], 1000 * top[1] // top[2]) if top else (None,) * 4
        out.append((key, len(found), *head, *(hashlib.sha256(x.encode()).hexdigest() for x in (listed, kept))))
    return sorted(out, key=str)


def contaminated(docs, items):
    fold = lambda t: re.findall("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    holders = defaultdict(set)
    for key, text in items:
        w = fold(text)
        for i in range(max(1, len(w) - 9) if w else 0):
            holders[tuple(w[i : i + 10])].add(key)
    sizes = {len(x) for x in holders}
    out = []
    for key, text in docs:
        w, hit, names = fold(text), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                own = holders.get(tuple(w[i : i + n]))
                if own:
                    hit.update(range(i, i + n))
                    names |= own
        listed = sorted(str(x) for x in names if x is not None)
        out.append((key, len(w), len(hit), len(listed), hashlib.sha256(",".join(listed).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def hard_negatives(rows, anchor, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95):
    """Rows (id, vector, label), equal ones once; every pair is scored."""
    sound = {(k, tuple(math.floor(256 * x) for x in v), g) for k, v, g in rows if None not in (k, v, g) and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for a in sound:
        if not anchor(a[0]):
            continue
        scored = {(-sum(x * y for x, y in zip(a[1], b[1])), b[0], b[2] == a[2]) for b in sound if b != a}
        for ps, p, _ in sorted(x for x in scored if x[2])[:positives]:
            fit = sorted((ns, n) for ns, n, same in scored if not same and low * -ps <= 100 * -ns <= high * -ps)
            out += [(a[0], p, i + 1, n, -ps, -ns) for i, (ns, n) in enumerate(fit[:negatives])]
    return sorted(out, key=str)
