"""Plain versions of the operators for small inputs."""
import hashlib
import re
import zlib
from collections import Counter

PLAIN = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOW = {c: c + 32 for c in range(65, 91)}


def low(text):
    return (text or "").translate(_LOW)


def shingles(text, k=5):
    w = PLAIN.findall(low(text))
    if not w:
        return set()
    return {tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1))}


def near(rows, percent=75):
    """{row index: (n, component)} over (id, text) rows, all pairs."""
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    where = {}
    for i, s in enumerate(sets):
        for x in s:
            where.setdefault(x, []).append(i)
    pairs = {(a, b) for v in where.values() if len(v) < 400 for i, a in enumerate(v)
             for b in v[i + 1:]}
    for a, b in pairs:
        shared = len(sets[a] & sets[b])
        if 100 * shared >= percent * (len(sets[a]) + len(sets[b]) - shared):
            parent[find(a)] = find(b)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return [(d, len(sets[i]), least[find(i)], least[find(i)] == d) for i, (d, _) in enumerate(rows)]


def repeats(rows, length=400):
    return [(*r, hashlib.sha256(kept).hexdigest()) for *r, kept in cut(rows, length)]


def cut(rows, length=400):
    texts = [(t or "").encode() for _, t in rows]
    seen = Counter(t[p:p + length] for t in texts for p in range(len(t) - length + 1))
    out = []
    for (d, _), t in zip(rows, texts):
        gone = bytearray(len(t))
        for p in range(len(t) - length + 1):
            if seen[t[p:p + length]] > 1:
                gone[p:p + length] = b"\1" * length
        kept = bytes(b for b, g in zip(t, gone) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((d, len(t), sum(gone), spans, kept))
    return out


def passage_words(rows, length=51):
    """Words of each row in runs of ``length`` words that another row has too."""
    texts = [[w for w in re.split(r"[ \t-\r]+", t or "") if w] for _, t in rows]
    runs = [[tuple(w[i:i + length]) for i in range(len(w) - length + 1)] for w in texts]
    rows_with = Counter(x for r in runs for x in set(r))
    return [len({j for i, x in enumerate(r) if rows_with[x] > 1 for j in range(i, i + length)})
            for r in runs]


def quality_counts(text):
    text = text or ""
    w = PLAIN.findall(text)
    lines = [x for x in text.split("\n") if PLAIN.search(x)]
    windows = [tuple(w[i:i + 8]) for i in range(len(w) - 7)]
    n = Counter(windows)
    covered = {j for i, x in enumerate(windows) if n[x] > 1 for j in range(i, i + 8)}
    failed = len(w) < 20 or 100 * len(covered) > 30 * len(w)
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)),
            len(lines) - len(set(lines)), len(covered), failed)


def license_base(text, phrases):
    w = ALNUM.findall(low(text))
    found = [(i, label) for p, label in phrases.items() for i in range(len(w))
             if w[i:i + len(p.split())] == p.split()]
    at = [i for i, _ in found]
    return (len(w), len(found), min(at, default=None), max(at, default=None),
            ",".join(sorted({x for _, x in found})))


def contained(docs, items, percent=75):
    sets = [(i, shingles(t)) for i, t in items]
    out = []
    for d, t in docs:
        have = shingles(t)
        for i, s in sets:
            if s and 100 * len(s & have) >= percent * len(s):
                out.append((i, d, len(s), len(s & have)))
    return out


def fold(doc_id, modulus):
    return zlib.crc32(str(doc_id).encode()) % modulus
