"""Slow and plain versions of the operators, for comparison on small tables."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import xxhash


def sha(s):
    return hashlib.sha256(s if isinstance(s, bytes) else s.encode()).hexdigest()


def lower(s):
    return re.sub("[A-Z]", lambda m: m[0].lower(), s or "")


def words(s):
    return re.findall(r"[^\x20\x09-\x0D]+", s or "")


def decontaminate(docs, items, n=10):
    find = lambda s: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(s))
    out = []
    own = []
    for item, text in items:
        w = find(text)
        k = min(n, len(w))
        if k:
            own.append(("null" if item is None else str(item), k, {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}))
    for doc, text in docs:
        w, hit, ids = find(text), set(), set()
        for item, k, windows in own:
            for i in range(len(w) - k + 1):
                if tuple(w[i : i + k]) in windows:
                    hit.update(range(i, i + k))
                    ids.add(item)
        out.append((doc, len(w), len(hit), len(ids), sha(",".join(sorted(ids))), bool(hit)))
    return out


def substring_dedup(docs, n=50):
    first = {}
    for doc, text in docs:
        w = words(text)
        for i in range(len(w) - n + 1):
            if doc is not None:
                k = tuple(w[i : i + n])
                first[k] = min(first.get(k, doc), doc)
    out = []
    for doc, text in docs:
        w = words(text)
        gone = set()
        for i in range(len(w) - n + 1):
            if doc is not None and first[tuple(w[i : i + n])] < doc:
                gone.update(range(i, i + n))
        out.append((doc, len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone))))
    return out


def fingerprint(text):
    w = words(lower(text))
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(fps, threshold=3):
    """Fingerprint -> the smallest fingerprint that it reaches."""
    fps = sorted(set(fps))
    up = {f: f for f in fps}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[i + 1 :]:
            if (a ^ b).bit_count() <= threshold:
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {f: root(f) for f in fps}


def simhash(docs):
    fp = [fingerprint(t) for _, t in docs]
    root = components(fp)
    least = {}
    for (doc, _), f in zip(docs, fp, strict=True):
        if doc is not None:
            least[root[f]] = min(least.get(root[f], doc), doc)
    return [(doc, f"{f:016x}", least.get(root[f])) for (doc, _), f in zip(docs, fp, strict=True)]


def targets(sizes, weights=(5, 2, 1), epochs=1.5, most=2):
    """Source -> target, by resharing the excess until none is above."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    fixed, rest = {}, epochs * sum(sizes.values())
    while True:
        free = [s for s in order if s not in fixed]
        total = sum(w[s] for s in free)
        share = {s: rest * w[s] / total for s in free}
        above = [s for s in free if share[s] > most * sizes[s]]
        if not above:
            return fixed | share
        for s in above:
            fixed[s] = most * sizes[s]
            rest -= fixed[s]


def crc(s):
    return zlib.crc32((s or "").encode())


PII = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(sum(divmod(int(x) * (1 + i % 2), 10)) for i, x in enumerate(reversed(d))) % 10 == 0


def pii(text):
    """kind -> base spans."""
    out = {}
    for kind, pattern in PII.items():
        out[kind] = []
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card" and not (16 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 8 <= len(digits) <= 15:
                continue
            out[kind].append((m.start(), m.end()))
    return out


def bigrams(text):
    w = re.sub(r"[\W_]+", " ", text.lower()).split()
    return Counter(zip(w, w[1:], strict=False))


def licenses(text, templates, threshold=0.8):
    best = {}
    text = text or ""
    lines, paragraphs = text.split("\n"), re.split(r"\n[ \t\r]*\n", text)
    runs = ["\n".join(x[i : i + n]) for x in (lines, paragraphs) for n in (1, 2, 3, 4) for i in range(len(x) - n + 1)]
    for part in {*runs, *re.split(r"[.!?][ \t\r\n]+", text), text}:
        a = bigrams(part)
        for name, template in templates:
            b = bigrams(template)
            if a and (dice := 2 * (a & b).total() / (a.total() + b.total())) >= threshold:
                best[name] = max(best.get(name, 0), dice)
    return best
