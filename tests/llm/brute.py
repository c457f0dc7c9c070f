"""Plain versions of the operators, for small inputs."""

import hashlib
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def repeats_by_word(rows, window=50):
    """(doc_id, n_words, n_removed, kept_sha256) of (doc_id, text) rows."""
    least = {}
    words = [(d, WORD.findall(t or "")) for d, t in rows]
    rank = lambda d: (d is None, d or 0)
    for d, w in words:
        for i in range(len(w) - window + 1):
            k = tuple(w[i : i + window])
            least[k] = min(least.get(k, rank(d)), rank(d))
    out = []
    for d, w in words:
        gone = set()
        for i in range(len(w) - window + 1):
            if least[tuple(w[i : i + window])] < rank(d):
                gone.update(range(i, i + window))
        out.append((d, len(w), len(gone), hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest()))
    return out


def repeats_by_byte(rows, window=50):
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256)."""
    least = {}
    texts = [(d, (t or "").encode()) for d, t in rows]
    rank = lambda d: (d is None, d or 0)
    for d, b in texts:
        for i in range(len(b) - window + 1):
            k = b[i : i + window]
            least[k] = min(least.get(k, rank(d)), rank(d))
    out = []
    for d, b in texts:
        gone = bytearray(len(b))
        for i in range(len(b) - window + 1):
            if least[b[i : i + window]] < rank(d):
                gone[i : i + window] = b"\1" * window
        spans = len(re.findall(rb"\x01+", bytes(gone)))
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return out


def near_classes(rows):
    """(doc_id, n_shingles, component_id, kept), row by row; no doc_id is null."""
    sets = []
    for _, t in rows:
        w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    where = {}
    for i, s in enumerate(sets):
        counts = {}
        for x in s:
            for j in where.setdefault(x, []):
                counts[j] = counts.get(j, 0) + 1
            where[x].append(i)
        for j, n in counts.items():
            if 100 * n >= 75 * (len(s) + len(sets[j]) - n):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return [(d, len(s), least[find(i)], d == least[find(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))]
