"""Plain definitions of the operators' results, for small tables."""

import collections
import hashlib
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def line_counts(doc_id, text):
    text = text or ""
    found, seen, dup = words(text), set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    grams = [tuple(found[i : i + 3]) for i in range(len(found) - 2)]
    often = collections.Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if often[g] > 1 for k in range(3)}
    n = len(found)
    failed = n < 50 or 100 * len(covered) > 50 * n
    return doc_id, n, sum(map(len, found)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered), failed


def word_repeats(rows, window):
    listed = [(d, (t or "").encode().split()) for d, t in rows]
    least = {}
    for d, w in listed:
        for i in range(len(w) - window + 1 if d is not None else 0):
            g = tuple(w[i : i + window])
            least[g] = min(least.get(g, d), d)
    out = collections.Counter()
    for d, w in listed:
        gone = set()
        for i in range(len(w) - window + 1 if d is not None else 0):
            if least[tuple(w[i : i + window])] < d:
                gone |= set(range(i, i + window))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out[(d, len(w), len(gone), hashlib.sha256(kept).hexdigest())] += 1
    return out


def byte_repeats(rows, length):
    raws = [(d, (t or "").encode()) for d, t in rows]
    often = collections.Counter(b[i : i + length] for _, b in raws for i in range(len(b) - length + 1))
    out = collections.Counter()
    for d, b in raws:
        gone, upto = bytearray(len(b)), 0
        for i in range(len(b) - length + 1):
            if often[b[i : i + length]] > 1:
                for k in range(max(upto, i), i + length):
                    gone[k] = 1
                upto = i + length
        kept = bytes(x for x, f in zip(b, gone) if not f)
        spans = sum(gone[k] and (k == 0 or not gone[k - 1]) for k in range(len(b)))
        out[(d, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())] += 1
    return out


def shingles(text, n=5):
    found = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w) for w in words(text)]
    if len(found) < n:
        return frozenset([tuple(found)] if found else [])
    return frozenset(tuple(found[i : i + n]) for i in range(len(found) - n + 1))


def similar_components(rows, n=5, percent=80):
    sets = {d: shingles(t, n) for d, t in rows if d is not None}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return collections.Counter((d, len(shingles(t, n)), None if d is None else find(d)) for d, t in rows)
