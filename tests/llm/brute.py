"""Plain versions that the operators are held against."""

import collections
import hashlib
import math
import re

_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return _WORD.findall((text or "").translate(_LOWER))


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def contamination(docs, items):
    """(n_words, n_hit, items) of each document."""
    windows = {}
    for item, text in items:
        w = words(text)
        for s in range(max(len(w) - 10, 0) + 1 if w else 0):
            windows.setdefault(tuple(w[s:s + 10]), set()).add(item)
    out = []
    for i, text in docs:
        w = words(text)
        hit, found = [0] * len(w), set()
        for k in {len(x) for x in windows}:
            for s in range(len(w) - k + 1):
                got = windows.get(tuple(w[s:s + k]))
                if got:
                    found |= got
                    hit[s:s + k] = [1] * k
        out.append((i, len(w), sum(hit), sorted(str(x) for x in found if x is not None)))
    return out


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def personal(text):
    """Sorted (start, kind number, end)."""
    out = []
    for k, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            if (kind == "email" or kind == "ip" and all(int(p) <= 255 for p in m.group().split("."))
                    or kind == "card" and 14 <= len(digits) <= 19 and luhn(digits) or kind == "phone" and 10 <= len(digits) <= 15):
                out.append((m.start(), k, m.end()))
    return sorted(out)


def near_duplicate_classes(docs, threshold=0.8):
    """Sets of row numbers; weights as the operator's, with exact document frequencies."""
    bags = []
    for _, text in docs:
        w = words(text)
        bags.append(collections.Counter(tuple(w[j:j + 5]) for j in range(max(1, len(w) - 4))) if w else collections.Counter())
    df, n = collections.Counter(s for b in bags for s in b), len(docs)
    weight = {s: math.sqrt(1 + math.log(n / c) / math.log(max(n, 2))) for s, c in df.items()}
    parent = list(range(n))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    total = [sum(c * weight[s] for s, c in b.items()) for b in bags]
    for x in range(n):
        for y in range(x):
            both = sum(min(c, bags[y][s]) * weight[s] for s, c in bags[x].items() if s in bags[y])
            if both and both >= threshold * (total[x] + total[y] - both) or not bags[x] and not bags[y] and (docs[x][1] or "") == (docs[y][1] or ""):
                parent[root(x)] = root(y)
    out = collections.defaultdict(set)
    for x in range(n):
        out[root(x)].add(x)
    return {frozenset(v) for v in out.values()}


def repeated_words(docs, n):
    """Ids of documents with a run of ``n`` words that a document of another id has."""
    seen = collections.defaultdict(set)
    for i, text in docs:
        w = words(text)
        for j in range(len(w) - n + 1):
            seen[tuple(w[j:j + n])].add(i)
    return {i for ids in seen.values() if len(ids) > 1 for i in ids}
