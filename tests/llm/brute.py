"""Plain-Python statements of what the operators compute, for small fixtures."""

import re

AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WHITE = r"[^\x20\x09-\x0D]+"
PLAIN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def white_words(text):
    return re.findall(WHITE, text or "")


def plain_words(text):
    return re.findall(PLAIN, (text or "").translate(AZ))


def join(links, nodes):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def shingles(text, size=5):
    words = white_words((text or "").translate(AZ))
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def near_duplicates(docs, percent=75):
    sets = {}
    for i, t in docs:
        sets.setdefault(i, []).append(shingles(t))
    ids = sorted(sets)
    links = [
        (a, b)
        for x, a in enumerate(ids)
        for b in ids[:x]
        if any(s and t and 100 * len(s & t) >= percent * len(s | t) for s in sets[a] for t in sets[b])
    ]
    found = join(links, ids)
    return {i: (max(map(len, sets[i])), found[i], found[i] == i) for i in ids}


def contamination(docs, items, size=10):
    patterns = set()
    for item, text in items:
        words = plain_words(text)
        m = min(size, len(words))
        patterns |= {("" if item is None else str(item), tuple(words[i : i + m])) for i in range(len(words) - m + 1) if m}
    out = []
    for i, text in docs:
        words, hit, found = plain_words(text), set(), set()
        for item, p in patterns:
            for k in range(len(words) - len(p) + 1):
                if tuple(words[k : k + len(p)]) == p:
                    hit |= set(range(k, k + len(p)))
                    found.add(item)
        out.append((i, len(words), len(hit), sorted(found)))
    return out


def substring_dedup(docs, size=13):
    first = {}
    for i, text in docs:
        w = white_words(text)
        for k in range(len(w) - size + 1):
            key = tuple(w[k : k + size])
            first[key] = min(first.get(key, i), i)
    out = []
    for i, text in docs:
        w = white_words(text)
        gone = {j for k in range(len(w) - size + 1) if first[tuple(w[k : k + size])] < i for j in range(k, k + size)}
        out.append((i, len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)))
    return out
