"""Brute force in plain Python."""

import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
PLAIN = re.compile(r"[^\x20\x09-\x0D!\"#$%&'()*+,\-./:;<=>?@\[\\\]^_`{|}~]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall(text or "")


def shingle_set(text, size=5):
    w = words((text or "").translate(LOWER))
    return frozenset(tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))) if w else frozenset()


def near_groups(docs, least=0.8):
    """By id: (smallest id of the group, smallest id with the same set, links)."""
    sets = {i: shingle_set(t) for i, t in docs.items()}
    first = {}
    for i in sorted(sets):
        if sets[i]:
            first.setdefault(sets[i], i)
    root, links = {i: i for i in first.values()}, {i: 0 for i in first.values()}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    classes = list(first.items())
    for a, (s, i) in enumerate(classes):
        for t, j in classes[a + 1 :]:
            both = len(s & t)
            if both and both >= least * (len(s) + len(t) - both):
                links[i] += 1
                links[j] += 1
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {
        i: (find(first[s]), first[s], links[first[s]]) if s else (i, i, 0) for i, s in sets.items()
    }


def infix_edits(item, text):
    prev = [0] * (len(text) + 1)
    for i, x in enumerate(item):
        now = [i + 1]
        for j, y in enumerate(text):
            now.append(min(prev[j] + (x != y), prev[j + 1] + 1, now[j] + 1))
        prev = now
    return min(prev)


def removed_words(docs, size=50):
    """By id: (words, removed, kept words joined)."""
    split, first = {i: words(t) for i, t in docs.items()}, {}
    for i in sorted(split):
        for k in range(len(split[i]) - size + 1):
            first.setdefault(tuple(split[i][k : k + size]), i)
    out = {}
    for i, w in split.items():
        gone = [False] * len(w)
        for k in range(len(w) - size + 1):
            if first[tuple(w[k : k + size])] < i:
                gone[k : k + size] = [True] * size
        out[i] = (len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g))
    return out
