"""Plain versions that the tests compare with."""

import re

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words_of(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())


def lower(word):
    return bytes(c + 32 if 65 <= c <= 90 else c for c in word)


def shingle_set(text, k):
    w = [lower(x) for x in words_of(text)]
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1)))


def union_find(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}
