"""Plain versions to compare with."""

import collections


def brute_links(rows):
    sets = {}
    for i, t in rows:
        w = (t or "").lower().split()
        sets[i] = {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()
    above = {i: i for i in sets}

    def find(x):
        while above[x] != x:
            x = above[x]
        return x

    links = collections.Counter()
    ids = sorted(sets)
    for a in range(len(ids)):
        for b in range(a + 1, len(ids)):
            x, y = sets[ids[a]], sets[ids[b]]
            if x and y and 5 * len(x & y) >= 4 * len(x | y):
                links[ids[a]] += 1
                links[ids[b]] += 1
                p, q = find(ids[a]), find(ids[b])
                above[max(p, q)] = min(p, q)
    return {i: (find(i), links[i], len(sets[i])) for i in ids}
