"""Brute-force versions of pipeline stages on small lists of (id, text)."""

from collections import defaultdict

WS = " \t\n\x0b\x0c\r"


def lower(t):
    return "".join(c.lower() if c.isascii() else c for c in t)


def brute_lines_text(rows, min_chars=40, min_docs=5):
    where = defaultdict(set)
    key = lambda x: lower(x.strip(WS))
    for i, t in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= min_chars:
                where[key(x)].add(i)
    last = {k: max(v) for k, v in where.items() if len(v) >= min_docs}
    return [(i, "\n".join(x for x in (t or "").split("\n") if last.get(key(x), i) == i)) for i, t in rows]


def near_kept(rows, num, den):
    sets = {}
    for i, t in rows:
        w = lower(t).split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    up = {i: i for i, _ in rows}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(i for i in sets if sets[i])
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return [(i, t) for i, t in rows if find(i) == i]
