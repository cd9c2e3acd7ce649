"""Plain versions of the source audit, the secret scan and the manifest."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
UPPER = {c: c + 32 for c in range(65, 91)}


def rate(n, total, kept):
    return 1 + 1_000_000_000 * (n + 5) // (total + 5 * kept)


def divergence_rows(docs, least, k):
    """Every group's rate of every kept term."""
    docs = [tuple(x or "" for x in d) for d in docs]
    found = []
    for lang in {d[0] for d in docs}:
        own = [(s, TERM.findall(t.translate(UPPER))) for x, s, t in docs if x == lang]
        seen = Counter(w for _, t in own for w in set(t))
        kept = [w for w in seen if seen[w] >= least]
        groups = {s: Counter() for s, _ in own}
        for s, t in own:
            groups[s].update(w for w in t if seen[w] >= least)
        every = sum(groups.values(), Counter())
        p = {s: {w: rate(g[w], sum(g.values()), len(kept)) for w in kept} for s, g in groups.items()}
        q = {w: rate(every[w], sum(every.values()), len(kept)) for w in kept}
        for s in groups:
            pairs = [(sum(abs(p[s][w] - p[o][w]) for w in kept), o) for o in groups if o != s]
            words = [(p[s][w] - q[w], w) for w in kept if groups[s][w] and p[s][w] > q[w]]
            for part, rows, most in (("pair", pairs, len(pairs)), ("term", words, k)):
                ranked = sorted(rows, key=lambda r: (-r[0], r[1].encode()))[:most]
                found += [(lang, s, part, item, value, n) for n, (value, item) in enumerate(ranked, 1)]
    return found


ASSIGN = re.compile(r"(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")


def secret_rows(docs):
    """``docs``: id, text, owner, repository."""
    found, owners = [], {}
    for i, text, owner, _ in docs:
        t = text or ""
        base = [(m.start(), 0, "assign", m.end(), m[1]) for m in ASSIGN.finditer(t) if len(m[1]) >= 6]
        base += [(m.start(), 1, "access", m.end(), m[0]) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        base += [(m.start(), 2, "hex", m.end(), m[0]) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        more = [(m.start(), 3, "owned", m.end(), m[0]) for m in re.finditer("[A-Za-z0-9+/_=-]{20,}", t)]
        more = [m for m in more if len(set(m[4])) >= 12 and all(re.search(c, m[4]) for c in ("[A-Z]", "[a-z]", "[0-9]")) and not any(b[0] < m[3] and b[3] > m[0] for b in base)]
        for m in base + more:
            owners.setdefault(m[4], set()).add(owner or "")
        found.append((i, sorted(base), sorted(base + more)))
    rows = []
    for i, base, every in found:
        told = lambda ms: ",".join(f"{m[2]}:{m[0]}:{m[3]}" for m in ms)
        every = [m for m in every if m[1] < 3 or len(owners[m[4]]) == 1]
        rows.append((i, *(sum(b[1] == k for b in base) for k in range(3)), hashlib.sha256(told(base).encode()).hexdigest(), told(every), sum(len(owners[m[4]]) == 1 for m in every), sum(len(owners[m[4]]) >= 3 for m in every)))
    return rows


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def told(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def levels(nodes):
    found = [nodes]
    while len(found[-1]) > 1:
        found.append([digest(*found[-1][k : k + 3]) for k in range(0, len(found[-1]), 3)])
    return found


def manifest_rows(rows, now):
    """``rows``: doc_id, source, lang, n_chars, text; ``now``: the present text of some ids."""
    trees = {}
    for r in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, digest(*map(told, r)))):
        trees.setdefault(r[1], []).append(r)
    sources = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    own = {s: levels([digest(*map(told, r)) for r in trees[s]]) for s in sources}
    top = levels([own[s][-1][0] for s in sources])
    found = []
    for j, s in enumerate(sources):
        for i, r in enumerate(trees[s]):
            path = []
            for tree, k in ((own[s], i), (top, j)):
                for nodes in tree[:-1]:
                    a = k - k % 3
                    path.append((k - a, [nodes[x] for x in range(a, min(a + 3, len(nodes))) if x != k]))
                    k //= 3
            got = digest(*map(told, (*r[:4], now.get(r[0], r[4]))))
            for place, siblings in path:
                got = digest(*siblings[:place], got, *siblings[place:])
            found.append((r[0], own[s][0][i], own[s][-1][0], top[-1][0], digest(*(x for _, run in path for x in run)), got, got == top[-1][0]))
    return found
