"""Plain-Python statements of what the operators return, for small inputs."""

import hashlib
import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def shingles(text, size=2):
    w = words(lower(text))
    if len(w) >= size:
        return frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1))
    return frozenset([tuple(w)] if w else [])


def components(sets):
    """The least id reachable from each of (id, set) over links of similarity 0.8."""
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, (_, a) in enumerate(sets):
        for j in range(i):
            b = sets[j][1]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                root[find(i)] = find(j)
    least = {}
    for i, (own, _) in enumerate(sets):
        if own is not None:
            least[find(i)] = min(own, least.get(find(i), own))
    return [least.get(find(i)) for i in range(len(sets))]


def statistics(text):
    w = words(text)
    windows = list(zip(w, w[1:], w[2:]))
    often = Counter(windows)
    covered = {k + d for k, x in enumerate(windows) if often[x] > 1 for d in range(3)}
    seen, doubled = set(), 0
    for line in (text or "").split("\n"):
        doubled += line in seen and bool(words(line))
        seen.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), doubled, len(covered)


ASSIGN = re.compile(
    r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]"""
    r"""|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)


def secret_spans(text):
    text = text or ""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= 8]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(found))


def kept_words(rows, size=20):
    """n_words, n_removed and the digest of what is left of each (id, text), ids distinct and None last."""
    seen, out = set(), {}
    for own, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        w = words(text)
        gone = set()
        for s in range(len(w) - size + 1):
            window = tuple(w[s : s + size])
            if window in seen:
                gone.update(range(s, s + size))
            seen.add(window)
        left = [x for k, x in enumerate(w) if k not in gone]
        out[own] = (len(w), len(gone), hashlib.sha256(" ".join(left).encode()).hexdigest())
    return out
