"""Plain Python forms of what the operators compute, for small tables."""

import collections
import hashlib
import math
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t)


def base_counts(t):
    t = t or ""
    w = WORD.findall(t)
    seen, dup = set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    tri = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    marked = {i + j for i in range(len(w) - 2) if tri[tuple(w[i : i + 3])] >= 2 for j in range(3)}
    return len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), dup, len(marked), len(w) < 50 or 100 * len(marked) > 50 * len(w)


def shingle_set(t, k):
    w = WORD.findall(lower(t or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def components(texts, k, percent):
    """doc id -> (set size, component) for a dict of texts."""
    sets = {d: shingle_set(t, k) for d, t in texts.items()}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            shared = len(sets[a] & sets[b])
            if shared and shared * 100 >= (len(sets[a]) + len(sets[b]) - shared) * percent:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in ids}


def contained(texts, items, k=5, percent=80):
    out = set()
    words = lambda t: [w for w in re.split(r"[\x20\x09-\x0D]+", (t or "").lower()) if w]
    grams = lambda w: {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}
    docs = {d: grams(words(t)) for d, t in texts.items()}
    for i, t in items.items():
        s = grams(words(t))
        for d, g in docs.items():
            shared = len(s & g)
            if s and 100 * shared >= percent * len(s):
                out.add((d, i, len(s), shared))
    return out


def passages(texts, least=50):
    words = {d: WORD.findall(lower(t or "")) for d, t in texts.items()}
    own = collections.defaultdict(set)
    for d, w in words.items():
        for i in range(len(w) - least + 1):
            own[tuple(w[i : i + least])].add(d)
    out = set()
    for d, w in words.items():
        cover = [False] * (len(w) + 1)
        for i in range(len(w) - least + 1):
            if len(own[tuple(w[i : i + least])]) > 1:
                cover[i : i + least] = [True] * least
        i = 0
        while i < len(w):
            if cover[i]:
                j = i
                while cover[j]:
                    j += 1
                out.add((d, i, j - i))
                i = j
            i += 1
    return out


ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def secret_spans(t):
    t = t or ""
    s = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 6]
    s += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if m.end() - m.start() >= 20]
    s += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", t) if m.end() - m.start() >= 24]
    return sorted(s)


def secret_row(t):
    s = secret_spans(t)
    said = ",".join(f"{x[2]}:{x[0]}:{x[3]}" for x in s)
    return (*(sum(x[1] == k for x in s) for k in range(3)), hashlib.sha256(said.encode()).hexdigest())


MARKS = "".join(chr(i) for i in range(33, 127) if not chr(i).isalnum())


def toxic_words(t):
    """Words in lower case without up to three marks at each end, one after the other, the last mark first."""
    out = []
    for w in WORD.findall(lower(t or "")):
        for _ in range(3):
            if len(w.encode()) > 1 and w[-1] in MARKS:
                w = w[:-1]
            if len(w.encode()) > 1 and w[0] in MARKS:
                w = w[1:]
        out.append(w)
    return out


def kneser_ney(texts, toxic, ordinary, stem_bytes=5):
    """A function word -> (log P_toxic - log P, log P_ordinary - log P) from lists of texts: all, of toxic ones and of ordinary ones."""

    def contexts(some):
        seen = collections.defaultdict(set)
        for t in some:
            w = toxic_words(t)
            for a, b in zip([None, *w], w):
                seen[b].add(a)
        return collections.Counter({w: len(s) for w, s in seen.items()})

    def by_stem(counts):
        out = collections.Counter()
        for w, n in counts.items():
            out[w.encode()[:stem_bytes]] += n
        return out

    def level(counts):
        n = [max(sum(v == k for v in counts.values()), 1) for k in (1, 2, 3, 4)]
        y = n[0] / (n[0] + 2 * n[1])
        d = [0, *(min(max(k - (k + 1) * y * n[k] / n[k - 1], 0.1), k - 0.05) for k in (1, 2, 3))]
        total = sum(counts.values())
        taken = {w: max(v - d[min(v, 3)], 0) / total for w, v in counts.items()}
        return taken, 1 - sum(taken.values())

    every = contexts(texts)
    stems, total = by_stem(every), sum(every.values())
    models = []
    for some in (toxic, ordinary):
        counts = contexts(some)
        models.append((*level(counts), *level(by_stem(counts))))

    def relative(w):
        s = w.encode()[:stem_bytes]
        out = []
        for high, rest, low, low_rest in models:
            below = low.get(s, 0) / (stems[s] / total) + low_rest if stems[s] else low_rest
            out.append(math.log((high.get(w, 0) / (every[w] / total) if every[w] else 0) + rest * below))
        return tuple(out)

    return relative


def largest_span(differences, span=3):
    n = len(differences)
    return max(sum(differences[i : i + span]) / span for i in range(n - span + 1)) if n >= span else sum(differences) / max(n, 1)
