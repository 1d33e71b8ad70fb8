"""The operators' contracts once more, over Python lists and without Spark."""

from __future__ import annotations

import hashlib
import re
import zlib
from fractions import Fraction

SPACE = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text, pattern=SPACE):
    return pattern.findall((text or "").translate(LOWER))


def shingles(text, k=5):
    w = words(text)
    return {tuple(w[i : i + k]) for i in range(max(len(w) - k + 1, 1))} if w else set()


def components(docs, percent=80):
    """doc_id: (size of the set, component)."""
    sets = {i: shingles(t) for i, t in docs}
    up = {i: i for i in sets}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(i for i in sets if sets[i])
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((top(a), top(b)))
                up[y] = x
    return {i: (len(s), top(i)) for i, s in sets.items()}


def contamination(text, items):
    w = words(text, ALNUM)
    hit, found = set(), set()
    for item, t in items:
        b = words(t, ALNUM)
        k = min(13, len(b))
        windows = {tuple(b[i : i + k]) for i in range(len(b) - k + 1)} if b else set()
        for i in range(len(w) - k + 1) if b else ():
            if tuple(w[i : i + k]) in windows:
                hit.update(range(i, i + k))
                found.add(str(item))
    digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
    return len(w), len(hit), len(found), digest, bool(hit) and 20 * len(hit) >= len(w)


def quality(text):
    t = text or ""
    w = SPACE.findall(t)
    lines = [x for x in t.split("\n") if SPACE.search(x)]
    seen, repeated = {}, set()
    for i in range(len(w) - 2):
        seen.setdefault(tuple(w[i : i + 3]), []).append(i)
    for places in seen.values():
        if len(places) > 1:
            repeated.update(j for i in places for j in range(i, i + 3))
    failed = len(w) < 50 or 100 * len(repeated) > 50 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(repeated), failed


def dedup_lines(docs, percent=80):
    """doc_id: (lines, removed lines, text that stays)."""
    seen, out = [], {}
    for i, t in sorted(docs, key=lambda d: d[0]):
        stay = []
        for line in t.split("\n"):
            own = set(filter(None, re.split(r"[\x20\x09-\x0D]+", line.lower())))
            if own and any(100 * len(own & s) >= percent * len(own | s) for s in seen):
                seen.append(own)
                continue
            if own:
                seen.append(own)
            stay.append(line)
        n = t.count("\n") + 1
        out[i] = (n, n - len(stay), "\n".join(stay))
    return out


KINDS = [
    ("assign", re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 2, 12),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 18),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 16),
]


def secrets(text):
    spans = [(m.start(), k, name, m.end()) for k, (name, p, g, n) in enumerate(KINDS) for m in p.finditer(text or "") if len(m[g]) >= n]
    listed = ",".join(f"{name}:{a}:{b}" for a, _, name, b in sorted(spans))
    return [sum(s[2] == k for s in spans) for k in ("assign", "access", "hex")] + [hashlib.sha256(listed.encode()).hexdigest()]


def crc(ids):
    return zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))


def encoded(texts, path, end):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    return [e.ids + [end] for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def manifest(rows, arity=2):
    """Rows of the Merkle manifest of ``(doc_id, source, lang, n_chars, text)``: doc_id, lang, leaf, subroot, root, proof, folded root, verified."""
    h = lambda *x: hashlib.sha256("".join(x).encode()).hexdigest()
    leaf = lambda values: h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])

    def tree(leaves):
        levels = [leaves]
        while len(levels[-1]) > 1:
            below = levels[-1]
            levels.append([h(*below[i : i + arity]) for i in range(0, len(below), arity)])
        return levels

    def siblings(levels, i):
        for level in levels[:-1]:
            first = i - i % arity
            yield i - first, level[first:i] + level[i + 1 : first + arity]
            i //= arity

    groups = {}
    for d, source, lang, n, text in rows:
        bent = d is not None and n is not None and zlib.crc32(str(d).encode()) % 7 == 0
        groups.setdefault(lang, []).append((d, leaf((d, source, lang, n, text)), leaf((d, source, lang, n + 1 if bent else n, text))))
    langs = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    for own in groups.values():
        own.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    trees = [tree([x[1] for x in groups[lang]]) for lang in langs]
    upper = tree([t[-1][0] for t in trees])
    for k, lang in enumerate(langs):
        for i, (d, own, claimed) in enumerate(groups[lang]):
            proof, folded = [*siblings(trees[k], i), *siblings(upper, k)], claimed
            for at, others in proof:
                folded = h(*others[:at], folded, *others[at:])
            yield d, lang, own, trees[k][-1][0], upper[-1][0], h(*[x for _, others in proof for x in others]), folded, folded == upper[-1][0]


def runs(w):
    """``(start, length, period)`` of all stretches with a smallest period that repeats often enough."""
    smallest = {}
    for q in range(1, len(w)):
        i = 0
        while i + q < len(w):
            start = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            if i - start >= q:
                smallest.setdefault((start, i + q), q)
            i += 1
    return sorted((s, e - s, q) for (s, e), q in smallest.items() if e - s >= max(6, 4 * q))


def periodic(doc_id, text):
    """A row of op12 and the text that is left."""
    w = SPACE.findall(text or "")
    n, h = len(w), zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = runs(w)
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    left = " ".join(x for i, x in enumerate(w) if i not in gone)
    top = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return doc_id, len(found), *(top or (None,) * 3), 1000 * top[1] // top[2] if top else None, sha("".join(f"{s},{n},{q}\n" for s, n, q in found)), sha(left), left


def licenses(text, table, base, weights):
    """n_words, places of base phrases, their labels, all labels, score, and surviving spans, with every rule tried and all pairs of spans compared."""
    w = words(text, ALNUM)
    spaced, starts = " " + "  ".join(w) + " ", {}
    for i in range(len(w) + 1):
        starts[sum(len(x) + 2 for x in w[:i]) if i < 2000 else -i] = i
    places = [(label, i) for phrase, label in base.items() for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split()]
    spans = []
    for order, rule in enumerate(table):
        for m in re.finditer(rule.spaced, spaced):
            spans.append((starts[m.start()], starts[m.end()], rule.priority, order, rule.label))
    within = lambda x, y: y[0] <= x[0] and y[1] >= x[1] and y[2] >= x[2] and (y[:3] != x[:3] or y[3] < x[3])
    left = [x for x in spans if not any(within(x, y) for y in spans)]
    at = [i for _, i in places]
    own = sorted({label for label, _ in places})
    score = max((weights[x[2] - 1] for x in left), default=0.0)
    return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(own), ",".join(sorted({*own, *(x[4] for x in left)})), score, sorted((x[0], x[1], x[4], x[2]) for x in left)
