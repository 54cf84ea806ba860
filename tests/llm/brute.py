"""Plain versions of the operators, for small inputs."""

import hashlib
import math
import re
from collections import Counter, defaultdict

MAX = 2**63 - 1


def sha(b):
    return hashlib.sha256(b).hexdigest()


def suffix(rows, width=200, keep_first=False):
    """(n_bytes, n_removed, n_spans, sha256) of each (doc_id, text)."""
    out = []
    for b, gone in _suffix_marks(rows, width, keep_first):
        spans = sum(1 for j in range(len(b)) if gone[j] and (j == 0 or not gone[j - 1]))
        out.append((len(b), sum(gone), spans, sha(bytes(x for x, g in zip(b, gone) if not g))))
    return out


def suffix_kept(rows, width=200, keep_first=False):
    """The bytes that stay of each (doc_id, text)."""
    return [bytes(x for x, g in zip(b, gone) if not g) for b, gone in _suffix_marks(rows, width, keep_first)]


def _suffix_marks(rows, width, keep_first):
    raws = [(MAX if i is None else i, (t or "").encode()) for i, t in rows]
    count, first = Counter(), {}
    for i, b in raws:
        for k in range(len(b) - width + 1):
            w = b[k : k + width]
            count[w] += 1
            first[w] = min(first.get(w, (MAX + 1, 0)), (i, k))
    out = []
    for i, b in raws:
        gone = bytearray(len(b))
        for k in range(len(b) - width + 1):
            w = b[k : k + width]
            if (first[w] < (i, k)) if keep_first else count[w] > 1:
                gone[k : k + width] = b"\1" * width
        out.append((b, gone))
    return out


def windows(rows, width=20):
    """(n_words, n_removed, sha256) of each (doc_id, text)."""
    split = [(MAX if i is None else i, (t or "").encode().split()) for i, t in rows]
    first = {}
    for i, w in split:
        for k in range(len(w) - width + 1):
            key = tuple(w[k : k + width])
            first[key] = min(first.get(key, (MAX + 1, 0)), (i, k))
    out = []
    for i, w in split:
        gone = [False] * len(w)
        for k in range(len(w) - width + 1):
            if first[tuple(w[k : k + width])] < (i, k):
                gone[k : k + width] = [True] * width
        out.append((len(w), sum(gone), sha(b" ".join(x for x, g in zip(w, gone) if not g))))
    return out


def shingles(text):
    low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def near(rows, percent=75):
    """(n_shingles, component_id) of each (doc_id, text)."""
    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    having = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            having[x].append(i)
    for i, s in enumerate(sets):
        for j, both in Counter(j for x in s for j in having[x] if j < i).items():
            if 100 * both >= percent * (len(s) + len(sets[j]) - both):
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    groups = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        groups[root(i)].append(d)
    least = {r: min((d for d in ds if d is not None), default=None) for r, ds in groups.items()}
    return [(len(s), least[root(i)]) for i, s in enumerate(sets)]


BASE, MIX_A, MIX_B, WRAP = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 2**64


def finalised(x):
    x ^= x >> 30
    x = x * MIX_A % WRAP
    x ^= x >> 27
    x = x * MIX_B % WRAP
    return x ^ x >> 31


def word_hash(word):
    return finalised((sum((b + 1) * pow(BASE, i, WRAP) for i, b in enumerate(word)) + len(word)) % WRAP)


def run_hash(hashes):
    out = 0
    for h in hashes:
        out = (out * BASE + h) % WRAP
    return finalised(out)


def quality_features(text, bits):
    """Place to value of the hashed word and word-shape n-grams of a text."""
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())
    lower = [word_hash(bytes(b + 32 if 65 <= b <= 90 else b for b in w)) for w in words]

    def kind(b):
        return 5 if b >= 128 else 2 if 65 <= b <= 90 else 1 if 97 <= b <= 122 else 3 if 48 <= b <= 57 else 4 if 33 <= b <= 126 else 0

    shapes = []
    for i, w in enumerate(words):
        shape = kind(w[0]) * 6 + kind(w[-1])
        for k in (2, 3, 4):
            shape = shape * 3 + min(2, sum(kind(b) == k for b in w))
        shapes.append(finalised((shape * 2 + (i > 0 and w == words[i - 1]) + 2**40) % WRAP))
    grams = lower + [run_hash(lower[i : i + 2]) for i in range(len(lower) - 1)]
    for n in (1, 2, 3):
        grams += [run_hash(shapes[i : i + n]) ^ (n * BASE & 2**60 - 1) for i in range(len(shapes) - n + 1)]
    counts = Counter(g % 2**bits for g in grams)
    return {p: (n / len(grams)) ** 0.5 for p, n in counts.items()}


def follow_the_leader(rows, orders, alpha, beta, l1, l2):
    """Weights and bias of logistic regression, one coordinate and one row (features, label) at a time."""
    z, n, bias, bias_n = defaultdict(float), defaultdict(float), 0.0, 1.0

    def weight(i):
        if abs(z[i]) <= l1:
            return 0.0
        return -(z[i] - (l1 if z[i] > 0 else -l1)) / ((beta + n[i] ** 0.5) / alpha + l2)

    for order in orders:
        for k in order:
            x, y = rows[k]
            w = {i: weight(i) for i in x}
            p = 1 / (1 + math.exp(-max(-35, min(35, sum(w[i] * v for i, v in x.items()) + bias))))
            for i, v in x.items():
                g = (p - y) * v
                z[i] += g - ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / alpha * w[i]
                n[i] += g * g
            bias_n += (p - y) ** 2
            bias -= 0.1 * (p - y) / bias_n**0.5
    return {i: weight(i) for i in z}, bias


def topic(text):
    raw = text.encode()
    for name, members, share in (("numbers", b"0123456789", 0.05), ("table", b"|\t", 0.02), ("signs", b"#$%&*!<>{}=@_/\\", 0.03)):
        if sum(b in members for b in raw) > share * max(1, len(raw)):
            return name
    return "prose"


def raked(rows, given, power, keep, rounds=400):
    """Probability of each (source, lang, text): shares of one margin after the other are set to their targets."""
    cells = [(s, g, topic(t)) for s, g, t in rows]
    have = Counter()
    for c, (_, _, t) in zip(cells, rows):
        have[c] += len(t.encode().split())
    total = sum(have.values())
    targets = []
    for m, name in enumerate(("source", "lang", "topic")):
        own = Counter()
        for c, n in have.items():
            own[c[m]] += n
        base = {v: given.get(name, {}).get(v, (n / total) ** power if name in given else n**power) for v, n in own.items()}
        targets.append({v: x / sum(base.values()) for v, x in base.items()})
    now = {c: n / total for c, n in have.items()}
    for _ in range(rounds):
        for m, target in enumerate(targets):
            sums = Counter()
            for c, x in now.items():
                sums[c[m]] += x
            now = {c: x * target[c[m]] / sums[c[m]] for c, x in now.items()}
    return [keep * total * now[c] / have[c] for c in cells]


def capped(cells, targets, whole, rounds=300):
    """Probabilities min(1, product of a factor of each value) of cells {key: tokens}; factors found by halving, one at a time."""
    factors = [dict.fromkeys(t, 1.0) for t in targets]
    p = lambda c: min(1.0, factors[0][c[0]] * factors[1][c[1]] * factors[2][c[2]])
    for _ in range(rounds):
        for m, target in enumerate(targets):
            for v, share in target.items():
                low, high = 0.0, 1e6
                for _ in range(80):
                    factors[m][v] = (low + high) / 2
                    if sum(n * p(c) for c, n in cells.items() if c[m] == v) < share * whole:
                        low = factors[m][v]
                    else:
                        high = factors[m][v]
    return {c: p(c) for c in cells}
