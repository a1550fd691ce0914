"""Plain versions of the operators for small inputs."""

import hashlib
import re
from collections import defaultdict

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall((text or "").encode())


def substring(docs, n=20):
    """docs: [(doc_id, text)] -> {doc_id: (n_words, n_removed, sha)}"""
    seen, out = set(), {}
    for doc_id, text in sorted(docs):
        w = words(text)
        drop = [False] * len(w)
        for i in range(len(w) - n + 1):
            key = tuple(w[i : i + n])
            if key in seen:
                drop[i : i + n] = [True] * n
            seen.add(key)
        out[doc_id] = (len(w), sum(drop), hashlib.sha256(b" ".join(x for x, d in zip(w, drop) if not d)).hexdigest())
    return out


def suffix(docs, n=400):
    """-> {doc_id: (n_bytes, n_removed, n_spans, sha)}"""
    count = defaultdict(int)
    raw = {d: (t or "").encode() for d, t in docs}
    for b in raw.values():
        for i in range(len(b) - n + 1):
            count[hash(b[i : i + n])] += 1
    out = {}
    for d, b in raw.items():
        drop, at = bytearray(len(b)), 0
        for i in range(len(b) - n + 1):
            if count[hash(b[i : i + n])] > 1:
                at = max(at, i)
                drop[at : i + n] = b"\1" * (i + n - at)
                at = i + n
        spans = len(re.findall(rb"\x01+", bytes(drop)))
        out[d] = (len(b), sum(drop), spans, hashlib.sha256(bytes(x for x, k in zip(b, drop) if not k)).hexdigest())
    return out


def jaccard(docs, n=5):
    """-> {doc_id: (n_shingles, component)}"""
    sets, by = {}, defaultdict(list)
    for d, t in docs:
        w = [re.sub(rb"[A-Z]", lambda m: m[0].lower(), x) for x in words(t)]
        sets[d] = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()
        for s in sets[d]:
            by[s].append(d)
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    pairs = set()
    for group in by.values():
        pairs |= {(a, b) for i, a in enumerate(group) for b in group[i + 1 :]}
    for a, b in pairs:
        inter = len(sets[a] & sets[b])
        if 100 * inter >= 80 * (len(sets[a]) + len(sets[b]) - inter):
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    return {d: (len(sets[d]), find(d)) for d in sets}


def runs(w, least=6, exponent=4):
    """-> [(start, length, period)] of all runs of the sequence w, by start, then period"""
    found = {}
    for q in range(1, len(w) // exponent + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, exponent * q):
                found.setdefault((i, j + q - i), q)
            i = j + 1
    return sorted((s, n, q) for (s, n), q in found.items())


def collapsed(w, found):
    drop = [False] * len(w)
    for s, n, q in found:
        drop[s + q : s + n] = [True] * (n - q)
    return b" ".join(x for x, d in zip(w, drop) if not d)


def fingerprint(text, n=3):
    import xxhash

    w = [re.sub(rb"[A-Z]", lambda m: m[0].lower(), x) for x in words(text)]
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + n]), 42) for i in range(max(1, len(w) - n + 1))] if w else []
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def hamming_components(prints, most=2):
    """prints: {id: fingerprint} -> {id: least id that links lead to}"""
    ids, parent = sorted(prints), {i: i for i in prints}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= most:
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i: find(i) for i in ids}


def divergence(docs, least=10, top=10):
    """docs: [(text, lang, source)] -> sorted rows of the audit"""
    count, df, langs = defaultdict(lambda: defaultdict(int)), defaultdict(lambda: defaultdict(int)), defaultdict(set)
    for text, lang, source in docs:
        found = re.findall(rb"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").encode())
        found = [re.sub(rb"[A-Z]", lambda m: m[0].lower(), x) for x in found]
        langs[lang or ""].add(source or "")
        for t in found:
            count[lang or "", source or ""][t] += 1
        for t in set(found):
            df[lang or ""][t] += 1
    rows = []
    for lang, sources in langs.items():
        kept = sorted(t for t, n in df[lang].items() if n >= least)
        all_ = {t: sum(count[lang, s][t] for s in sources) for t in kept}

        def p(c):
            total = sum(c[t] for t in kept) + 2 * len(kept)
            return {t: 1 + 10**9 * (c[t] + 2) // total for t in kept}

        f = lambda x, y: (x - y) ** 2 // (x + y)
        shares, whole = {s: p(count[lang, s]) for s in sources}, p(all_)
        for s in sources:
            pairs = sorted((-sum(f(shares[s][t], shares[o][t]) for t in kept), o.encode()) for o in sources - {s})
            rows += [(lang, s, "pair", o.decode(), -v, r) for r, (v, o) in enumerate(pairs, 1)]
            terms = sorted((-f(shares[s][t], whole[t]), t) for t in kept if count[lang, s][t] and shares[s][t] > whole[t])
            rows += [(lang, s, "term", t.decode(), -v, r) for r, (v, t) in enumerate(terms[:top], 1)]
    return sorted(rows)
