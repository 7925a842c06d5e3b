"""Plain restatements of what the corpus operators must return, for small inputs."""

import hashlib
import re
from collections import Counter

import xxhash

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORDS.findall(low)
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def components(prints, budget=2):
    """rows of (doc_id, fingerprint) -> doc_id -> least id reachable."""
    rows = list(prints)
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (rows[i][1] ^ rows[j][1]).bit_count() <= budget:
                parent[find(i)] = find(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[find(i)] = min(least.get(find(i), doc_id), doc_id)
    return [least.get(find(i)) for i in range(len(rows))]


def byte_dedup(rows, least=50):
    """(doc_id, text) -> {(doc_id, text): (n_bytes, n_removed, n_spans, sha)}; null ids come last."""
    key = lambda d: (d is None, d or 0)
    first = {}
    for d, t in rows:
        b = (t or "").encode()
        for i in range(len(b) - least + 1):
            s = b[i : i + least]
            if s not in first or key(d) < first[s]:
                first[s] = key(d)
    out = {}
    for d, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - least + 1):
            if first[b[i : i + least]] < key(d):
                gone[i : i + least] = b"\x01" * least
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out[d, t] = (len(b), sum(gone), len(re.findall(b"\x01+", bytes(gone))), hashlib.sha256(kept).hexdigest())
    return out


def word_dedup(rows, window=20):
    """(doc_id, text), ids distinct -> doc_id -> (n_words, n_removed, sha)."""
    seen, out = set(), {}
    for d, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        words = WORDS.findall(t or "")
        gone = [False] * len(words)
        for i in range(len(words) - window + 1):
            s = tuple(words[i : i + window])
            if s in seen:
                gone[i : i + window] = [True] * window
            seen.add(s)
        kept = [w for w, g in zip(words, gone, strict=True) if not g]
        out[d] = (len(words), sum(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest())
    return out


def rule_counts(text):
    words = WORDS.findall(text or "")
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    seen, repeated = set(), 0
    for line in (text or "").split("\n"):
        if WORDS.search(line):
            repeated += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), repeated, len(covered)


def leak(text, item, canonical, window=8, literals=5, whole=2, coverage=0.6, consistent=0.8, sizes=(5, 6, 7, 8, 10, 12, 14, 16, 20, 24, 28, 32, 40, 48, 56, 64)):
    """Whether a text holds an item: every pair of equally long stretches of both is compared, word by word. Stretches agree by
    template where they have enough literals: those of eight words, longer ones only where no shorter one at that place
    has enough; else by words. What is left over agrees as nearly the whole item."""
    ws, its = text.split(), item.split()
    n = len(its)
    if not n:
        return False
    a, b = [canonical(w) for w in its], [canonical(w) for w in ws]
    size = min(window, n)
    need = lambda k: literals if k >= window else -(-3 * k // 4)
    plain = lambda i, k: sum(not kind for kind, _ in a[i : i + k])
    tries, by_template = [], set()
    for i in range(n - size + 1):
        if plain(i, size) < need(size):
            tries.append((i, size, False))
        for k in sorted({size, *(k for k in sizes if k > size)}):
            if i + k <= n and plain(i, k) >= need(k):
                tries.append((i, k, True))
                by_template |= set(range(i, i + k))
                break
    nearly = [k for k in sizes if k <= n]
    if nearly and len(by_template) < coverage * n:
        tries += [(i, nearly[-1], True) for i in {0, n - nearly[-1]} if plain(i, nearly[-1]) >= whole]
    found, covered = {}, set()
    for i, k, template in tries:
        for j in range(len(ws) - k + 1):
            pairs = list(zip(a[i : i + k], b[j : j + k], strict=True))
            if all(p[0] == q[0] and (p[1] == q[1] or p[0] and template) for p, q in pairs):
                covered |= set(range(i, i + k))
                found.setdefault(j - i, set()).update((i + x, p[0], p[1], q[1]) for x, (p, q) in enumerate(pairs) if p[0])
    slots = fit = 0
    for pairs in found.values():
        slots += len(pairs)
        for kind, value in {p[1:3] for p in pairs}:
            fit += max(Counter(p[3] for p in pairs if p[1:3] == (kind, value)).values())
    return len(covered) >= coverage * n and fit >= consistent * slots
