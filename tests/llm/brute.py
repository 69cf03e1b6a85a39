"""Plain versions of the operators, over lists of (doc_id, text); a null id comes after all others."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter, defaultdict
from math import log

import xxhash

WORD = re.compile("[^\x20\x09-\x0d]+")
LAST = float("inf")


def words(text: str | None) -> list[str]:
    return WORD.findall(text or "")


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def at(doc_id) -> float:
    return LAST if doc_id is None else doc_id


def fingerprint(text: str | None) -> int:
    w = words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def near_duplicates(rows: list[tuple], most: int = 2) -> list[tuple]:
    fps = [fingerprint(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= most or (rows[i][0] is not None and rows[i][0] == rows[j][0]):
                parent[find(i)] = find(j)
    least = defaultdict(lambda: LAST)
    for i, (doc_id, _) in enumerate(rows):
        least[find(i)] = min(least[find(i)], at(doc_id))
    return [(d, f"{fps[i]:016x}", None if least[find(i)] == LAST else least[find(i)]) for i, (d, _) in enumerate(rows)]


def repeated_windows(rows: list[tuple], length: int = 50) -> list[tuple]:
    first: dict[tuple, float] = {}
    for doc_id, text in rows:
        w = words(text)
        for i in range(len(w) - length + 1):
            key = tuple(w[i : i + length])
            first[key] = min(first.get(key, LAST), at(doc_id))
    out = []
    for doc_id, text in rows:
        w = words(text)
        gone = set()
        for i in range(len(w) - length + 1):
            if first[tuple(w[i : i + length])] < at(doc_id):
                gone.update(range(i, i + length))
        kept = [x for i, x in enumerate(w) if i not in gone]
        out.append((doc_id, len(w), len(gone), sha(" ".join(kept).encode())))
    return out


def repeated_passages(rows: list[tuple], length: int = 100) -> list[tuple]:
    first: dict[bytes, tuple] = {}
    for doc_id, text in rows:
        b = (text or "").encode()
        for i in range(len(b) - length + 1):
            key = b[i : i + length]
            first[key] = min(first.get(key, (LAST, LAST)), (at(doc_id), i))
    out = []
    for doc_id, text in rows:
        b = (text or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if first[b[i : i + length]] < (at(doc_id), i):
                gone[i : i + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = len(re.findall(b"\1+", bytes(gone)))
        out.append((doc_id, len(b), sum(gone), spans, sha(kept)))
    return out


def base_counts(text: str | None) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    w = words(text)
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    n = Counter(windows)
    covered = {j for i, x in enumerate(windows) if n[x] > 1 for j in range(i, i + 8)}
    failed = len(w) < 20 or 100 * len(covered) > 30 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered), failed


def quality_rules(rows: list[tuple], buckets: int = 8192, threshold: float = -0.12) -> list[tuple]:
    signed = lambda h: h - (1 << 64) if h >> 63 else h

    def grams(text: str | None) -> list[int]:
        h = [xxhash.xxh64_intdigest(w.encode(), 42) for w in words(text)]
        pair = lambda a, b: xxhash.xxh64_intdigest(b.to_bytes(8, "little"), xxhash.xxh64_intdigest(a.to_bytes(8, "little"), 42))
        return [signed(x) % buckets for x in h] + [buckets + signed(pair(a, b)) % buckets for a, b in zip(h, h[1:])]

    every, trusted = Counter(), Counter()
    for _, text in rows:
        n, chars, symbols, dup, repeat, failed = base_counts(text)
        every.update(g := grams(text))
        if not failed and n >= 50 and 100 * symbols <= chars and not dup and not repeat:
            trusted.update(g)
    total = lambda c, pair: sum(n for b, n in c.items() if (b >= buckets) == pair) + buckets
    sums = {p: (total(trusted, p), total(every, p)) for p in (False, True)}
    out = []
    for doc_id, text in rows:
        g, base = grams(text), base_counts(text)
        score = sum(log((trusted[b] + 1) / sums[b >= buckets][0]) - log((every[b] + 1) / sums[b >= buckets][1]) for b in g) / len(g) if g else 0.0
        out.append((doc_id, *base, not base[-1] and score >= threshold))
    return out


def targets(sizes: dict[str | None, int], weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> dict[str | None, float]:
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    out: dict[str | None, float] = {}
    while True:
        free = [s for s in names if s not in out]
        left = sum(sizes.values()) - sum(out.values())
        over = [s for s in free if left * weight[s] / sum(weight[x] for x in free) > most * sizes[s]]
        if not over:
            return out | {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        out |= {s: float(most * sizes[s]) for s in over}


def nearest(vectors: list[tuple], every: int = 20, k: int = 20) -> list[tuple]:
    """query_id, rank, vec_id, score; products are summed in order of components."""
    good = [(i, v) for i, v in vectors if i is not None and v and all(x is not None and abs(x) < LAST for x in v) and any(v)]
    out = []
    for q, a in good:
        if q % every:
            continue
        found = []
        for i, b in good:
            if i != q and len(a) == len(b):
                score = 0.0
                for x, y in zip(a, b):
                    score += x * y
                found.append((-score, i))
        out += [(q, r, i, -s) for r, (s, i) in enumerate(sorted(found)[:k], 1)]
    return out


def fill_in_middle(rows: list[tuple], seed: int = 7) -> list[tuple]:
    out = []
    for doc_id, text in rows:
        text = text or ""
        lines = re.findall("[^\n]*\n|[^\n]+", text)
        n, digest = len(lines), sha(f"{seed}:{'' if doc_id is None else doc_id}".encode())
        h = [int(digest[k : k + 8], 16) for k in range(0, 32, 8)]
        a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
        p, m, s = ("".join(part) for part in (lines[:a], lines[a:b], lines[b:]))
        if not text or any(mark in text for mark in ("<P>", "<S>", "<M>")):
            out.append((doc_id, n, "plain", None, None, sha(text.encode()), sha(text.encode())))
        else:
            form, made = ("spm", f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 50 else ("psm", f"<P>{p}<S>{s}<M>{m}")
            out.append((doc_id, n, form, len(p), len(m), sha(made.encode()), sha(text.encode())))
    return out


def license_blocks(rows: list[tuple], templates: list[tuple[str, list[str]]], threshold: float) -> list[tuple]:
    """doc_id, template, first word, share of the template's words, of every block that reaches the threshold."""
    out = []
    for doc_id, text in rows:
        w = license_words(text)
        for t, (_, words_of_it) in enumerate(templates):
            m, wanted = len(words_of_it), set(words_of_it)
            for at in range(0, len(w), m):
                share = len(wanted & set(w[at : at + 2 * m])) / len(wanted)
                if share >= threshold - 1e-12:
                    out.append((doc_id, t, at, share))
    return out


def license_words(text: str | None) -> list[str]:
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower)


def licenses(rows: list[tuple], templates: list[tuple[str, list[str]]], threshold: float) -> list[tuple]:
    out = []
    for doc_id, text in rows:
        w = license_words(text)
        places = [(i, label) for phrase, label in (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")) for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split()]
        at, named = [i for i, _ in places], {label for _, label in places}
        met = license_blocks([(doc_id, text)], templates, threshold)
        more = named | {templates[t][0] for _, t, _, _ in met}
        score = 1.0 if at else max((s for *_, s in met), default=0.0)
        out.append((doc_id, len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(named)), ",".join(sorted(more)), score))
    return out


def clusters(rows: list[tuple], k: int, rounds: int, width: int, seed: int = 2) -> list[tuple]:
    """Every vector against every centroid, in whole numbers of any size."""
    kept = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v)]
    name = lambda i: "" if i is None else i
    c = [v for _, v in sorted(kept, key=lambda r: (sha(f"{seed}:{name(r[0])}".encode()), r[1]))[:k]]
    far = lambda v, o: sum((a - b) ** 2 for a, b in zip(v, o))
    nearest = lambda v: min((far(v, o), j) for j, o in enumerate(c))
    for _ in range(rounds):
        held = defaultdict(list)
        for _, v in kept:
            held[nearest(v)[1]].append(v)
        c = [[sum(col) // len(held[j]) for col in zip(*held[j])] if j in held else o for j, o in enumerate(c)]
    found = [(i, *nearest(v)) for i, v in kept]
    total = Counter()
    for _, d, j in found:
        total[j] += d
    return [(i, j, d, total[j], sum(total.values()), sha(",".join(map(str, c[j])).encode())) for i, d, j in found]
