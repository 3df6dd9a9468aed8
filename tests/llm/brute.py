"""Plain Python versions of the contracts, to hold the queries against."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import defaultdict

BLANK = " \t\n\x0b\x0c\r"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def ascii_lower(s: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def line_dedup(rows, least=20, least_docs=3):
    """rows: (doc_id, text) to {doc_id: (n_lines, n_dropped, sha)}."""
    key = lambda x: ascii_lower(x.strip(BLANK))
    held = defaultdict(set)
    for d, t in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= least:
                held[key(x)].add(d)
    out = {}
    for d, t in rows:
        all_lines = (t or "").split("\n")
        kept = [x for x in all_lines if not (len(held.get(key(x), ())) >= least_docs and max(held[key(x)]) != d)]
        out[d] = (len(all_lines), len(all_lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest())
    return out


def base_counts(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    text = text or ""
    words = WORD.findall(text)
    seen, dup = set(), 0
    for x in text.split("\n"):
        if WORD.search(x):
            dup += x in seen
            seen.add(x)
    places = defaultdict(list)
    for i in range(len(words) - 7):
        places[tuple(words[i : i + 8])].append(i)
    covered = {j for p in places.values() if len(p) > 1 for i in p for j in range(i, i + 8)}
    n = len(words)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered), n < 20 or 100 * len(covered) > 30 * n


def rule_scores(text):
    """The five rules' scores by name."""
    n, chars, symbols, dup, rep, _ = base_counts(text)
    solid = sum(bool(WORD.search(x)) for x in (text or "").split("\n"))
    long = chars * 100 // max(n, 1)
    return {
        "symbols_permille": symbols * 1000 // max(chars, 1), "dup_lines_permille": dup * 1000 // max(solid, 1), "repeat_words_permille": rep * 1000 // max(n, 1),
        "long_words_centi": long, "short_words_centi": -long,
    }


def kept_by_rules(rows, good, grid, risk=0.004, most=0.05, delta=0.05):
    """rows: (doc_id, text, stratum); good: ids labelled good; grid: rule to cutoffs from strict to lenient. The ids that stay."""
    import math

    passed = [(d, s, rule_scores(t)) for d, t, s in rows if not base_counts(t)[-1]]
    strata = {s for _, _, s in rows}
    held = {s: [x for d, z, x in passed if z == s and d in good] for s in strata}
    everything = [x for xs in held.values() for x in xs]
    level = delta / ((sum(map(bool, held.values())) + 1) * len(grid))

    def allowed(xs):
        return max(risk, 1 - level ** (1 / len(xs)) if xs else 1)

    def strictest(xs, rule):
        p, n, last = allowed(xs), len(xs), None
        if p > most:
            return None
        for cut in reversed(grid[rule]):
            k = sum(x[rule] > cut for x in xs)
            if k > n * p or sum(math.comb(n, j) * p**j * (1 - p) ** (n - j) for j in range(k + 1)) > level * (1 + 1e-9):
                break
            last = cut
        return last

    cuts = {}
    for s in strata:
        for rule in grid:
            if allowed(held[s]) <= most:
                cuts[s, rule] = strictest(held[s], rule)
                continue
            pool = strictest(everything, rule)
            ok = [c for c in grid[rule] if pool is not None and c >= pool and sum(x[rule] > c for x in held[s]) <= len(held[s]) * most]
            cuts[s, rule] = min(ok, default=None)
    return {d for d, s, x in passed if all(cuts[s, r] is None or x[r] <= cuts[s, r] for r in grid)}


def repeated_bytes(rows, width=100):
    """rows: (doc_id, text) to {doc_id: (n_bytes, n_removed, n_spans, sha)}."""
    seen, out = set(), {}
    for d, t in sorted(rows, key=lambda r: r[0]):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - width + 1):
            w = b[i : i + width]
            if w in seen:
                gone[i : i + width] = b"\1" * width
            seen.add(w)
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = len([1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1])])
        out[d] = (len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def shingles(text, width):
    w = [ascii_lower(x) for x in WORD.findall(text or "")]
    if not w:
        return frozenset()
    if len(w) < width:
        return frozenset([tuple(w)])
    return frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1))


def near_duplicates(rows, width=4, percent=80):
    """rows: (doc_id, text) to {doc_id: (n_shingles, component_id)}."""
    sets = {d: shingles(t, width) for d, t in rows}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    by = defaultdict(list)
    for d, s in sets.items():
        for x in s:
            by[x].append(d)
    both = defaultdict(int)
    for ds in by.values():
        for i, a in enumerate(ds):
            for b in ds[i + 1 :]:
                both[a, b] += 1
    for (a, b), n in both.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {d: (len(s), find(d)) for d, s in sets.items()}


def mix_targets(sizes, weights=(3, 1, 2), share=1.5, epochs=2):
    """sizes: {source: words} to {source: target}, by dealing the excess again and again."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, total, target = set(order), share * sum(sizes.values()), {}
    while left:
        level = (total - sum(target.values())) / sum(w[s] for s in left)
        over = {s for s in left if w[s] * level > epochs * sizes[s]}
        if not over:
            return target | {s: w[s] * level for s in left}
        for s in over:
            target[s] = epochs * sizes[s]
        left -= over
    return target


def crc(ids):
    return zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))


def mix(rows, weights=(3, 1, 2), share=1.5, epochs=2, seed=17):
    """rows: (doc_id, source, text), ids distinct, to {doc_id: copies}."""
    import math

    size = {d: len(WORD.findall(t or "")) for d, _, t in rows}
    sizes = defaultdict(int)
    for d, s, _ in rows:
        sizes[s] += size[d]
    target, out = mix_targets(dict(sizes), weights, share, epochs), {}
    for s, total in sizes.items():
        whole = math.floor(target[s] / total + 1e-12) if total else 0
        rest, upto = target[s] - whole * total, 0

        def key(r):
            u = (int(hashlib.md5(f"{seed}:{r[0]}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
            x = rule_scores(r[2])
            q = (1000.0 - x["symbols_permille"]) * (1000.0 - x["dup_lines_permille"]) * (1000.0 - x["repeat_words_permille"]) / 1e9
            return -math.log(u) / max(0.05, q * q), r[0]

        for d, _, _ in sorted((r for r in rows if r[1] == s), key=key):
            upto += size[d]
            out[d] = whole + (size[d] > 0 and upto - size[d] / 2 <= rest)
    return out


def tile_cover(doc, item, least):
    """Words of the item under greedy tiles, by the book: the longest match of free words, again and again."""
    fd, fi, covered = [True] * len(doc), [True] * len(item), 0
    while True:
        best = (0, 0, 0)
        for i in range(len(item)):
            for d in range(len(doc)):
                k = 0
                while i + k < len(item) and d + k < len(doc) and item[i + k] == doc[d + k] and fi[i + k] and fd[d + k]:
                    k += 1
                if k >= least and (-k, i, d) < best:
                    best = (-k, i, d)
        if not best[0]:
            return covered
        k, i, d = best
        covered -= k
        for x in range(-k):
            fd[d + x] = fi[i + x] = False


def contaminated(rows, items, least=5, coverage=0.5):
    """rows, items: (id, text) to the ids of rows that hold an item."""
    import math

    words = lambda t: [ascii_lower(x) for x in WORD.findall(t or "")]
    out = set()
    for d, t in rows:
        w = words(t)
        grams = {tuple(w[i : i + least]) for i in range(len(w) - least + 1)}
        for _, it in items:
            m = words(it)
            if any(tuple(m[i : i + least]) in grams for i in range(len(m) - least + 1)) and tile_cover(w, m, least) >= math.ceil(len(m) * coverage):
                out.add(d)
    return out
