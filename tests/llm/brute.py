"""Plain versions of the operators, for small tables."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(data) -> str:
    return hashlib.sha256(data.encode() if isinstance(data, str) else data).hexdigest()


def repeats(texts: list[bytes], width: int) -> list[tuple[int, int, int, str]]:
    """``n_bytes, n_removed, n_spans, kept_sha256`` per text."""
    seen = Counter(t[i : i + width] for t in texts for i in range(len(t) - width + 1))
    result = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - width + 1):
            if seen[t[i : i + width]] > 1:
                gone[i : i + width] = True
        runs = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        kept = bytes(np.frombuffer(t, np.uint8)[~gone])
        result.append((len(t), int(gone.sum()), runs, sha(kept)))
    return result


def simhash_components(rows: list[tuple], width: int = 4, bits: int = 4) -> dict:
    """``doc_id -> (fingerprint, component_id)``."""
    prints = []
    for _, text in rows:
        words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        shingles = [" ".join(words[k : k + width]) for k in range(max(1, len(words) - width + 1))] if words else []
        hashes = np.array([xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles], np.uint64)
        count = [(int(((hashes >> np.uint64(b)) & np.uint64(1)).sum())) for b in range(64)]
        prints.append(sum(1 << b for b in range(64) if 2 * count[b] > len(shingles)))
    values = np.array(prints, np.uint64)
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k in range(len(rows)):
        for j in np.flatnonzero(np.bitwise_count(values ^ values[k]) <= bits):
            a, b = find(k), find(int(j))
            parent[max(a, b)] = min(a, b)
    groups = defaultdict(list)
    for k, (doc, _) in enumerate(rows):
        groups[find(k)].append(doc)
    return {d: ("%016x" % prints[k], min(groups[find(k)])) for k, (d, _) in enumerate(rows)}


def mix_targets(sizes: dict, share: float = 1.5, limit: float = 2.0, weights=(3, 1, 2)) -> dict:
    """Target per source."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    total, target = share * sum(sizes.values()), {}
    while True:
        rest = total - sum(target.values())
        active = [s for s in order if s not in target]
        if not active:
            return target
        whole = sum(weight[s] for s in active)
        above = [s for s in active if rest * weight[s] / whole > limit * sizes[s]]
        if not above:
            return target | {s: rest * weight[s] / whole for s in active}
        target |= {s: limit * sizes[s] for s in above}


def cosine_neighbours(rows: list[tuple], query_ids, k: int = 5) -> dict:
    """``query -> [(vec_id, score)]`` over all rows."""
    ids = np.array([r[0] for r in rows])
    x = np.array([r[1] for r in rows], np.float64)
    norm = np.sqrt((x * x).sum(1))
    found = {}
    for q in query_ids:
        i = int(np.flatnonzero(ids == q)[0])
        score = (x * x[i]).sum(1) / (norm * norm[i])
        order = [j for j in np.lexsort((ids, -score)) if ids[j] != q][:k]
        found[q] = [(int(ids[j]), float(score[j])) for j in order]
    return found


_BASE = [
    ("email", re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")),
    ("ip", re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")),
    ("card", re.compile(r"[0-9]([\x20-]?[0-9])+")),
    ("phone", re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")),
]


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """Base spans ``(start, kind, end)`` by the patterns as they stand."""
    found = []
    for order, (kind, pattern) in enumerate(_BASE):
        for m in pattern.finditer(text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card":
                total = sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(digits)))
                if not 14 <= len(digits) <= 19 or total % 10:
                    continue
            if kind == "phone" and not 10 <= len(digits) <= 15:
                continue
            found.append((m.start(), order, kind, m.end()))
    return [(s, k, e) for s, _, k, e in sorted(found)]


def jaccard_groups(texts: list[str], width: int = 5, similarity: float = 0.8) -> list[int]:
    """Smallest index of each text's group; groups are linked by shingle similarity."""
    sets = []
    for t in texts:
        words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({" ".join(words[k : k + width]) for k in range(max(1, len(words) - width + 1))} if words else set())
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    where = defaultdict(list)
    for i, s in enumerate(sets):
        for shingle in s or {""}:
            where[shingle].append(i)
    tried = set()
    for members in where.values():
        for i in members[1:]:
            for j in members:
                if j >= i:
                    break
                if (j, i) not in tried:
                    tried.add((j, i))
                    both = len(sets[i] & sets[j])
                    if both >= similarity * (len(sets[i]) + len(sets[j]) - both):
                        a, b = find(i), find(j)
                        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(texts))]
