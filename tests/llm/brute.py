"""Plain versions of the operators, for small tables."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def shingles(text):
    w = words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if 0 < len(w) < 5:
        return {tuple(w)}
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)}


def near_groups(rows):
    """{id: (shingles, smallest id reachable)} of (id, text) pairs."""
    sets = {i: shingles(t) for i, t in rows}
    holders = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            holders[x].append(i)
    shared = Counter()
    for ids in holders.values():
        ids.sort()
        shared.update((a, b) for k, b in enumerate(ids) for a in ids[:k])
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (a, b), n in shared.items():
        if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def without_repeats(rows):
    """[(id, words, removed, kept words)] of (id, text) pairs that come in order."""
    seen, out = set(), []
    for i, text in rows:
        w = words(text)
        gone = [False] * len(w)
        for k in range(len(w) - 19):
            run = tuple(w[k : k + 20])
            if run in seen:
                gone[k : k + 20] = [True] * 20
            seen.add(run)
        out.append((i, len(w), sum(gone), [x for x, g in zip(w, gone) if not g]))
    return out


def token_pieces(text, tokenizer, capacity):
    import numpy as np

    ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
    return [
        (k, at, len(ids[at : at + capacity]), zlib.crc32(ids[at : at + capacity].tobytes()))
        for k, at in enumerate(range(0, len(ids), capacity))
    ]


def sha256(text):
    return hashlib.sha256(text.encode()).hexdigest()
