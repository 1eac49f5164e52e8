"""Plain versions of operators, for comparison on small tables."""

import re
import string
from collections import defaultdict

LOW = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, words):
    w = SPACE.findall((text or "").translate(LOW))
    return {tuple(w[k : k + words]) for k in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set()


def brute_components(rows, words, percent):
    """Of rows (id, text) with different ids: the size of each set, and the least id of its component."""
    sets = {i: shingles(t, words) for i, t in rows}
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    by_shingle = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            by_shingle[x].append(i)
    done = set()
    for own in by_shingle.values():
        for n, a in enumerate(own):
            for b in own[n + 1 :]:
                if (a, b) not in done:
                    done.add((a, b))
                    both = len(sets[a] & sets[b])
                    if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                        x, y = find(a), find(b)
                        up[max(x, y)] = min(x, y)
    return {i: len(s) for i, s in sets.items()}, {i: find(i) for i in sets}


def item_windows(items):
    """items: (id, text). The ids of each window of 13 words."""
    windows = defaultdict(set)
    for i, t in items:
        w = ALNUM.findall((t or "").translate(LOW))
        n = min(13, len(w))
        for k in range(len(w) - n + 1):
            if n:
                windows[tuple(w[k : k + n])].add(i)
    return windows


def contaminated(text, windows):
    w = ALNUM.findall((text or "").translate(LOW))
    hit = set()
    for n in {len(x) for x in windows}:
        for k in range(len(w) - n + 1):
            if tuple(w[k : k + n]) in windows:
                hit |= set(range(k, k + n))
    return bool(hit) and 20 * len(hit) >= len(w)
