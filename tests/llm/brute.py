"""Plain versions of the operators, one text at a time, to compare with."""

import re
from collections import Counter, defaultdict

SPACE = re.compile(rb"[^\x20\x09-\x0D]+")
ALNUM = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def spaced(text, lower=False):
    raw = (text or "").encode()
    return SPACE.findall(raw.translate(LOWER) if lower else raw)


def alnum(text):
    return ALNUM.findall((text or "").encode().translate(LOWER))


def shingles(text, k):
    w = spaced(text, True)
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) or frozenset([tuple(w)])


def components(texts, k, a=80, b=100):
    """key -> (set size, component), for a dict of texts."""
    sets = {i: shingles(t, k) for i, t in texts.items()}
    up = {i: i for i in texts}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    keys = sorted(sets)
    for i, x in enumerate(keys):
        for y in keys[i + 1 :]:
            both = len(sets[x] & sets[y])
            if both and b * both >= a * (len(sets[x]) + len(sets[y]) - both):
                p, q = find(x), find(y)
                up[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), find(i)) for i in texts}


def left_words(texts, width=50):
    """key -> words without those of windows that start in a text with a smaller key."""
    words = {i: spaced(t) for i, t in texts.items()}
    low = {}
    for i in sorted(words):
        for k in range(len(words[i]) - width + 1):
            low.setdefault(tuple(words[i][k : k + width]), i)
    out = {}
    for i, w in words.items():
        gone = set()
        for k in range(len(w) - width + 1):
            if low[tuple(w[k : k + width])] < i:
                gone.update(range(k, k + width))
        out[i] = [x for k, x in enumerate(w) if k not in gone]
    return out


def hits(texts, items, width=13):
    """key -> (words, words hit, items found)."""
    out = {}
    windows = defaultdict(set)
    for name, t in items:
        w = alnum(t)
        n = min(len(w), width)
        for k in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[k : k + n])].add(name)
    sizes = {len(x) for x in windows}
    for i, t in texts.items():
        w = alnum(t)
        hit, found = set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                names = windows.get(tuple(w[k : k + n]))
                if names:
                    hit.update(range(k, k + n))
                    found |= names
        out[i] = (len(w), len(hit), found)
    return out


def measures(text):
    text = text or ""
    w = spaced(text)
    lines = [x for x in text.split("\n") if spaced(x)]
    grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    again = {i + j for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for j in range(5)}
    return {
        "n_words": len(w), "word_chars": sum(len(x.decode()) for x in w),
        "n_symbols": sum(text.count(x) for x in "#*$%&|<>"), "n_lines": len(lines),
        "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(again),
    }


def best_fit(sizes, window):
    """Rooms of all windows after best-fit decreasing, sorted."""
    rooms = []
    for s in sorted(sizes, reverse=True):
        fit = [i for i, room in enumerate(rooms) if room >= s]
        if fit:
            rooms[min(fit, key=rooms.__getitem__)] -= s
        else:
            rooms.append(window - s)
    return sorted(rooms)
