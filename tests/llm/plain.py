"""Brute-force versions for small inputs."""

import re

LETTERS = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def repeat_words(text, width=8):
    ws = words(text)
    windows = [tuple(ws[i : i + width]) for i in range(len(ws) - width + 1)]
    twice = {w for w in windows if windows.count(w) > 1}
    return len({i + k for i, w in enumerate(windows) if w in twice for k in range(width)})


def quality_ok(text):
    ws, text = words(text), text or ""
    n, chars = len(ws), sum(map(len, ws))
    return not (
        n < 20 or 100 * repeat_words(text) > 30 * n or 10 * sum(c in "#*$%&|<>" for c in text) > n or chars > 20 * n or chars < 2 * n or 2 * sum(c.isupper() for c in text) > chars
    )


def shingles(text):
    ws = words(lower(text))
    return {tuple(ws)} - {()} if len(ws) < 5 else {tuple(ws[i : i + 5]) for i in range(len(ws) - 4)}


def groups(texts):
    """Smallest number linked with each text."""
    sets = [shingles(t) for t in texts]
    group = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common and 100 * common >= 75 * (len(sets[i]) + len(sets[j]) - common) and group[i] != group[j]:
                low, high = sorted((group[i], group[j]))
                group = [low if g == high else g for g in group]
    return group


def group_firsts(texts):
    return [g == i for i, g in enumerate(groups(texts))]


def test_words(text):
    return LETTERS.findall(lower(text).encode())


test_words.__test__ = False


def hit_words(text, items, window=10):
    ws, hit = test_words(text), set()
    for item in items:
        own = test_words(item)
        size = min(window, len(own))
        for i in range(len(own) - size + 1) if size else ():
            for at in range(len(ws) - size + 1):
                if ws[at : at + size] == own[i : i + size]:
                    hit |= set(range(at, at + size))
    return hit
