"""Odd rows that every corpus operator has to bear, and brute-force versions of the contracts."""

import hashlib
import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, doc string, n int, size int, slice int, "
          "text_hash string, _id int, _kept int, component string, base string, tokens string")
CLASH = ("x", 1, 2, 3, "h", 4, 5, "c", "b", "t")

PASSAGE = " ".join(f"passage{i} word{i * 7 % 13}" for i in range(40))
LONG = "\n".join(f"line number {i} of a very long text with some words {i % 97}" for i in range(20_000))
COPY = "one two three four five six seven eight nine ten eleven twelve"


def rows():
    texts = [
        (1, COPY, "en", "a"), (2, COPY, "en", "b"), (2, COPY, "en", "b"), (3, COPY.upper() + "\n", "en", "a"),
        (4, None, None, None), (5, "", "en", "a"), (6, " \t\n\x0b ", "en", None), (7, LONG, "en", "a"),
        (8, LONG + " tail", "de", "b"), (None, COPY + " thirteen", "en", "a"), (None, "no id here", None, "c"),
        (9, PASSAGE, "fr", "c"), (10, PASSAGE + "\n" + PASSAGE, "fr", "c"), (11, "a a a a a a a a a a a a a a", "en", "d"),
        (12, "Shared Line Of Text\nown line one here\nshared line of text\nshort", "en", "a"),
        (13, "  shared line of text \t\nother\n\n", "en", "a"), (14, "é" * 9 + "\n" + "é" * 10, "xx", "é"),
        (15, "é" * 10 + "\nx", "xx", "\U0001F600"), (16, "mail a@b.com_x@y.org and +1 (017) 555-7713 or 10.0.0.1", "en", "a"),
        (17, "a b c \u0085 d\x1ce", "en", "a"), (18, "\U0001F600 smilé don't we'll 'S 12 ½  x\n\n y  ", "en", "b"),
    ]
    return [(i, t, lang, s, None if t is None else len(t), *CLASH) for i, t, lang, s in texts]


def frame(spark, data=None):
    return spark.createDataFrame(rows() if data is None else data, SCHEMA)


def words(text):
    return WORD.findall(text or "")


def base_measures(text):
    text = text or ""
    w, seen, again = words(text), set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            again += line in seen
            seen.add(line)
    windows = Counter(zip(*[w[j:] for j in range(5)]))
    covered = [False] * len(w)
    for j in range(len(w) - 4):
        if windows[tuple(w[j:j + 5])] > 1:
            covered[j:j + 5] = [True] * 5
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), again, sum(covered)


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def shingle_set(text, k):
    w = words(low(text or ""))
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def components(items, k, percent):
    """items: (key, text); the smallest key that each can reach."""
    keys = sorted({i for i, _ in items})
    label = {i: i for i in keys}
    sets = [(i, shingle_set(t, k)) for i, t in items]
    changed = True
    links = [(i, j) for n, (i, a) in enumerate(sets) for j, b in sets[:n] if a and b and 100 * len(a & b) >= percent * len(a | b)]
    while changed:
        changed = False
        for i, j in links:
            m = min(label[i], label[j])
            changed |= label[i] != m or label[j] != m
            label[i] = label[j] = m
    return label


def line_dedup(items):
    """items: (id, text) -> [(id, n_lines, n_dropped, sha256)]."""
    def key(line):
        return low(line.strip(" \t\n\x0b\x0c\r"))

    owner = {}
    for i, t in items:
        for line in (t or "").split("\n"):
            owner[key(line)] = min(owner.get(key(line), i), i)
    out = []
    for i, t in items:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(key(x)) < 10 or owner[key(x)] == i]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return out
