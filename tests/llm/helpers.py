"""Brute-force versions and odd documents for the corpus operators."""

import random
import re

WORD = re.compile("[^\x20\x09-\x0d]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside or return.
CLASHES = ["size", "target", "copies", "p", "key", "bucket", "n", "of", "words", "keep_0", "kept", "score", "component", "tree", "kind", "payload", "n_words"]


def odd_documents() -> list[tuple]:
    """Nulls in any column, empty and very long texts, ties, repeated rows, odd white space and characters."""
    rng = random.Random(3)
    long = " ".join(f"w{rng.randrange(500)}" for _ in range(30_000))
    passage = " ".join(f"p{i}" for i in range(70))
    rows = [
        (1, None, "en", "a"), (2, "", "en", "a"), (3, " \t\n\x0b\x0c\r ", None, "b"), (4, "one", "en", None), (None, "no id " + passage, None, None),
        (5, long, "en", "a"), (6, "x " + long + " y", "en", "a"), (7, passage, "en", "b"), (8, "before " + passage + " after", "de", "b"), (8, "before " + passage + " after", "de", "b"),
        (9, passage.upper(), "de", "b"), (10, "same same same same same same same same same same same same", "en", "a"), (11, "a b c \x85 d\x1fe ퟿ \U0001f600", "fr", "c"),
        (12, "<|endoftext|> is a mark", "en", "a"), (-5, "minus\n\nlines\nlines\nlines", "en", "a"), (13, "a" * 5000, "en", "a"), (14, "\n".join(["line of text"] * 40), "en", "z"),
        (15, " ".join(["t"] * 200), "en", "z"), (16, " ".join(["t"] * 120), "en", "z"), (17, "two words", "en", "a"), (18, "TWO  words", "en", "a"),
    ]
    return [(*r, len(r[1] or "")) for r in rows]


def with_clashes(df):
    from pyspark.sql import functions as F

    return df.withColumns({c: F.lit(f"clash {c}") for c in CLASHES})


def words(text):
    return WORD.findall(text or "")


def shingles(text, n=5):
    w = words((text or "").translate(LOWER))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def components(nodes, links):
    up = {x: x for x in nodes}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {x: root(x) for x in nodes}


def jaccard(rows, percent=75):
    """(doc_id, n_shingles, component) of rows (doc_id, text)."""
    sets = [(i, shingles(t)) for i, t in rows]
    links = []
    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and i is not None and j is not None and 100 * len(a & b) >= percent * len(a | b):
                links.append((i, j))
    found = components({i for i, _ in rows if i is not None}, links)
    return sorted(((i, len(s), found.get(i)) for i, s in sets), key=str)


def removed(rows, window=50):
    """(doc_id, n_words, n_removed, kept words) of rows (doc_id, text)."""
    first = {}
    for i, t in rows:
        w = words(t)
        for p in range(len(w) - window + 1) if i is not None else ():
            k = tuple(w[p : p + window])
            first[k] = min(first.get(k, i), i)
    out = []
    for i, t in rows:
        w = words(t)
        gone = set()
        for p in range(len(w) - window + 1) if i is not None else ():
            if first[tuple(w[p : p + window])] < i:
                gone.update(range(p, p + window))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out, key=str)


def quality(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    w, t = words(text), text or ""
    lines = [x for x in t.split("\n") if WORD.search(x)]
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    count = {}
    for g in grams:
        count[g] = count.get(g, 0) + 1
    covered = {k for i, g in enumerate(grams) if count[g] > 1 for k in range(i, i + 5)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered)
