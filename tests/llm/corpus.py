"""Small corpora with the cases that operators must define, and brute-force versions of them."""

import hashlib
import random
import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, count long, words long, key string"


def text(rng, n, vocabulary=4000):
    out = []
    for i in range(n):
        out.append(f"w{rng.randrange(vocabulary)}" + ("é" if i % 7 == 0 else "") + ("," if i % 11 == 0 else ""))
    return "".join(w + ("\n" if i % 9 == 8 else " ") for i, w in enumerate(out)).strip()


def documents(seed=0):
    """Copies, near copies, shared passages, nulls, empty and odd texts, repeated rows; extra columns with names that operators use."""
    rng = random.Random(seed)
    base, passage, texts = text(rng, 300), text(rng, 80), []
    texts += [base] * 4
    for _ in range(4):
        w = base.split(" ")
        w[rng.randrange(len(w))] = "other"
        texts.append(" ".join(w))
    texts += [text(rng, 60) + "\n" + passage + "\n" + text(rng, 60) for _ in range(5)]
    texts += [text(rng, rng.randrange(1, 400)) for _ in range(20)]
    texts += [None, "", " \t\n", "a", "one two three", "x " * 900, "ab" * 1500, "</s> é\x1c  　y", "spam spam\n" * 100, "# $ % & | < >" * 20]
    texts += [text(rng, 6000)]
    rows = [(i, t, "en", f"src{i % 3}" if i % 10 else None, len(t or ""), "r", 1, 2, "k") for i, t in enumerate(texts)]
    rows += [rows[0], rows[9], (None, base, None, "src0", 0, None, None, None, None), (None, None, None, None, None, None, None, None, None)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def same(df, expected):
    got = sorted(map(repr, (tuple(r) for r in df.collect())))
    assert got == sorted(map(repr, expected))


def words(t):
    return WORD.findall(t or "")


def sha(b):
    return hashlib.sha256(b).hexdigest()


def without_repeats(rows, unit, window, join):
    """(doc_id, length, removed, spans, sha256) with every window that starts twice removed."""
    seen, split = Counter(), [unit(r[1]) for r in rows]
    for u in split:
        seen.update(u[i : i + window] for i in range(len(u) - window + 1))
    out = []
    for r, u in zip(rows, split, strict=True):
        gone = [False] * len(u)
        for i in range(len(u) - window + 1):
            if seen[u[i : i + window]] > 1:
                gone[i : i + window] = [True] * window
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((r[0], len(u), sum(gone), spans, sha(join([x for x, g in zip(u, gone, strict=True) if not g]))))
    return out


def near_components(rows, k, percent):
    """(doc_id, n_shingles, component) by comparing all pairs; null doc_ids have none."""
    low = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
    sets = {}
    for r in rows:
        w = words((r[1] or "").translate(low))
        sets[r[0], r[1]] = frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])
    up = {d: d for d, _ in sets if d is not None}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    have = [(d, s) for (d, _), s in sets.items() if d is not None and s]
    for i, (a, x) in enumerate(have):
        for b, y in have[:i]:
            if 100 * len(x & y) >= percent * len(x | y):
                m, n = top(a), top(b)
                up[max(m, n)] = min(m, n)
    return [(r[0], len(sets[r[0], r[1]]), None if r[0] is None else top(r[0])) for r in rows]
