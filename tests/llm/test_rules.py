import itertools
import math
import random
from collections import Counter

import pytest

from strandlog.llm import decontaminate, lm_scoring, quality
from strandlog.llm.queries import ORACLES, QUERIES
from tests.conftest import SF

from .corpus import SCHEMA, documents, frame, text, words

BENCH = "item_id long, text string, seed string"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(name, compare):
    compare(QUERIES[name], ORACLES[name])


def base(t):
    t = t or ""
    w, lines = words(t), [x for x in t.split("\n") if words(x)]
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    repeated = {i + j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(3)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(repeated)


def test_quality_counts(spark):
    rows = [r for r in documents() if len(r[1] or "") < 8000]
    got = quality.assess(frame(spark, rows)).collect()
    want = sorted(repr((r[0], *base(r[1]))) for r in rows)
    assert sorted(repr((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)) for r in got) == want
    assert quality.assess(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("most", [500_000, 0])
def test_common_lines_go(spark, most):
    rng = random.Random(3)
    common = "Read  MORE about this\tsite"
    rows = [(i, text(rng, 80) + "\n" + (common if i % 2 else common.lower()), "en", "a", 1, *[None] * 4) for i in range(15)]
    rows += [(100 + i, text(rng, 80) + "\n" + common, "en", "b", 1, *[None] * 4) for i in range(5)]
    rows += [(200, common + "\n" + text(rng, 20), "en", "a", 1, *[None] * 4), (300, rows[0][1], "en", "a", 1, *[None] * 4), rows[1]]
    df = frame(spark, rows)
    got = {r.doc_id: r for r in quality.assess(df, broadcast_rows=most).collect()}
    assert got[0].lost_words == 5 and got[0].kept and got[100].lost_words == 0 and not got[200].kept
    clean = {r.doc_id: r for r in quality.clean(df, broadcast_rows=most).collect()}
    assert 200 not in clean and clean[0].text == rows[0][1].rsplit("\n", 1)[0] and clean[100].text == rows[15][1]
    assert clean[0].n_chars == len(clean[0].text)
    assert quality.clean(df).columns == df.columns


def test_copies_of_one_text_can_be_one_document(spark):
    t = text(random.Random(5), 120)
    rows = [(i, t, "en", "a", 1, *[None] * 4) for i in range(40)]
    assert all(r.kept and not r.lost_words for r in quality.assess(frame(spark, rows), copies_once=True).collect())
    assert not any(r.kept for r in quality.assess(frame(spark, rows)).collect())  # else 40 documents have each line


def test_one_text_on_two_hosts_is_judged_on_each(spark):
    rng = random.Random(9)
    shared = "\n".join(text(rng, 9) for _ in range(15))
    rows = [(i, text(rng, 120) + "\n" + shared, "en", "a", 1, *[None] * 4) for i in range(12)]
    rows += [(50, text(rng, 60) + "\n" + shared, "en", host, 1, *[None] * 4) for host in ("a", "b")]
    out = [r for r in quality.clean(frame(spark, rows)).collect() if r.doc_id == 50]
    assert [(r.source, r.text) for r in out] == [("b", rows[-1][1])]


@pytest.mark.parametrize("most", [1_000_000, 0])
def test_decontamination(spark, most):
    rng = random.Random(7)
    items = [text(rng, 40, 10**6) for _ in range(6)]
    clean = [text(rng, 300, 10**6) for _ in range(10)]
    swapped = items[0].split()
    for i in range(4, len(swapped), 6):
        swapped[i] = "zzz"
    dirty = [clean[0] + " " + items[1], " ".join(swapped), clean[1] + "\n" + " ".join(items[2].split()[10:26]).upper() + " end", items[3]]
    near_miss = [clean[2] + " " + " ".join(items[4].split()[:6]), None, ""]
    texts = dirty + clean + near_miss
    rows = [(i, t, *[None] * 7) for i, t in enumerate(texts)] + [(0, texts[0], *[None] * 7)]
    bench = spark.createDataFrame([(i, t, "x") for i, t in enumerate(items)] + [(9, None, "x"), (10, "too short", "x"), (1, items[1], "x")], BENCH)
    df = frame(spark, rows)
    assert {(r.doc_id, r.item_id) for r in decontaminate.overlaps(df, bench, broadcast_rows=most).collect()} == {(0, 1), (1, 0), (2, 2), (3, 3)}
    kept = decontaminate.decontaminated(df, bench, broadcast_rows=most)
    assert sorted(r.doc_id for r in kept.collect()) == list(range(4, len(texts))) and kept.columns == df.columns
    assert decontaminate.overlaps(spark.createDataFrame([], SCHEMA), bench).count() == 0
    assert decontaminate.overlaps(df, spark.createDataFrame([], BENCH)).count() == 0


def overlap(d, b):
    """(agreeing tokens, window) of the best window at any distance, if it is a match."""
    n = min(13, len(b))
    agree = ([0 <= j + s < len(d) and d[j + s] == x for j, x in enumerate(b)] for s in range(-len(b), len(d)))
    most = max((sum(a[i : i + n]) for a in agree for i in range(len(b) - n + 1)), default=0)
    return (most, n) if n and 100 * most >= 75 * n else None


@pytest.mark.parametrize("arguments", [{}, {"masks": decontaminate.SQL_MASKS}, {"broadcast_rows": 0}])
def test_decontamination_is_brute_force(spark, arguments):
    """Every way to differ in three of 13 tokens, and items of all lengths with as many differing tokens as may be, or one more."""
    rng = random.Random(13)

    def draw(n):
        return [f"w{rng.randrange(10**6)}" for _ in range(n)]

    items = [draw(n) for n in (*range(1, 13), 13, 14, 15, 20)]
    docs = [["x"] + ["y" if i in gone else w for i, w in enumerate(items[12])] for gone in itertools.combinations(range(13), 3)]
    docs += [items[12][:10], items[12][3:], items[9][2:], draw(50), []]
    for b in items:
        for more in (0, 1):
            gone = rng.sample(range(len(b)), min(len(b), min(13, len(b)) * 25 // 100 + more))
            docs.append(draw(3) + ["y" if i in gone else w for i, w in enumerate(b)] + draw(3))
    df = frame(spark, [(i, " ".join(d), *[None] * 7) for i, d in enumerate(docs)])
    bench = spark.createDataFrame([(i, " ".join(b), "x") for i, b in enumerate(items)], BENCH)
    want = {(i, j, *o) for i, d in enumerate(docs) for j, b in enumerate(items) if (o := overlap(d, b))}
    assert {tuple(r) for r in decontaminate.overlaps(df, bench, **arguments).collect()} == want


def test_one_token_over_and_over(spark):
    items = [["a"] * 30, ["a"] * 14, ["b", *["a"] * 15, "c"], ["a"] * 6 + ["b"] * 8]
    docs = [["a"] * 3000, ["a"] * 20, ["x", "b", *["a"] * 40, "c"], ["a"] * 12, ["a"] * 40 + ["b"] * 40, ["z"] * 50, ["a", "b"] * 30, ["a"] * 13]
    df = frame(spark, [(i, " ".join(d), *[None] * 7) for i, d in enumerate(docs)])
    bench = spark.createDataFrame([(i, " ".join(b), "x") for i, b in enumerate(items)], BENCH)
    want = {(i, j, *o) for i, d in enumerate(docs) for j, b in enumerate(items) if (o := overlap(d, b))}
    assert {tuple(r) for r in decontaminate.overlaps(df, bench).collect()} == want


LABELS = "doc_id long, quality int, toxic int"


def test_scores_separate_held_out_documents(spark):
    """Good and poor texts draw words from overlapping halves; scores of unlabelled ones tell them apart."""
    rng = random.Random(11)

    def draw(good):
        return " ".join(f"w{int(rng.triangular(0, 600, 150 if good else 450))}" for _ in range(120))

    rows = [(i, draw(i % 2 == 0), *[None] * 7) for i in range(300)]
    labels = spark.createDataFrame([(i, int(i % 2 == 0), 0) for i in range(200)] + [(0, 1, 0), (None, 1, 0), (7, None, None)], LABELS)
    out = {r.doc_id: r.score for r in lm_scoring.score(frame(spark, rows), labels).collect()}
    good, poor = [out[i] for i in range(200, 300, 2)], [out[i] for i in range(201, 300, 2)]
    assert sum(g < p for g in good for p in poor) / len(good) / len(poor) > 0.9  # the halves overlap


def test_scores_of_odd_rows(spark):
    rows = documents()
    labels = spark.createDataFrame([(1, 1, 0)], LABELS)
    out = lm_scoring.score(frame(spark, rows), labels).collect()
    assert len(out) == len(rows)
    assert all((r.score is None) == (r.n_words == 0) for r in out)
    assert lm_scoring.score(spark.createDataFrame([], SCHEMA), labels).count() == 0
    none = lm_scoring.score(frame(spark, rows), spark.createDataFrame([], LABELS)).collect()
    assert all(r.score is None or r.score == r.score for r in none)


@pytest.mark.parametrize("sizes", [{}, {"slice_bytes": 2000, "part_bytes": 500}])
def test_scores_are_brute_force(spark, sizes):
    """Every distinct word and pair has a count of its own, however texts are cut into slices and parts."""
    rows = documents() + [(1000 + i, text(random.Random(i), 300, 10**6), *[None] * 7) for i in range(20)]
    good = {0, 9, 14, 1001, 1007}
    labels = spark.createDataFrame([(i, 1, 0) for i in good] + [(0, 1, 0), (3, 0, 0), (None, 1, 0)], LABELS)
    low = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
    split = [words((r[1] or "").translate(low)) for r in rows]
    pairs = [list(zip([None, *w], w)) for w in split]  # noqa: B905
    vocabulary, want = len({x for w in split for x in w}), []
    for k, (r, p) in enumerate(zip(rows, pairs, strict=True)):
        loss = []
        for use in (lambda d: d in good, lambda d: True):
            kept = [q for i, (o, q) in enumerate(zip(rows, pairs, strict=True)) if use(o[0]) and i != k]  # it is left out itself
            vw, before, one = Counter(x for q in kept for x in q), Counter(v for q in kept for v, _ in q), Counter(w for q in kept for _, w in q)
            lost = []
            for v, w in p:
                u = (one[w] + 0.1) / (one.total() + 0.1 * vocabulary)
                lost.append(-math.log2(0.5 * vw[v, w] / before[v] + 0.5 * u if before[v] else u))
            loss.append(sum(lost) / len(p) if p else None)
        want.append((r[0], len(p), *loss, loss[0] - loss[1] if p else None))
    got = [tuple(r) for r in lm_scoring.score(frame(spark, rows), labels, **sizes).collect()]
    assert len(got) == len(want)
    for a, b in zip(*(sorted(x, key=lambda r: (r[0] is None, r[0] or 0, r[1])) for x in (got, want)), strict=True):
        assert a[:2] == b[:2] and a[2:] == (b[2:] if a[1] == 0 else pytest.approx(b[2:], abs=1e-9))


def test_all_queries_are_registered():
    import re

    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES) == list(range(1, 11))
    assert SF
