import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from strandlog.llm import minhash, substring_dedup, suffix_dedup

from .corpus import SCHEMA, documents, frame, near_components, same, without_repeats, words


def byte_unit(t):
    return (t or "").encode()


def word_unit(t):
    return tuple(words(t))


@pytest.mark.parametrize("hot", [1000, 1])
def test_suffix_dedup_is_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT_OWNER", hot)
    rows = documents()
    same(suffix_dedup.digests(frame(spark, rows)), without_repeats(rows, byte_unit, 400, bytes))


def test_suffix_dedup_with_short_windows(spark):
    rows = [(i, t, *[None] * 7) for i, t in enumerate(["abcabcabcabcabcabc" * 3, "xxabcabcabcy", "z" * 40, "zzzzzzzzzzzz", "qwertyuiop"])]
    same(suffix_dedup.digests(frame(spark, rows), 10), without_repeats(rows, byte_unit, 10, bytes))


def test_substring_dedup_is_brute_force(spark):
    rows = documents()
    want = [(d, n, gone, h) for d, n, gone, _, h in without_repeats(rows, word_unit, 35, lambda w: " ".join(w).encode())]
    same(substring_dedup.digests(frame(spark, rows)), want)


def thue_morse(n, a, b):
    return [(a, b)[i.bit_count() & 1] for i in range(n)]


@pytest.mark.parametrize("n", [1024, 2048])
def test_regular_words_are_told_apart(spark, n):
    """Words and texts for which sums of powers of any base are equal."""
    one, two = ("".join(thue_morse(n, *x)) for x in ("ab", "ba"))
    rest = [f"v{i}" for i in range(40)]
    texts = [one, two, *(" ".join(rest[:17] + [w] + rest[17:34]) for w in (one, two)), *(" ".join(thue_morse(n, *x)) for x in (("a", "b"), ("b", "a")))]
    rows = [(i, t, *[None] * 7) for i, t in enumerate(texts)]
    df = frame(spark, rows)
    same(minhash.components(df).select("doc_id", "n_shingles", "component_id"), near_components(rows, 5, 85))
    same(substring_dedup.digests(df), [(d, m, gone, h) for d, m, gone, _, h in without_repeats(rows, word_unit, 35, lambda w: " ".join(w).encode())])
    same(suffix_dedup.digests(df, 16), without_repeats(rows, byte_unit, 16, bytes))


def test_clashing_names_and_changed_texts(spark):
    """Columns of any name come back, and texts lose exactly the repeated parts."""
    names = "doc_id long, text string, row string, bundle long, pos string, data string, whole string, `__row` string, n_chars long"
    passage = [f"p{i}" for i in range(60)]
    rows = [(i, " ".join([f"a{i}_{j}" for j in range(9)] + passage + [f"b{i}"]), "r", i, "p", "d", "w", "u", -1) for i in range(3)]
    out = sorted(substring_dedup.deduplicated(spark.createDataFrame(rows, names)).collect())
    want = [(i, " ".join([f"a{i}_{j}" for j in range(9)] + [f"b{i}"]), "r", i, "p", "d", "w", "u") for i in range(3)]
    assert [tuple(r) for r in out] == [(*w, len(w[1])) for w in want]
    out = sorted(minhash.deduplicated(spark.createDataFrame([*rows, rows[0]], names)).collect())
    assert [tuple(r) for r in out] == rows
    out = sorted(suffix_dedup.deduplicated(spark.createDataFrame(rows, names), 50).collect())
    assert [tuple(r)[2:8] for r in out] == [r[2:8] for r in rows] and all(len(r.text) == r.n_chars < 60 for r in out)


def test_rows_of_one_doc_id_and_other_texts(spark):
    rng = np.random.default_rng(5)
    one, two = (" ".join(f"w{x}" for x in rng.integers(0, 10**6, 50)) for _ in range(2))
    rows = [(1, one, *[None] * 7), (1, two, *[None] * 7), (2, two, *[None] * 7)]
    assert sorted((r.doc_id, r.text) for r in minhash.deduplicated(frame(spark, rows)).collect()) == sorted([(1, one), (1, two)])


def test_signatures_in_pieces():
    h = np.sort(np.random.default_rng(2).integers(0, 2**63, 700, dtype=np.uint64))
    assert (minhash.super_minhash(h, np.array([0, 300, 700]), 64, piece=100) == minhash.super_minhash(h, np.array([0, 300, 700]), 64)).all()


def test_deduplicated_keeps_columns(spark):
    rows = documents()
    for f in (substring_dedup.deduplicated, suffix_dedup.deduplicated, minhash.deduplicated):
        out = f(frame(spark, rows))
        assert out.columns == [c.split()[0] for c in SCHEMA.split(", ")]
    out = substring_dedup.deduplicated(frame(spark, rows)).where("doc_id = 20").first()
    assert out.text == next(r[1] for r in rows if r[0] == 20)  # a text without repeats is left as it is


@pytest.mark.parametrize("f", [suffix_dedup.digests, substring_dedup.digests, minhash.components])
def test_empty_tables(spark, f):
    assert f(spark.createDataFrame([], SCHEMA)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(1, 3), min_size=1, max_size=30), min_size=1, max_size=4), st.integers(1, 12))
def test_interval_expansion(texts, length):
    parts = [np.array(t, np.uint8) for t in texts if len(t) >= length]
    if not parts:
        return
    got = suffix_dedup._repeated(parts, length)
    all_ = [tuple(p[i : i + length]) for p in parts for i in range(len(p) - length + 1)]
    want = [all_.count(x) > 1 for x in all_]
    assert [bool(x) for g in got for x in g] == want


def test_near_duplicates_are_brute_force(spark):
    rows = documents()
    out = minhash.components(frame(spark, rows))
    same(out.select("doc_id", "n_shingles", "component_id"), near_components(rows, 5, 85))
    assert all(r.kept == (r.doc_id is None or r.doc_id == r.component_id) for r in out.collect())


def test_chain_of_near_copies_is_one_component(spark):
    base = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(w if j % 400 not in range(8 * i) else f"{w}x" for j, w in enumerate(base)), *[None] * 7) for i in range(12)]
    same(minhash.components(frame(spark, rows)).select("doc_id", "n_shingles", "component_id"), near_components(rows, 5, 85))


def test_super_minhash_estimates_similarity():
    rng = np.random.default_rng(1)
    common, a, b = rng.integers(0, 2**63, 600, dtype=np.uint64), *rng.integers(0, 2**63, (2, 200), dtype=np.uint64)
    x, y = np.sort(np.concatenate([common, a])), np.sort(np.concatenate([common, b]))
    sig = minhash.super_minhash(np.concatenate([x, y]), np.array([0, 800, 1600]), 256)
    assert abs((sig[0] == sig[1]).mean() - 0.6) < 0.1
    one = minhash.super_minhash(x[:3], np.array([0, 3]), 64)
    assert (one != 0).all()
    # What other documents are in a batch does not matter.
    assert (minhash.super_minhash(x, np.array([0, 800]), 256)[0] == sig[0]).all()


@pytest.mark.parametrize("one_task", [minhash.ONE_TASK, 0])
def test_groups_join_long_chains(spark, one_task):
    links = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501), (501, 500), (7, 300)], "a long, b long").repartition(5)
    got = {r.id: r.component for r in minhash.groups(links, one_task).collect()}
    assert {got[i] for i in range(1, 201)} == {0} and got[300] == 0 and got[501] == 500
