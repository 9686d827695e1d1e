import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from strandlog.llm.common import stash, table
from tests.conftest import SF

from .corpus import SCHEMA, frame, near_components, text, words
from .test_records import crc, ids_of
from .test_rules import base, overlap


def test_stages_take_effect(spark):
    docs = table(spark, SF, "documents")
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stash(stage(spark, docs, SF), name)
        assert out.columns == docs.columns
        seen[name] = (docs, out)
        docs = out
    before, after = seen["near_duplicates"]
    rows = [tuple(r) for r in before.collect()]
    assert {r.doc_id for r in after.collect()} == {c for _, _, c in near_components(rows, 5, 80)}
    packed = corpus_pipeline.run(spark, SF)
    assert packed.select("doc_id").distinct().count() == docs.count()
    most = packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).agg(F.max("n")).first()[0]
    assert most <= 1024


def raw_documents():
    """Rejects, common lines, copies, near copies, repeated passages, contaminated documents, nulls; extra columns."""
    rng = random.Random(21)
    item, passage, page = text(rng, 40, 10**6), " ".join(text(rng, 70, 10**6).split()), text(rng, 150, 10**6)
    texts = [text(rng, 160, 10**6) for _ in range(12)]
    texts += ["Follow us on the usual places\n" + text(rng, 120, 10**6) for _ in range(13)]
    texts += ["\n".join([text(rng, 70, 10**6), passage, text(rng, 60, 10**6)]) for _ in range(3)]
    texts += [text(rng, 90, 10**6) + "\n" + item + "\n" + text(rng, 30, 10**6), page, page, page.replace(" w1", " x1", 1), text(rng, 2500, 10**6)]
    texts += ["too short", "spam spam spam\n" * 40, "", None, texts[0]]
    rows = [(i, t, "en", "h", len(t or ""), "r", 1, 2, "k") for i, t in enumerate(texts)]
    return [*rows, rows[3], (None, None, None, None, None, None, None, None, None), (100, texts[1], "en", None, 5, "r", 1, 2, "k")], [(0, item, "s"), (1, None, "s")]


def cleaned(rows):
    """Quality rules, copies of a text on a host being one document."""
    def lines(t):
        return [(x, re.sub(r"[\x20\x09-\x0D]+", " ", x).strip(" ").lower()) for x in (t or "").split("\n")]

    seen = defaultdict(set)
    for r in rows:
        for line, norm in lines(r[1]):
            if words(line):
                seen[r[3], norm].add(r[1])
    out = []
    for r in rows:
        n, *_, repeated = base(r[1])
        gone = [bool(words(line)) and len(seen[r[3], norm]) > 10 for line, norm in lines(r[1])]
        lost = sum(len(words(line)) for (line, _), g in zip(lines(r[1]), gone, strict=True) if g)
        if n >= 50 and 2 * repeated <= n and n - lost >= 50 and 2 * lost <= n:
            t = "\n".join(line for (line, _), g in zip(lines(r[1]), gone, strict=True) if not g)
            out.append((*r[:1], t, *r[2:4], len(t), *r[5:]))
    return out


def without_passages(rows):
    seen, split = Counter(), [words(r[1]) for r in rows]
    for w in split:
        seen.update(tuple(w[i : i + 35]) for i in range(len(w) - 34))
    out = []
    for r, w in zip(rows, split, strict=True):
        gone = {j for i in range(len(w) - 34) if seen[tuple(w[i : i + 35])] > 1 for j in range(i, i + 35)}
        parts = re.findall(r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*", r[1])
        t = re.match(r"[\x20\x09-\x0D]*", r[1])[0] + "".join(p for j, p in enumerate(parts) if j not in gone)
        out.append((*r[:1], t, *r[2:4], len(t) if gone else r[4], *r[5:]))
    return out


def tokens(t):
    return re.findall(r"[^\W_]+", (t or "").lower())


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rows, items = raw_documents()
    path = str(tmp_path_factory.mktemp("corpus"))
    frame(spark, rows).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string, seed string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_every_stage_is_brute_force(spark, folder):
    rows, items = raw_documents()
    want = [cleaned(rows)]
    first = {(d, c) for (d, _, c) in near_components(want[0], 5, 80)}
    want.append(sorted({r for r in want[0] if (r[0], r[0]) in first}))
    want.append(without_passages(want[1]))
    want.append([r for r in want[2] if not any(overlap(tokens(r[1]), tokens(b[1])) for b in items)])
    sizes = [len(rows), *map(len, want)]
    assert sizes == sorted(sizes, reverse=True) and len(set(sizes)) == 4  # all but the third, which cuts texts, take documents
    docs = table(spark, folder, "documents")
    for (name, stage), expected in zip(corpus_pipeline.STAGES[:-1], want, strict=True):
        docs = stash(stage(spark, docs, folder), name)
        assert docs.columns == [c.split()[0] for c in SCHEMA.split(", ")]
        assert sorted(map(repr, (tuple(r) for r in docs.collect()))) == sorted(map(repr, expected)), name
    out = corpus_pipeline.run(spark, folder).collect()
    pieces = Counter()
    for r, ids in zip(want[-1], ids_of("byte_bpe_50k.json", [r[1] for r in want[-1]]), strict=True):
        cuts = [0, *range(len(ids) % 1024 or 1024, len(ids) + 1, 1024)]
        pieces.update((r[0], i, a, b - a, crc(ids[a:b])) for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)))
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == pieces


@pytest.mark.parametrize("rows", [[], [(1, None, *[None] * 7), (2, "", *[None] * 7)]])
def test_tables_without_texts(spark, rows, tmp_path):
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string, seed string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    for _, stage in corpus_pipeline.STAGES[1:-1]:  # stages by themselves keep such rows
        assert stage(spark, table(spark, str(tmp_path), "documents"), str(tmp_path)).count() == len(rows)
