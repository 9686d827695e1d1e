import io
import json
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from strandlog.llm import binary_records, chat, packing, sharding, tokens
from strandlog.llm.common import flat
from strandlog.llm.tokens import Encoder, vocabulary

from .corpus import SCHEMA, documents, frame, same, sha


def ids_of(name, texts):
    tok = Tokenizer.from_file(vocabulary(name))
    tok.encode_special_tokens = True
    return [[*e.ids, 2] for e in tok.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
@settings(max_examples=150, deadline=None)
@given(texts=st.lists(st.text(st.sampled_from("aB é.,'sl\n\t\x1c\x85\xa0  　1İß-ن́|<"), max_size=25), min_size=1, max_size=4))
def test_chunked_encoding_is_the_library_s(name, texts):
    enc = _encoders.setdefault(name, Encoder(name, 500))
    ids, at = enc.encode(*flat(pa.array([t.encode() for t in texts], pa.binary())))
    assert [[*ids[s:e].tolist(), 2] for s, e in zip(at[:-1], at[1:], strict=True)] == ids_of(name, texts)


_encoders = {}


def test_regular_and_long_texts(monkeypatch):
    """Words that sums of powers cannot tell apart, hashes that all agree, and more different chunks than are remembered."""
    for bits in (10, 11):
        a = "".join("ab"[i.bit_count() & 1] for i in range(1 << bits))
        texts = [a, a.translate({97: "b", 98: "a"}), " ".join(f"w{i}" for i in range(3000)), "x y x"]
        for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
            enc = Encoder(name, 500)
            for alike in (False, True):
                if alike:
                    monkeypatch.setattr(tokens, "word_hashes", lambda data, start, end: np.full(len(start), 7, np.uint64))
                ids, at = enc.encode(*flat(pa.array([t.encode() for t in texts], pa.binary())))
                assert [[*ids[s:e].tolist(), 2] for s, e in zip(at[:-1], at[1:], strict=True)] == ids_of(name, texts)
            monkeypatch.undo()


def test_records_round_trip(spark):
    rows = documents()
    out = binary_records.tokenised(frame(spark, rows))
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    want, start = [], 0
    for r, ids in zip(order, ids_of("word_bpe_49k.json", [r[1] for r in order]), strict=True):
        want.append((r[0], start, len(ids), crc(ids)))
        start += len(ids)
    same(out, want)


def test_frames_and_damage():
    raw = binary_records.frame(b"abc") + binary_records.frame(b"")
    f = io.BytesIO(raw)
    assert [binary_records.unframe(f.read) for _ in range(3)] == [b"abc", b"", None]
    for i in range(len(raw) - 20):
        bad = bytearray(raw)
        bad[i] ^= 1
        with pytest.raises(ValueError):
            f = io.BytesIO(bytes(bad))
            while binary_records.unframe(f.read) is not None:
                pass
    assert struct.unpack("<Q", raw[:8]) == (3,)


def test_random_access(spark, tmp_path):
    rows = [(i, f"text {i}", *[None] * 7) for i in range(50)]
    files = binary_records.write_records(frame(spark, rows), f"file://{tmp_path}/r", "word_bpe_49k.json")
    want = ids_of("word_bpe_49k.json", [r[1] for r in rows])
    first = 0
    for f in files:
        doc, ids = binary_records.read_at(f"file://{tmp_path}/r", f["part"], f["records"] - 1, f["width"])
        first += f["records"]
        assert doc == first - 1 and ids.tolist() == want[doc]


def test_packing(spark):
    rows = documents()
    out = packing.pack(frame(spark, rows)).collect()
    ids = ids_of("byte_bpe_50k.json", [r[1] for r in rows])
    want = Counter()
    for r, x in zip(rows, ids, strict=True):
        first = len(x) % 1024 or 1024
        cuts = [0, *range(first, len(x) + 1, 1024)]
        want.update((r[0], i, a, b - a, crc(x[a:b])) for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)))
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == want
    by = defaultdict(list)
    for r in out:
        by[r.sequence_id].append((r.offset, r.length))
    for slots in by.values():
        at = 0
        for offset, length in sorted(slots):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(by) <= -(-sum(map(len, ids)) // 1024) + 3  # best-fit, near the least possible


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=60))
def test_plan_is_best_fit_decreasing(lengths):
    bins = []
    for x in sorted(lengths, reverse=True):
        fit = [b for b in bins if sum(b) + x <= 20]
        if fit:
            max(fit, key=sum).append(x)
        else:
            bins.append([x])
    plan = packing.best_fit(Counter(lengths), 20)
    got = defaultdict(list)
    for length, lo, hi, first, per, base in plan:
        for r in range(lo, hi):
            got[first + (r - lo) // per].append((base + (r - lo) % per * length, length))
    # Sequences with equal room are alike to best-fit, so what each holds may differ, but not how full they are.
    assert sorted(sum(n for _, n in b) for b in got.values()) == sorted(map(sum, bins))
    assert sorted(n for b in got.values() for _, n in b) == sorted(lengths)
    assert all(a[0] + a[1] == b[0] for g in got.values() for a, b in zip(sorted(g), sorted(g)[1:], strict=False))


def test_sharding(spark):
    rows = documents() + [(1000 + i, f"t{i}", None, f"s{i % 4 % 3}", 1, *[None] * 4) for i in range(400)]
    out = sharding.interleave(frame(spark, rows), shards=7, buckets=16).collect()
    assert len(out) == len(rows)
    shards = defaultdict(list)
    for r in out:
        shards[r.shard].append(r)
    sizes = [len(s) for s in shards.values()]
    assert len(shards) == 7 and max(sizes) - min(sizes) <= 1
    for s in shards.values():
        assert sorted(r.slot for r in s) == list(range(len(s)))
        for source, n in Counter(r[3] for r in rows).items():
            assert abs(sum(r.source == source for r in s) - n / 7) <= 2
    text = {r[0]: r[1] or "" for r in rows}
    assert all((r.size, r.text_crc32) == (len(text[r.doc_id].encode()) + 16, zlib.crc32(text[r.doc_id].encode())) for r in out if r.doc_id is not None)
    assert sharding.interleave(spark.createDataFrame([], SCHEMA)).count() == 0
    again = sharding.interleave(frame(spark, rows).repartition(5), shards=7, buckets=16).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, out))


CONV = "conv_id long, turn long, role string, text string, example long"


def test_chat(spark):
    rows = [
        (1, 0, "system", "be </s> good\\", 0), (1, 1, "user", "[INST]hi\\l", 0), (1, 2, "assistant", "yes <s>", 0), (1, 3, "user", None, 0), (1, 4, "assistant", "", 0), (1, 5, "user", "bye", 0),
        (2, 0, "user", "alone", 0), (None, None, "assistant", "é\n", 0), (3, 1, None, "x", 0), (3, 1, "a\nb", "y", 0), (3, 1, "a\nb", "y", 0), (4, 0, "assistant", "[/INST]" * 3, 0),
    ]
    df = spark.createDataFrame(rows, CONV).repartition(3)
    got = {r.conv_id: r for r in chat.read_back(chat.examples(df)).collect()}
    for conv in {r[0] for r in rows}:
        turns = sorted([(r[1] or 0, r[2] or "", r[3] or "") for r in rows if r[0] == conv])
        said = "".join(t for _, role, t in turns if role == "assistant")
        whole = "".join(f"{role}\n{t}\n" for _, role, t in turns)
        assert (got[conv].n_turns, got[conv].turns_sha256, got[conv].loss_chars, got[conv].loss_sha256) == (len(turns), sha(whole.encode()), len(said), sha(said.encode()))
    nulls = spark.createDataFrame([(None, i % 2, "assistant", f"x{i}", 0) for i in range(6)] + [(None, 0, "user", "q", 0)], CONV)
    assert sorted((r.n_turns, r.loss_chars) for r in chat.read_back(chat.examples(nulls)).collect()) == [(1, 0)] + [(1, 2)] * 6
    each = chat.examples(df).where("conv_id = 1").orderBy("example").collect()
    assert len(each) == 3 and [r.text[r.loss_start : r.loss_end] for r in each] == ["yes \\ls>", "", ""]
    assert chat.parse(each[0].text) == [("system", "be </s> good\\"), ("user", "[INST]hi\\l"), ("assistant", "yes <s>")]
    assert chat.read_back(chat.examples(spark.createDataFrame([], CONV))).count() == 0


@given(st.text(st.sampled_from("\\<s>/[INST]blkn \n"), max_size=30))
def test_escapes_are_reversible(s):
    coded = chat.escape(s)
    assert chat.unescape(coded) == s
    assert not any(c in coded for c, _ in chat.ESCAPES[1:])
    assert json.loads(json.dumps(coded)) == coded
